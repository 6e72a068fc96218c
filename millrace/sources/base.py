"""A source reads a DataFrame; a target writes one."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from millrace.errors import FieldError
from millrace.schema import FieldList, collapse, expand


class Source:
    """Reads a table. ``fields`` are those given or, once read, those of the table."""

    fields: FieldList | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def rows(self, spark: SparkSession) -> Iterator[tuple]:
        """Rows one by one, a partition at a time on the driver."""
        return (tuple(r) for r in self.read(spark).toLocalIterator())

    def records(self, spark: SparkSession) -> Iterator[dict]:
        return (r.asDict(recursive=True) for r in self.read(spark).toLocalIterator())


class Target:
    """Writes a table."""

    def write(self, df: DataFrame) -> None:
        raise NotImplementedError


def needs_fields(fields) -> FieldList:
    if fields is None or not len(fields):
        raise FieldError("the source needs fields")
    return FieldList(fields)


def flattened(df: DataFrame, wanted: bool) -> DataFrame:
    return collapse(df) if wanted else df


def nested(df: DataFrame, wanted: bool) -> DataFrame:
    return expand(df) if wanted else df
