"""Tables in files that Spark reads itself, and what fields they have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.schema import FieldList, apply_fields, collapse, column, storage_of
from millrace.sources.base import Source, Target, flattened, nested


class FileSource(Source):
    """Parquet, ORC or JSON; fields limit and type the columns. ``expand`` flattens structs."""

    def __init__(self, path: str, format: str = "parquet", fields=None, expand: bool = False, **options):
        self.path, self.format, self.fields, self.expand, self.options = path, format, fields, expand, options

    def read(self, spark: SparkSession) -> DataFrame:
        df = flattened(spark.read.format(self.format).options(**self.options).load(self.path), self.expand)
        if self.fields is None:
            return df
        fields = FieldList(self.fields)
        return apply_fields(df.select(*(column(df, n) for n in fields.names())), fields)


class FileTarget(Target):
    """Parquet, ORC or JSON, perhaps partitioned. ``expand`` nests dotted columns."""

    def __init__(self, path: str, format: str = "parquet", truncate: bool = False, partition_by=(), expand: bool = False, **options):
        self.path, self.format, self.truncate, self.partition_by, self.expand, self.options = path, format, truncate, list(partition_by), expand, options

    def write(self, df: DataFrame) -> None:
        writer = nested(df, self.expand).write.format(self.format).mode("overwrite" if self.truncate else "append").options(**self.options)
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).save(self.path)


def infer_fields(df: DataFrame, limit: int = 0, collapsed: bool = False) -> FieldList:
    """Fields of a table by its values; text columns whose values (of the first ``limit``, or all) are all numbers or dates
    are typed as such. One aggregation."""
    if collapsed:
        df = collapse(df)
    scanned = df.limit(limit) if limit else df
    text = [n for n, kind in df.dtypes if kind == "string"]
    tried = ("bigint", "double", "boolean", "date")
    fields = FieldList.of_schema(df.schema)
    if text:
        counts = scanned.agg(*(x for i, n in enumerate(text) for x in (F.count(column(df, n)).alias(f"n{i}"), *(F.count(column(df, n).try_cast(k)).alias(f"{k}{i}") for k in tried)))).first()
        names = {"bigint": "integer", "double": "float", "boolean": "boolean", "date": "date"}
        for i, n in enumerate(text):
            fit = next((k for k in tried if counts[f"n{i}"] and counts[f"{k}{i}"] == counts[f"n{i}"]), None)
            if fit:
                fields.retype({n: {"storage_type": names[fit]}})
    for f in df.schema:
        if storage_of(f.dataType) == "unknown":
            fields.retype({f.name: {"concrete_storage_type": f.dataType.simpleString()}})
    return fields
