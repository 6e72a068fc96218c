"""Tables from Python objects on the driver, and from functions that yield rows in tasks."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.schema import SPARK_TYPES, FieldList, fitting
from millrace.session import ship_package
from millrace.sources.base import Source, needs_fields


_STORAGE = {bool: "boolean", int: "integer", float: "float"}


def _made(spark: SparkSession, rows: list, fields: FieldList, schema: T.StructType | None = None) -> DataFrame:
    """Fields of unknown type take the type of their values, which must then agree, unless a schema is given."""
    known, schema = schema is not None, schema or fields.spark()
    for i, f in enumerate(fields if not known else ()):
        if f.storage_type == "unknown" and f.concrete_storage_type is None:
            kinds = {type(r[i]) for r in rows if r[i] is not None}
            storage = _STORAGE.get(next(iter(kinds))) if len(kinds) == 1 else "float" if kinds == {int, float} else None
            if storage:
                schema[i].dataType = SPARK_TYPES[storage]
    out = [tuple(fitting(v, schema[i].dataType.typeName()) for i, v in enumerate(r)) for r in rows]
    return spark.createDataFrame(out, schema)


class RowListSource(Source):
    """Rows from a list of sequences."""

    def __init__(self, a_list: Iterable | None = None, fields=None):
        self.list, self.fields = a_list, fields

    def read(self, spark: SparkSession) -> DataFrame:
        fields = needs_fields(self.fields)
        return _made(spark, [tuple(r) for r in self.list or ()], fields)


class RecordListSource(Source):
    """Rows from a list of dicts; absent keys are null. Without fields, keys in the order in which they are first seen."""

    def __init__(self, a_list: Iterable | None = None, fields=None):
        self.list, self.fields = a_list, fields

    def read(self, spark: SparkSession) -> DataFrame:
        records = list(self.list or ())
        fields = needs_fields(self.fields if self.fields is not None else list(dict.fromkeys(k for r in records for k in r)))
        return _made(spark, [tuple(r.get(n) for n in fields.names()) for r in records], fields)


class _Generated(DataSource):
    """What ``GeneratorSource`` reads: rows of a function, called once in a task for each of its lists of arguments."""

    @classmethod
    def name(cls) -> str:
        return "millrace_generated"

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.options["schema"]))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Calls(self.options["calls"], [f.dataType.typeName() for f in schema])


class _Calls(DataSourceReader):
    def __init__(self, calls: str, kinds: list[str]):
        self.calls, self.kinds = calls, kinds

    def _loaded(self) -> tuple:
        return cloudpickle.loads(base64.b64decode(self.calls))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(len(self._loaded()[1]))]

    def read(self, partition: InputPartition):
        function, arguments, kwargs = self._loaded()
        for row in function(*arguments[partition.value], **kwargs):
            yield tuple(fitting(v, k) for v, k in zip(row, self.kinds, strict=True))


class GeneratorSource(Source):
    """Rows that a generator function yields, called in a task for each read; with ``partitions``, a list of argument lists, once
    for each of these, in as many tasks.

    Fields of unknown type take the type of the first row's value (of the first call), which is asked for on the driver; a value
    that is no number where one is due is null, however many rows there are. The function must yield the same rows when it is
    called again.
    """

    def __init__(self, function: Callable, fields=None, *args, partitions: Iterable | None = None, **kwargs):
        self.function, self.fields, self.args, self.kwargs = function, fields, list(args), dict(kwargs)
        self.partitions = None if partitions is None else [tuple(p) if isinstance(p, (list, tuple)) else (p,) for p in partitions]

    def read(self, spark: SparkSession) -> DataFrame:
        fields, calls = needs_fields(self.fields), [tuple(self.args)] if self.partitions is None else self.partitions
        schema = fields.spark()
        unknown = [i for i, f in enumerate(fields) if f.storage_type == "unknown" and f.concrete_storage_type is None]
        if unknown and calls:
            first = next(iter(self.function(*calls[0], **self.kwargs)), None)
            for i in unknown if first is not None else ():
                if storage := _STORAGE.get(type(first[i])):
                    schema[i].dataType = SPARK_TYPES[storage]
        if not calls:
            return spark.createDataFrame([], schema)
        ship_package(spark)
        spark.dataSource.register(_Generated)
        made = base64.b64encode(cloudpickle.dumps((self.function, calls, self.kwargs))).decode()
        plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
        found = spark.read.format("millrace_generated").options(calls=made, schema=plain.json()).load()
        return found.select(*(F.col(f"c{i}").alias(f.name, metadata=f.metadata) for i, f in enumerate(schema)))
