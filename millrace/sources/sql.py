"""Tables of databases over JDBC, and of Spark's own catalog where no URL is given."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import FieldError, StreamError
from millrace.schema import FieldList, apply_fields, column
from millrace.sources.base import Source, Target


def _full(schema: str | None, table: str) -> str:
    return f"{schema}.{table}" if schema else table


class SQLSource(Source):
    """A table or statement. For large tables give ``partitioning`` (column, lower, upper, number) to read in parallel."""

    def __init__(self, url: str | None = None, table: str | None = None, statement: str | None = None, schema: str | None = None, fields=None, partitioning: tuple | None = None, uri: str | None = None, **options: Any):
        self.url, self.table, self.statement, self.schema, self.fields, self.partitioning, self.options = url or uri, table, statement, schema, fields, partitioning, options

    def read(self, spark: SparkSession) -> DataFrame:
        if not (self.table or self.statement):
            raise StreamError("an SQL source needs a table or a statement")
        if self.url:
            reader = spark.read.format("jdbc").option("url", self.url).options(**self.options)
            reader = reader.option("query", self.statement) if self.statement and not self.partitioning else reader.option("dbtable", f"({self.statement}) t" if self.statement else _full(self.schema, self.table))
            if self.partitioning:
                for k, v in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), self.partitioning):
                    reader = reader.option(k, v)
            df = reader.load()
        else:
            df = spark.sql(self.statement) if self.statement else spark.table(_full(self.schema, self.table))
        if self.fields is not None:
            fields = FieldList(self.fields)
            df = apply_fields(df.select(*(column(df, n) for n in fields.names())), fields)
        return df


class SQLTarget(Target):
    """A table to add to. ``create`` makes it (with ``replace`` even if it is there, else that is an error), ``truncate``
    empties it first; without ``create`` it must be there. ``add_id_key`` adds a running number."""

    def __init__(
        self,
        url: str | None = None,
        table: str | None = None,
        schema: str | None = None,
        truncate: bool = False,
        create: bool = False,
        replace: bool = False,
        add_id_key: bool = False,
        id_key_name: str = "id",
        buffer_size: int = 1000,
        fields=None,
        concrete_type_map: dict | None = None,
        **options: Any,
    ):
        self.url, self.table, self.schema, self.truncate, self.create, self.replace = url, table, schema, truncate, create, replace
        self.add_id_key, self.id_key_name, self.buffer_size, self.fields = add_id_key, id_key_name, buffer_size, fields
        self.concrete_type_map, self.options = concrete_type_map or {}, options

    def column_types(self, fields: FieldList) -> str:
        """``createTableColumnTypes``: a field's concrete type, else the map's of its storage type; others are Spark's choice."""
        found = [(f.name, f.concrete_storage_type or self.concrete_type_map.get(f.storage_type)) for f in fields]
        return ", ".join(f"`{n}` {t}" for n, t in found if t)

    def write(self, df: DataFrame) -> None:
        if not self.table:
            raise StreamError("an SQL target needs a table")
        if self.fields is not None:
            df = df.select(*(column(df, n) for n in FieldList(self.fields).names()))
        if not df.columns:
            raise FieldError("a table needs fields")
        types = self.column_types(FieldList(self.fields) if self.fields is not None else FieldList.of_schema(df.schema))
        if self.add_id_key:
            df = _numbered(df, self.id_key_name)
        name, spark = _full(self.schema, self.table), df.sparkSession
        there = self._exists(spark, name)
        if self.create and there and not self.replace:
            raise ValueError(f"table {name} is there already")
        if not self.create and not there:
            raise StreamError(f"there is no table {name}")
        if self.url:
            writer = df.write.format("jdbc").option("url", self.url).option("dbtable", name).option("batchsize", self.buffer_size).options(**self.options)
            if self.create and types:
                writer = writer.option("createTableColumnTypes", types)
            if self.truncate and there and not self.create:
                writer = writer.option("truncate", "true")
            writer.mode("overwrite" if self.create or self.truncate else "append").save()
        elif self.create:
            df.write.mode("overwrite").saveAsTable(name)
        else:
            df.write.mode("overwrite" if self.truncate else "append").insertInto(name)

    def _exists(self, spark: SparkSession, name: str) -> bool:
        if not self.url:
            return spark.catalog.tableExists(name)
        try:
            spark.read.format("jdbc").option("url", self.url).option("dbtable", f"(select * from {name} where 1 = 0) t").options(**self.options).load()
            return True
        except Exception as e:
            if "driver" in str(e).lower() and "no suitable" in str(e).lower():
                raise StreamError(f"no JDBC driver for {self.url}") from e
            return False


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Running numbers from 1: each partition's rows after those of the partitions before."""
    at = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    counts = at.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = (F.col("_start") + F.col("_at") - F.shiftleft(F.col("_part"), 33) + 1).cast(T.LongType())
    numbered = at.join(F.broadcast(starts), "_part").withColumn(name, number)
    return numbered.select(name, *(column(numbered, n) for n in df.columns))
