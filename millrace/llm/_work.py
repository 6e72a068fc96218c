"""Shared plumbing: tables that cut lineage, and pass-through Arrow scans."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.session import shared_dir, ship_package

#: Bytes of an Arrow batch, at most.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Whether shuffle files are removed once the query that made them has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: What operators keep in a worker process between tasks: how to let go of it, by operator.
_kept: dict[str, Callable[[], None]] = {}
_serving = [""]


def keeps(operator: str, clear: Callable[[], None]) -> None:
    """Register what ``operator`` keeps between tasks."""
    _kept[operator] = clear


def serve(operator: str) -> None:
    """A worker process serves one operator after another: let go of what others have kept in it."""
    if _serving[0] != operator:
        for name, clear in _kept.items():
            if name != operator:
                clear()
        give_back()
        _serving[0] = operator


def give_back() -> None:
    """Return memory that is free inside this process to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def task(operator: str, run: Callable) -> Callable:
    """``run``, a function over Arrow batches, as a task of ``operator`` that leaves little behind in its worker."""

    def served(batches):
        serve(operator)
        yield from run(batches)
        give_back()

    return served


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a lost executor costs nothing above it.

    The shuffle files behind it go as soon as it is written; the session's own setting for that is put back.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` made; nothing that is still to be computed may read them."""
    for table in tables:
        if path := getattr(table, "_stored_at", None):
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bounded_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_BYTES: a batch is of whole texts, and the JVM, its memory off the heap and the
    Python worker hold it at once. It stays so, as results are lazy. Workers get this package, too."""
    ship_package(spark)
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(_BATCH).strip().lower()).groups()
    if not 0 < int(number) << 10 * " kmgt".index(unit or " ") <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def among(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``df`` and whether, in ``_maybe``, a whole-number ``key`` may be one of ``wanted`` (one column); false is certain.

    The hashes of ``wanted`` are a map of 2^25 bits, 4 MB however many there are, so that the rows of ``df`` that have no
    partner need not move to find none.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 25)) + 1
    at = place(F.col(wanted.columns[0]).cast("bigint"))
    bits = wanted.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    own = F.bitmap_bit_position(place(F.col(key).cast("bigint"))).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(own / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = df.join(F.broadcast(bits), F.bitmap_bucket_number(place(F.col(key).cast("bigint"))) == F.col("_bucket"), "left")
    maybe = F.col(key).isNotNull() & F.coalesce(F.getbit(byte, own % 8) == 1, F.lit(False))
    return joined.withColumn("_maybe", maybe).drop("_bucket", "_bits")


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` with its columns by place, so that none clashes with an operator's; where ``names`` are now, and all."""
    placed = [f"_c{i}" for i in range(len(df.columns))]
    return df.toDF(*placed), [placed[df.columns.index(n)] for n in names], placed


def widen(schema: T.StructType, fields: str) -> T.StructType:
    """``schema`` and the fields of a DDL string; a column of the same name gives way."""
    more = T.StructType.fromDDL(fields)
    names = {f.name.lower() for f in more}
    return T.StructType([f for f in schema if f.name.lower() not in names] + list(more))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)
