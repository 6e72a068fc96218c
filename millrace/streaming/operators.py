"""Streaming forms of operators: an extension, as the streams of a graph are finite."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.errors import StreamError
from millrace.operators import quality
from millrace.operators.joins import free_names
from millrace.operators.records import aggregate, measured
from millrace.schema import column, require


def sample_by_key(df: DataFrame, percent: float, keys: Iterable, discard_sample: bool = False) -> DataFrame:
    """Records whose key falls into a share of all hashes: the same ones on each run, batch or stream."""
    place = F.pmod(F.xxhash64(*(column(df, k) for k in require(df, keys))), F.lit(1_000_000))
    taken = place < int(percent * 10_000)
    return df.filter(~taken if discard_sample else taken)


def distinct_within(df: DataFrame, keys: Iterable, event_time: str, delay: str) -> DataFrame:
    """One record per key, any of them, among those within the watermark; state is bounded by it."""
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(require(df, keys))


def window_aggregate(
    df: DataFrame, event_time: str, width: str, measures: Iterable, keys: Iterable = (), slide: str | None = None, delay: str = "0 seconds"
) -> DataFrame:
    """``aggregate`` by windows of event time; records later than the watermark's delay are left out."""
    names = require(df, keys)
    marked = df.withWatermark(event_time, delay) if df.isStreaming else df
    windowed = marked.withColumn("window", F.window(column(marked, event_time), width, slide) if slide else F.window(column(marked, event_time), width))
    return aggregate(windowed, ["window", *names], measures)


def session_aggregate(df: DataFrame, event_time: str, gap: str, measures: Iterable, keys: Iterable = (), delay: str = "0 seconds", record_count_field: str = "record_count") -> DataFrame:
    """``aggregate`` by sessions of each key: records no more than ``gap`` after the one before are of one session, which ends that
    long after its last one. A stream keeps sessions until the watermark has passed them; later records than its delay are left
    out. Records without a time are in no session."""
    names = require(df, keys)
    marked = df.withWatermark(event_time, delay) if df.isStreaming else df
    session = F.session_window(column(marked, event_time), gap).alias("session")
    grouped = marked.groupBy(*(column(marked, n) for n in names), session)
    return grouped.agg(*measured(marked, measures), F.count(F.lit(1)).alias(record_count_field))


def join_within(
    left: DataFrame,
    right: DataFrame,
    by: Iterable,
    left_at: str,
    right_at: str,
    before: str = "0 seconds",
    after: str = "0 seconds",
    how: str = "inner",
    right_by: Iterable | None = None,
    left_delay: str = "0 seconds",
    right_delay: str = "0 seconds",
    suffix: str = "_right",
) -> DataFrame:
    """Pairs of equal keys whose right time is from ``before`` the left one to ``after`` it; ``how`` is inner, left or left_semi.

    Of two streams each keeps records until the other's watermark shows that no partner can come; a record of ``left`` without
    one is then put out. The same join of finite tables gives the same pairs.
    """
    if how not in ("inner", "left", "left_semi"):
        raise StreamError(f"a join of streams is inner, left or left_semi, not {how!r}")
    keys, others = require(left, by), require(right, right_by if right_by is not None else by)
    if len(keys) != len(others) or not keys:
        raise StreamError("streams are joined on as many keys on both sides, one at least")
    a, b = (d.withWatermark(t, delay) if d.isStreaming else d for d, t, delay in ((left, left_at, left_delay), (right, right_at, right_delay)))
    names = free_names(left, right.columns, suffix)
    a, b = a.toDF(*(f"l{i}" for i in range(len(a.columns)))), b.toDF(*(f"r{i}" for i in range(len(b.columns))))
    of_a, of_b = (lambda n: F.col(f"l{left.columns.index(n)}")), (lambda n: F.col(f"r{right.columns.index(n)}"))
    condition = (of_b(right_at) >= of_a(left_at) - F.expr(f"INTERVAL '{before}'")) & (of_b(right_at) <= of_a(left_at) + F.expr(f"INTERVAL '{after}'"))
    for x, y in zip(keys, others):
        condition = condition & (of_a(x) == of_b(y))
    joined = a.join(b, condition, how)
    out = list(left.columns) if how == "left_semi" else [*left.columns, *names]
    return joined.toDF(*out)


def audit(df: DataFrame, distinct_threshold: int | None = 10) -> DataFrame:
    """The audit of all records so far, with sketches for distinct counts (complete mode)."""
    return quality.audit(df, distinct_threshold, approximate=True)


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Write a stream as Parquet, exactly once per record under the checkpoint."""
    writer = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
