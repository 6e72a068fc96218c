"""Operators on streams that need to know what came before, in the order of event time: a state per key, and timers.

Records of a key are held until the watermark has passed them, then taken in order; so the result doesn't depend on how records
came in micro-batches, and a query that is started again goes on where it was. What is later than the watermark is left out.
State per key: records that the watermark hasn't passed, and a number. The session must keep state in RocksDB
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.errors import StreamError
from millrace.schema import column, named, require
from millrace.session import ship_package

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """Takes each key's records in order; ``kind`` says which of them are put out, by their place from 1."""

    def __init__(self, kind: str, size: int, discard: bool, names: list[str], held: T.StructType):
        self.kind, self.size, self.discard, self.names, self.held = kind, size, discard, names, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.held)
        self.seen = handle.getValueState("seen", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        latest = set()
        for batch in rows:
            # By place: the key, the time as a number, the record and the time.
            for at, row in zip(batch.iloc[:, -3].tolist(), batch.iloc[:, -2].tolist()):
                self.waiting.appendValue((int(at), row))
                latest.add(int(at))
        for at in latest:
            self.handle.registerTimer(max(at, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"_row": pd.Series([], dtype=str)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due, rest = sorted(x for x in waiting if x[0] <= now), [x for x in waiting if x[0] > now]
        n, out = self.seen.get()[0] if self.seen.exists() else 0, []
        for _, text in due:
            n += 1
            taken = n <= self.size if self.kind == "first" else n % self.size == 0
            if taken != self.discard:
                out.append(text)
        if due:
            self.seen.update((n,))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        yield pd.DataFrame({"_row": pd.Series(out, dtype=str)})

    def close(self) -> None:
        pass


def _in_order(df: DataFrame, event_time: str, delay: str, keys: Iterable, kind: str, size: int, discard: bool) -> DataFrame:
    if not df.isStreaming:
        raise StreamError("finite tables have these operators in millrace.operators.records")
    spark = df.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise StreamError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    ship_package(spark)
    names = require(df, keys)
    time = require(df, [event_time])[0]
    if not isinstance(df.schema[time].dataType, T.TimestampType):
        raise StreamError(f"{time!r} is no timestamp")
    marked = df.withWatermark(time, delay)
    # A record as text, with null fields: whatever its types are, it is read back as it was.
    row = F.to_json(F.struct(*(named(n).alias(f"c{i}") for i, n in enumerate(df.columns))), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    # Keys as one text: a state's key is never null.
    key = F.to_json(F.struct(F.lit(0).alias("k"), *(column(marked, n).alias(f"k{i}") for i, n in enumerate(names))), {"ignoreNullFields": "false"})
    slim = marked.select(key.alias("key"), F.unix_millis(column(marked, time)).alias("at"), row.alias("row"), column(marked, time).alias("time"))
    held = T.StructType([T.StructField("at", T.LongType()), T.StructField("row", T.StringType())])
    made = slim.groupBy("key").transformWithStateInPandas(
        _InOrder(kind, size, discard, names, held), T.StructType([T.StructField("_row", T.StringType())]), "Append", "EventTime"
    )
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)])
    back = made.select(F.from_json("_row", schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("r"))
    return back.select(*(F.col(f"r.c{i}").alias(f.name, metadata=f.metadata) for i, f in enumerate(df.schema)))


def first(df: DataFrame, size: int, event_time: str, keys: Iterable = (), delay: str = "0 seconds", discard: bool = False) -> DataFrame:
    """The first records of each key in the order of event time (then of the record's text), or all others. With a size of one:
    distinct records in an order. Without keys one state has all records: a small stream, or one of few."""
    if size < 0:
        raise ValueError(f"a sample of {size}")
    return _in_order(df, event_time, delay, keys, "first", int(size), discard)


def nth(df: DataFrame, size: int, event_time: str, keys: Iterable = (), delay: str = "0 seconds", discard: bool = False) -> DataFrame:
    """Every ``size``-th record of each key in the order of event time, or all others."""
    if size < 1:
        raise ValueError(f"a sample of {size}")
    return _in_order(df, event_time, delay, keys, "nth", int(size), discard)


def first_seen(df: DataFrame, fields: Iterable, event_time: str, delay: str = "0 seconds") -> DataFrame:
    """The fields' distinct values, each once, when it is first seen: an exact count of them is the number of rows, a stream's or a
    table's. State: a number per value."""
    names = require(df, fields)
    if not names:
        raise StreamError("distinct values need fields")
    return first(df, 1, event_time, names, delay).select(*(named(n) for n in names))
