"""Samples of streams in the order of event time are those of the table, however records come in files."""

import datetime as dt
import random

import pytest

from millrace.errors import StreamError
from millrace.operators import records
from millrace.streaming import operators as so
from millrace.streaming import state

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "k int, v string, ts timestamp"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, state.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def batches():
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 2]), rng.choice(["a", "b", None, f"v{i}"]), BASE + dt.timedelta(minutes=i)) for i in range(40)]
    # Out of order by a few minutes, in three files, and a last record that moves the watermark over all others.
    rows.sort(key=lambda r: (r[2] + dt.timedelta(minutes=rng.randrange(6)), repr(r)))
    return [rows[:15], rows[15:28], rows[28:], [(9, "end", BASE + dt.timedelta(days=2))]]


def fed(spark, path, step):
    (path / "in").mkdir()
    out = step(spark.readStream.schema(SCHEMA).parquet(str(path / "in" / "*")))
    for i, batch in enumerate(batches()):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(path / "in" / str(i)))
        so.start(out, str(path / "out"), str(path / "check"), availableNow=True).awaitTermination()
    return sorted(map(tuple, spark.read.schema(out.schema).parquet(str(path / "out")).collect()), key=repr)


def known(spark):
    return spark.createDataFrame([r for b in batches()[:-1] for r in b], SCHEMA)


@pytest.mark.parametrize("discard", [False, True])
def test_first_of_each_key(rocks, tmp_path, discard):
    got = fed(rocks, tmp_path, lambda df: state.first(df, 1, "ts", ["k"], "30 minutes", discard))
    assert got == sorted(map(tuple, records.distinct(known(rocks), ["k"], discard=discard, order_by=["ts"]).collect()), key=repr)


def test_every_third_of_all(rocks, tmp_path):
    got = fed(rocks, tmp_path, lambda df: state.nth(df, 3, "ts", delay="30 minutes"))
    assert got == sorted(map(tuple, records.sample(known(rocks), 3, method="nth", order_by=["ts"]).collect()), key=repr)


def test_distinct_values_are_counted_exactly(rocks, tmp_path):
    got = fed(rocks, tmp_path, lambda df: state.first_seen(df, ["v"], "ts", "30 minutes"))
    assert got == sorted(map(tuple, known(rocks).select("v").distinct().collect()), key=repr)


def test_what_is_refused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for wrong in (lambda: state.first(known(spark), 1, "ts"), lambda: state.first(stream, 1, "ts"), lambda: state.first_seen(stream, [], "ts")):
        with pytest.raises(StreamError):
            wrong()
    for wrong in (lambda: state.first(stream, -1, "ts"), lambda: state.nth(stream, 0, "ts")):
        with pytest.raises(ValueError):
            wrong()
