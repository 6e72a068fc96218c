import datetime as dt

import pytest

from millrace.errors import StreamError
from millrace.operators import fields as fo
from millrace.operators import quality, records
from millrace.streaming import operators as so


@pytest.fixture
def stream(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i % 5, float(i), base + dt.timedelta(minutes=i)) for i in range(60)]
    spark.createDataFrame(rows, "k int, v double, ts timestamp").write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("k int, v double, ts timestamp").parquet(str(tmp_path / "in"))


def result(df, name, mode):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.sql(f"select * from {name}")


def test_operators_that_streams_run(spark, stream):
    chosen = fo.derive(records.select(stream, "v >= 30"), "v * 2", "w")
    assert result(chosen, "m1", "append").count() == 30
    detail = spark.createDataFrame([(0, "zero"), (1, "one")], "k int, name string")
    assert result(records.merge([stream, detail], [(1, "k")]), "m2", "append").count() == 24
    assert result(records.aggregate(stream, ["k"], ["v"]), "m3", "complete").count() == 5
    assert result(records.append(stream, stream), "m4", "append").count() == 120
    assert result(records.sample(stream, 7), "m9", "append").count() == 7
    assert result(so.audit(stream), "m5", "complete").filter("field_name = 'k'").first().distinct_count == 5
    parts = [result(so.sample_by_key(stream, 40, ["v"], d), f"m6{d}", "append").count() for d in (False, True)]
    assert sum(parts) == 60 and min(parts) > 0
    assert result(so.distinct_within(stream, ["k"], "ts", "1 hour"), "m7", "append").count() == 5
    windows = result(so.window_aggregate(stream, "ts", "30 minutes", [("v", "sum")], ["k"]), "m8", "complete")
    assert windows.count() == 10 and windows.agg({"v_sum": "sum"}).first()[0] == sum(range(60))


def test_written_once(spark, stream, tmp_path):
    for _ in range(2):
        query = so.start(records.select(stream, "v < 10"), str(tmp_path / "out"), str(tmp_path / "check"), availableNow=True)
        query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_what_streams_cannot_do_is_refused_early(stream):
    for step in (
        lambda: quality.audit(stream),
        lambda: quality.field_statistics(stream),
        lambda: records.sample(stream, 5, order_by=["v"]),
        lambda: records.distinct(stream, ["k"], order_by=["v"]),
        lambda: fo.binning(stream, "v", "ntile", 3),
    ):
        with pytest.raises(StreamError):
            step()


BASE = dt.datetime(2024, 1, 1)


def at(minutes):
    return BASE + dt.timedelta(minutes=minutes)


def fed(spark, path, schema, batches, step):
    """What a file stream gives when its files come one by one, the checkpoint being taken up again for each."""
    (path / "in").mkdir()
    out = step(spark.readStream.schema(schema).parquet(str(path / "in" / "*")))
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(path / "in" / str(i)))
        so.start(out, str(path / "out"), str(path / "check"), availableNow=True).awaitTermination()
    return spark.read.schema(out.schema).parquet(str(path / "out"))


def test_sessions_of_a_stream_are_those_of_the_table(spark, tmp_path):
    schema = "k int, v int, ts timestamp"
    first = [(1, 1, at(0)), (1, 2, at(4)), (2, 3, at(1))]
    # The second file closes a gap: records that are late, but not too late, join two sessions.
    second = [(1, 4, at(8)), (1, 5, at(20)), (2, 6, at(11))]
    end = [(9, 0, at(500))]
    too_late = [(1, 100, at(2))]
    step = lambda df: so.session_aggregate(df, "ts", "10 minutes", [("v", "sum")], ["k"], delay="30 minutes").select("k", "session.start", "session.end", "v_sum", "record_count")
    streamed = fed(spark, tmp_path, schema, [first, second, end, too_late], step)
    whole = step(spark.createDataFrame(first + second, schema))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, whole.collect()))
    assert sorted((r.k, r.v_sum, r.record_count) for r in whole.collect()) == [(1, 5, 1), (1, 7, 3), (2, 9, 2)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_streams_join_as_tables_do(spark, tmp_path, how):
    schema = "side int, k int, v int, ts timestamp"
    batches = [[(0, 1, 1, at(0)), (1, 1, 10, at(3)), (0, 2, 2, at(1))], [(1, 1, 11, at(5)), (0, 1, 3, at(4)), (1, 2, 12, at(40))], [(0, 9, 0, at(500)), (1, 9, 0, at(1000))]]

    def step(df):
        left, right = df.filter("side = 0").select("k", "v", "ts"), df.filter("side = 1").select("k", "v", "ts")
        return so.join_within(left, right, ["k"], "ts", "ts", before="1 minutes", after="5 minutes", how=how, left_delay="10 minutes", right_delay="10 minutes")

    streamed = fed(spark, tmp_path, schema, batches, step)
    whole = step(spark.createDataFrame([r for b in batches for r in b], schema))
    known = [tuple(r) for r in whole.filter("k <> 9").collect()]
    assert sorted(map(repr, (tuple(r) for r in streamed.filter("k <> 9").collect()))) == sorted(map(repr, known))
    assert len(known) == {"inner": 4, "left": 5, "left_semi": 2}[how]


def test_joins_that_streams_cannot_do(spark, stream):
    for wrong in ({"how": "full"}, {"right_by": []}):
        with pytest.raises(StreamError):
            so.join_within(stream, stream, ["k"], "ts", "ts", **wrong)
