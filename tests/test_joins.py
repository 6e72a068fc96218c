"""Frames over one order, as-of and interval joins and table functions against plain loops, hot keys, nulls and ties among them."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import queries
from millrace.errors import FieldError, StreamError
from millrace.operators import expand, joins, order, records
from millrace.plans import create_builder, create_node
from millrace.sources import GeneratorSource


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("before, after", [(-3, 0), (0, 4), (-2, 2), (-50, -40), (7, 9), (0, 0)])
def test_frames_cross_blocks(spark, before, after):
    values = [(i, random.Random(i).randrange(100)) for i in range(230)]
    df = spark.createDataFrame(values, "i int, v int").repartition(7)
    out = order.moving(df, [F.col("i")], before, after, {"total": F.sum("v"), "first": F.first("v"), "n": F.count("v")}, rows=20)
    wanted = []
    for i, v in values:
        frame = [x for _, x in values[max(0, i + before) : max(0, i + after + 1)]]
        wanted.append((i, v, sum(frame) if frame else None, frame[0] if frame else None, len(frame)))
    assert rows(out) == sorted(wanted, key=repr)


def test_frames_by_name_and_odd_ones(spark):
    df = spark.createDataFrame([(2, None), (1, 5), (None, 7)], "i int, `a b` int")
    out = records.moving(df, ["i"], {"s": ("sum", "a b"), "c": ("count", "a b")}, -1, 0)
    assert rows(out) == sorted([(None, 7, 7, 1), (1, 5, 12, 2), (2, None, 5, 1)], key=repr)
    assert records.moving(df.limit(0), ["i"], {"s": ("sum", "a b")}, -1, 0).collect() == []
    with pytest.raises(FieldError):
        records.moving(df, ["i"], {}, 1, 0)
    plan = records.moving(df, ["i"], {"s": ("sum", "a b")}, -1, 0)._jdf.queryExecution().toString()
    assert "_block" in plan


def as_of_plain(left, right, forward, strict, how, by):
    out = []
    for k, t, v in left:
        best = None
        for k2, t2, w in right:
            if (by and k != k2) or t is None or t2 is None:
                continue
            near = (t2 > t if strict else t2 >= t) if forward else (t2 < t if strict else t2 <= t)
            better = best is None or ((t2, w) < best[1:] if forward else (t2, w) > best[1:])
            if near and better:
                best = (k2, t2, w)
        if best or how == "left":
            out.append((k, t, v, *((best or (None,) * 3)[0 if not by else 1 :])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("by", [["k"], []])
def test_as_of(spark, forward, strict, by):
    rng = random.Random(5)
    make = lambda n: [(rng.choice([None, 1, 1, 1, 1, 2, 3]), rng.choice([None, *range(60)]), i) for i in range(n)]
    left, right = make(150), make(120)
    a, b = spark.createDataFrame(left, "k int, t int, v int").repartition(4), spark.createDataFrame(right, "k int, t int, w int").repartition(3)
    for how in ("left", "inner"):
        out = joins.as_of(a, b, "t", by, direction="forward" if forward else "backward", strict=strict, how=how, order_by=["w"])
        assert rows(out) == as_of_plain(left, right, forward, strict, how, by)


def test_as_of_odd_cases(spark):
    a = spark.createDataFrame([(1, 10), (1, 100), (2, 5)], "k int, t int")
    b = spark.createDataFrame([(1, 8, "x")], "k int, u int, t string")
    assert rows(joins.as_of(a, b, "t", ["k"], right_at="u", tolerance=F.lit(5))) == sorted([(1, 10, 8, "x"), (1, 100, None, None), (2, 5, None, None)], key=repr)
    assert joins.as_of(a, b, "t", ["k"], right_at="u").columns == ["k", "t", "u", "t_right"]
    assert rows(joins.as_of(a, b.limit(0), "t", ["k"], right_at="u")) == sorted([(*r, None, None) for r in [(1, 10), (1, 100), (2, 5)]], key=repr)
    assert joins.as_of(a.limit(0), b, "t", ["k"], right_at="u").collect() == []
    for wrong in ({"direction": "up"}, {"how": "full"}, {"right_by": ["k", "u"]}):
        with pytest.raises(StreamError):
            joins.as_of(a, b, "t", ["k"], right_at="u", **wrong)


def interval_plain(points, intervals, closed, by):
    out = {}
    for i, (k, p) in enumerate(points):
        for k2, lo, hi in intervals:
            if p is None or lo is None or hi is None or (by and k != k2):
                continue
            if (lo <= p if closed in ("left", "both") else lo < p) and (p <= hi if closed in ("right", "both") else p < hi) and (lo < hi or closed == "both"):
                out.setdefault(i, []).append((k2, lo, hi))
    return out


@pytest.mark.parametrize("closed", ["left", "right", "both", "neither"])
@pytest.mark.parametrize("by", [["k"], []])
def test_intervals(spark, closed, by):
    rng = random.Random(closed + str(by))
    points = [(rng.choice([None, 1, 2]), rng.choice([None, rng.randrange(-500, 500), 7])) for _ in range(120)]
    intervals = []
    for _ in range(60):
        lo = rng.randrange(-500, 500)
        intervals.append((rng.choice([None, 1, 2]), rng.choice([None, lo, lo, lo]), lo + rng.choice([-3, 0, 1, 2, 5, 40, 900, 100_000])))
    a, b = spark.createDataFrame(points, "k int, p bigint"), spark.createDataFrame(intervals, "j int, lo bigint, hi bigint")
    met = interval_plain(points, intervals, closed, by)
    for width in (None, 1, 10_000):
        join = lambda how: joins.interval_join(a, b, "p", "lo", "hi", by, ["j"] if by else (), closed, how, width)  # noqa: B023, E731
        assert rows(join("inner")) == sorted([(*points[i], *x) for i, found in met.items() for x in found], key=repr)
    assert rows(join("left")) == sorted([(*p, *x) for i, p in enumerate(points) for x in met.get(i, [(None,) * 3])], key=repr)
    assert rows(join("left_semi")) == sorted([points[i] for i in met], key=repr)
    assert rows(join("left_anti")) == sorted([p for i, p in enumerate(points) if i not in met], key=repr)


def test_intervals_of_other_types_and_none(spark):
    a = spark.sql("SELECT * FROM VALUES (DATE '2020-01-05', TIMESTAMP_NTZ '2020-03-29 02:30:00', 1.5D) t(d, n, x)")
    b = spark.sql("SELECT * FROM VALUES (DATE '2020-01-01', DATE '2020-02-01', TIMESTAMP_NTZ '2020-03-29 02:00:00', TIMESTAMP_NTZ '2020-03-29 03:00:00', 1.25D, 1.75D) t(d0, d1, n0, n1, x0, x1)")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        for p, lo, hi in (("d", "d0", "d1"), ("n", "n0", "n1"), ("x", "x0", "x1")):
            assert joins.interval_join(a, b, p, lo, hi).count() == 1
            assert "NestedLoop" not in joins.interval_join(a, b, p, lo, hi)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [joins.interval_join(a, b.limit(0), "d", "d0", "d1", how=h).count() for h in ("inner", "left", "left_semi", "left_anti")] == [0, 1, 0, 1]
    with pytest.raises(FieldError):
        joins.interval_join(spark.createDataFrame([("a",)], "s string"), spark.createDataFrame([("a", "b")], "lo string, hi string"), "s", "lo", "hi")
    with pytest.raises(StreamError):
        joins.interval_join(a, b, "d", "d0", "d1", closed="open")


def test_overlaps_meet_once(spark):
    rng = random.Random(2)
    make = lambda n: [(i, lo := rng.randrange(300), lo + rng.choice([0, 1, 4, 60, 500])) for i in range(n)]
    one, two = make(80), make(70)
    out = joins.overlap_join(spark.createDataFrame(one, "i int, lo int, hi int"), spark.createDataFrame(two, "i int, lo int, hi int"), "lo", "hi")
    assert out.columns == ["i", "lo", "hi", "i_right", "lo_right", "hi_right"]
    assert rows(out) == sorted([(*a, *b) for a in one for b in two if a[1] < b[2] and b[1] < a[2] and a[1] < a[2] and b[1] < b[2]], key=repr)

def same_as_sql(spark, folder, name):
    """A query over events of equal times, ids that occur several times and nulls equals its SQL; no join of its plan is on cells."""
    import duckdb

    rng = random.Random(8)
    values = [(rng.choice([i, i, i, i % 7, None]), rng.choice(["purchase", "click"]), rng.choice([None, rng.randrange(5)]), rng.choice([None, 0.5, 1.0, 7.5, 90.0]), rng.randrange(3000)) for i in range(300)] + 2 * [(1000, "purchase", 1, 60.0, 5)]
    events = spark.createDataFrame(values, "event_id bigint, event_type string, user_id bigint, value double, s bigint")
    events.select("event_id", "event_type", "user_id", "value", F.timestamp_seconds(F.col("s") + 1_704_067_200).cast("timestamp_ntz").alias("ts")).coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    out = queries.QUERIES[name](spark, str(folder))
    found = con.sql(queries.ORACLE[name])
    at = [found.columns.index(c) for c in out.columns]
    assert rows(out) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    wide = spark.range(3000).select(F.col("id").alias("event_id"), F.lit("purchase").alias("event_type"), F.col("id").alias("user_id"), F.lit(500.0).alias("value"), F.timestamp_seconds(F.col("id") + 1_704_067_200).cast("timestamp_ntz").alias("ts"))
    wide.coalesce(1).write.parquet(f"{folder}/wide/events.parquet")
    out = queries.QUERIES[name](spark, f"{folder}/wide")
    out.collect()
    assert most_rows(out._jdf.queryExecution().executedPlan()) < 100_000


def most_rows(plan):
    """The most rows that a node of an executed plan has made."""
    metrics, own = plan.metrics(), 0
    if metrics.contains("numOutputRows"):
        own = metrics.apply("numOutputRows").value()
    below = [plan.finalPhysicalPlan()] if "AdaptiveSparkPlan" in plan.nodeName() else [plan.plan()] if "QueryStage" in plan.nodeName() else [plan.children().apply(i) for i in range(plan.children().size())]
    return max([own, *map(most_rows, below)])

@pytest.mark.parametrize("block", [None, 7])
def test_statistics_of_intervals_equal_pairs(spark, block):
    rng = random.Random(4)
    points = [(rng.choice([None, 1, 1, 1, 2, 3, *range(40)]), rng.choice([None, rng.randrange(200)])) for _ in range(300)]
    intervals = [(i % 50, lo := rng.choice([None, rng.randrange(-20, 220)]), (lo or 0) + rng.choice([-1, 0, 1, 3, 30, 250])) for i in range(120)]
    out = joins.interval_statistics(spark.createDataFrame(points, "u int, t int").repartition(3), spark.createDataFrame(intervals, "i int, lo int, hi int"), "t", "lo", "hi", "u", block=block)
    wanted = []
    for i, lo, hi in intervals:
        if held := [(u, t) for u, t in points if lo is not None and t is not None and lo <= t < hi]:
            times = [t for _, t in held]
            wanted.append((i, lo, hi, len(held), min(times), max(times), len({u for u, _ in held} - {None})))
    assert rows(out) == sorted(wanted, key=repr)


def test_interval_join_makes_no_pairs(spark, tmp_path):
    """Campaigns of one interval, of the same one twice and of several; as many pairs as there would be are never made."""
    same_as_sql(spark, tmp_path, "interval_join")

def test_counts_of_overlaps_equal_pairs(spark):
    rng = random.Random(6)
    make = lambda n: [(rng.choice([None, 1, 2]), lo := rng.randrange(100), lo + rng.choice([0, 1, 4, 60, 300])) for _ in range(n)]
    one, two = make(90), make(80)
    a, b = spark.createDataFrame(one, "k int, lo int, hi int"), spark.createDataFrame(two, "k int, lo int, hi int")
    for by in ([], ["k"]):
        wanted = [(k, lo, hi, sum(lo < h and l < hi and l < h and (not by or k == j) for j, l, h in two)) for k, lo, hi in one if lo < hi]
        assert rows(joins.overlap_counts(a, b, "lo", "hi", by)) == sorted(wanted, key=repr)


def test_overlap_join_makes_no_pairs(spark, tmp_path):
    same_as_sql(spark, tmp_path, "overlap_join")


def test_table_functions(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "c")], "i int, s string")
    split = lambda s, more: [(n, w + more) for n, w in enumerate((s or "").split())]
    out = expand.table_function(df, split, ["s"], [("n", "integer"), ("w", "string")], more="!")
    assert rows(out) == [(1, "a b", 0, "a!"), (1, "a b", 1, "b!"), (4, "c", 0, "c!")]
    kept = expand.table_function(df, split, ["s"], [("n", "integer"), "w"], keep_empty=True, more="")
    assert rows(kept) == sorted([(1, "a b", 0, "a"), (1, "a b", 1, "b"), (2, "", None, None), (3, None, None, None), (4, "c", 0, "c")], key=repr)
    for wrong in (["s"], []):
        with pytest.raises(FieldError):
            expand.table_function(df, split, ["s"], wrong)
    with pytest.raises(Exception, match="2 values for 1"):
        expand.table_function(df, lambda s: [(1, 2)], ["s"], ["n"]).collect()


def test_table_functions_send_no_batch_a_record(spark):
    """Arrow table functions make a batch for each record; values that Spark would take for null are errors."""
    one = spark.range(1)
    assert "ArrowEvalPythonUDTF" not in expand.table_function(one, lambda i: [i], ["id"], ["n"])._jdf.queryExecution().toString()
    kinds = [("b", "boolean"), ("d", "date"), ("a", "array"), ("i", "integer")]
    values = (np.True_, datetime.date(2020, 1, 2), ["x", "y"], np.int64(7))
    assert rows(expand.table_function(one, lambda i: [values], ["id"], kinds)) == [(0, True, datetime.date(2020, 1, 2), ["x", "y"], 7)]
    for kind, value in (("boolean", 1), ("array", "ab")):
        with pytest.raises(Exception, match=f"for a field of type {kind}"):
            expand.table_function(one, lambda i: [(value,)], ["id"], [("o", kind)]).collect()  # noqa: B023


def test_generators_run_in_tasks(spark):
    out = GeneratorSource(lambda a, b, step: ((i, str(i)) for i in range(a, b, step)), ["i", "s"], partitions=[(0, 4), (10, 11), (5, 5)], step=2).read(spark)
    assert rows(out) == [(0, "0"), (10, "10"), (2, "2")] and out.dtypes == [("i", "bigint"), ("s", "string")]
    assert out.rdd.getNumPartitions() == 3
    assert GeneratorSource(lambda: [], ["i"], partitions=[]).read(spark).collect() == []


@pytest.mark.parametrize("n", [10, 25_000])
def test_mixed_values_are_treated_alike_at_any_size(spark, n):
    out = GeneratorSource(lambda: ([i if i % 2 == 0 else "x"] for i in range(n)), ["i"]).read(spark)
    assert out.dtypes == [("i", "bigint")] and out.filter("i IS NULL").count() == n // 2


def test_nodes(spark):
    main = create_builder(spark)
    main.stream_source(spark.createDataFrame([(1, 5), (2, 9)], "i int, t int"))
    other = create_builder(spark)
    other.stream = main.stream
    other.stream_source(spark.createDataFrame([(4, 6, "a")], "lo int, hi int, x string"))
    main.interval_join(other, at="t", low="lo", high="hi", how="left").moving(["i"], {"n": ("count", "i")}, -1, 0)
    assert rows(main.dataframe(spark)) == [(1, 5, 4, 6, "a", 1), (2, 9, None, None, None, 2)]
    late = create_node("as_of_join", at="t", right_at="lo").transform(spark.createDataFrame([(5,)], "t int"), spark.createDataFrame([(4, "a")], "lo int, x string"))
    assert rows(late) == [(5, 4, "a")]
    assert create_node("table_function", lambda s: [(s, s)], ["s"], [("a", "integer"), "b"]).transform(spark.createDataFrame([("7",)], "s string")).collect()[0].a == 7
    assert create_node("value_types", "p").transform(spark.createDataFrame([('{"a": 1}',)], "p string")).first().storage_types == ["integer"]
    with pytest.raises(Exception, match="protected"):
        create_node("table_function").configure({"function": "x"}, protected=True)
