import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.errors import FieldError, StreamError
from millrace.functions.expressions import translate
from millrace.operators import fields as fo
from millrace.operators import quality, records
from millrace.schema import FieldList
from millrace.sources import RecordListSource, RowListSource


@pytest.fixture(scope="module")
def sample(spark):
    rows = [[i, i / 4, f"item-{i}", "x"] for i in range(100)]
    return RowListSource(rows, [("i", "integer"), ("q", "float"), ("str", "string"), ("custom", "string")]).read(spark).cache()


@pytest.fixture(scope="module")
def groups(spark):
    rows = []
    for i in range(1, 10):
        rows += [[i, i, i / 4, "a", "x"], [i, i * 10, i / 4, "a", "y"], [i * 10, i * 100, i / 4, "b", "x"], [i * 100, i * 1000, i / 4, "c", "y"]]
    return RowListSource(rows, [("id", "integer"), ("id2", "integer"), ("q", "float"), ("type", "string"), ("class", "string")]).read(spark).cache()


def total(df, column):
    return df.agg(F.sum(column)).first()[0]


def test_sampling(sample):
    assert [r.i for r in records.sample(sample, 5, order_by=["i"]).collect()] == [0, 1, 2, 3, 4]
    assert records.sample(sample, 0, order_by=["i"]).count() == 0
    assert sorted(r.i for r in records.sample(sample, 95, True, order_by=["i"]).collect()) == [95, 96, 97, 98, 99]
    assert records.sample(sample, 5, method="random").count() == 5 and records.sample(sample, 500, method="random").count() == 100
    assert records.sample(sample, 0, method="percent").count() == 0 and records.sample(sample, 100, method="percent").count() == 100
    assert [r.i for r in records.sample(sample, 30, method="nth", order_by=["i"]).orderBy("i").collect()] == [29, 59, 89]
    same = [sorted(r.i for r in records.sample(sample, 30, method="percent", seed=4).collect()) for _ in range(2)]
    assert same[0] == same[1]
    for bad in (-1, 101):
        with pytest.raises(ValueError):
            records.sample(sample, bad, method="percent")
    with pytest.raises(FieldError):
        records.sample(sample, 1, method="other")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(size=st.integers(0, 120), method=st.sampled_from(["first", "random", "percent", "nth"]))
def test_a_sample_and_its_rest_are_the_input(sample, size, method):
    size = max(size, 1) if method == "nth" else min(size, 100)
    parts = [records.sample(sample, size, discard, method, ["i"], seed=5) for discard in (False, True)]
    assert sorted(r.i for p in parts for r in p.collect()) == list(range(100))


def test_selection(sample):
    assert records.select(sample, "i < 5").count() == 5 and records.select(sample, "i < 5", discard=True).count() == 95
    assert records.select(sample, lambda **r: r["i"] < 5).count() == 5
    assert records.function_select(sample, lambda value, threshold: value > threshold, ["i"], discard=True, threshold=7).count() == 8
    assert records.function_select(sample, lambda value: str(value).startswith("1"), ["i"]).count() == 11
    with pytest.raises(FieldError):
        records.select(sample, "nothing < 5")


def test_sets(groups, spark):
    assert records.set_select(groups, "type", ["a"]).count() == 18 and records.set_select(groups, "type", ["a"], True).count() == 18
    df = spark.createDataFrame([("a",), (None,), ("b",)], "v string")
    assert [r.v for r in records.set_select(df, "v", ["a"], True).collect()] == [None, "b"]
    assert [r.v for r in records.set_select(df, "v", [None]).collect()] == [None]
    assert records.set_select(df, "v", []).count() == 0


def test_distinct(groups, spark):
    assert records.distinct(groups).count() == 36
    assert records.distinct(groups, ["type"]).count() == 3 and records.distinct(groups, ["type", "class"]).count() == 4
    assert records.distinct(groups, ["id"], discard=True).count() == 9 + 0 and records.distinct(groups, ["id2"], discard=True).count() == 36 - groups.select("id2").distinct().count()
    first = records.distinct(groups, ["type"], order_by=[F.col("id2").desc()]).orderBy("type").collect()
    assert [r.id2 for r in first] == [90, 900, 9000]
    both = [records.distinct(groups, ["type"], d, ["id", "id2"]).count() for d in (False, True)]
    assert sum(both) == 36
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    assert records.distinct(nulls, ["k"]).count() == 2


def test_append(spark):
    schema = [("i", "integer"), ("custom", "string")]
    a, b = (RowListSource([[i, c] for i in range(4)], schema).read(spark) for c in "ab")
    assert [r.custom for r in records.append(a, b).collect()] == ["a"] * 4 + ["b"] * 4
    c = b.withColumnRenamed("custom", "other")
    joined = records.append_by_name(a, c, source_field="file", names=["a.csv", "b.csv"])
    assert joined.columns == ["i", "custom", "file", "other"] and joined.filter("custom is null and other = 'b' and file = 'b.csv'").count() == 4
    with pytest.raises(StreamError):
        records.append()


def test_merge(groups, spark):
    detail = RowListSource([["a", "apple"], ["b", "bananna"], ["c", "curry"], ["d", "dynamite"]], [("type2", "string"), ("name", "string")]).read(spark)
    out = records.merge([groups, detail], [(1, "type", "type2")], maps={0: {"drop": ["id2"]}, 1: {"drop": ["type2"]}})
    assert out.count() == 36 and out.columns == ["id", "q", "type", "class", "name"]
    twice = detail.union(detail.limit(1))
    assert records.merge([groups, twice], [(1, "type", "type2")]).count() == 36
    assert records.merge([groups, twice], [(1, ["type"], ["type2"])], duplicates="expand").count() == 36 + 18
    with pytest.raises(Exception, match="several records of one key"):
        records.merge([groups, twice], [(1, "type", "type2")], duplicates="error").collect()
    assert records.merge([groups, detail], [(1, "type", "type2")], duplicates="error").count() == 36
    assert records.merge([groups, detail.filter("name = 'apple'")], [(1, "type", "type2")], how="left_anti").count() == 18
    pairs = RowListSource([["a", "x", 1], ["c", "y", 2]], [("t", "string"), ("c", "string"), ("n", "integer")]).read(spark)
    assert records.merge([groups, pairs], [(1, ("type", "class"), ("t", "c"))]).count() == 18
    for bad in ([(1,)], [(0, "type")], [(2, "type")], [(1, ("type", "class"), "t")]):
        with pytest.raises(StreamError):
            records.merge([groups, pairs], bad)


def test_aggregate(groups, spark):
    rows = {r.type: r for r in records.aggregate(groups, ["type"], ["id"]).collect()}
    assert {k: (r.id_sum, r.record_count) for k, r in rows.items()} == {"a": (90, 18), "b": (450, 9), "c": (4500, 9)}
    assert rows["a"].asDict().keys() == {"type", "id_sum", "id_min", "id_max", "id_average", "record_count"}
    whole = records.aggregate(groups, measures=["id"]).collect()
    assert len(whole) == 1 and whole[0].id_sum == 5040 and whole[0].record_count == 36
    assert records.aggregate(groups.limit(0), measures=["id"]).count() == 0
    compat = records.aggregate(groups.filter("type = 'b'"), ["type"], ["id"], compat=True).first()
    assert compat.id_min == 0 and compat.id_average == 50
    assert records.aggregate(spark.createDataFrame([(-3,), (-4,)], "v long"), measures=["v"], compat=True).first() == (-7, -4, 0, -4, 2)
    assert records.aggregate(groups, ["type"], [("id", ["sum"])], record_count_field="n").columns == ["type", "id_sum", "n"]
    with pytest.raises(FieldError):
        records.aggregate(groups, ["type"], [("id", ["median"])])


def test_derive(sample):
    assert total(fo.derive(sample, "i * 10", "ten"), "ten") == 49500
    assert total(fo.derive(sample, lambda **r: r["i"] * 10, "ten", storage_type="integer"), "ten") == 49500
    assert total(fo.derive(sample, lambda **r: int(str(r["i"])) * 10, "ten", storage_type="integer"), "ten") == 49500
    assert fo.derive(sample, None).first().new_field is None
    assert fo.derive(sample, "i*100 + len(str)").filter("i = 12").first().new_field == 1207
    assert FieldList.of_schema(fo.derive(sample, "i", "n", "flag", "integer").schema).field("n").analytical_type == "flag"


def test_expressions(spark):
    df = spark.createDataFrame([(-7, 2, "Ab", None), (7, 2, "cd", 1)], "a long, b long, s string, n int")
    value = lambda text, compat=False: [r[0] for r in df.select(translate(text, df, compat)).collect()]
    assert value("a / b") == [-3.5, 3.5] and value("a / b", True) == [-4, 3] and value("a // b") == [-4, 3]
    assert value("a % b") == [1, 1] and value("-a + 1") == [8, -6] and value("a ** 2") == [49.0, 49.0] and value("a / 0") == [None, None]
    assert value("s + '!'") == ["Ab!", "cd!"] and value("s.upper()") == ["AB", "CD"] and value("'A' in s") == [True, False]
    assert value("n is None") == [True, False] and value("n == None") == [True, False] and value("n is not None and n > 0") == [False, True]
    assert value("0 < a <= 7") == [False, True] and value("a not in (7, 8)") == [True, False] and value("a if a > 0 else b") == [2, 7]
    assert value("max(a, b)") == [2, 7] and value("round(a / b, 0)") == [-4.0, 4.0] and value("int('x')") == [None, None] and value("sql: a + b") == [-5, 9]
    for bad in ("__import__('os')", "a.b", "lambda: 1", "[x for x in s]", "a +", "open('x')", "s[0]", "a if", "len()", "a in b + 1", "f'{a}'"):
        with pytest.raises(FieldError):
            translate(bad, df)


def test_text(spark, sample):
    out = fo.text_substitute(sample.limit(10), "str", [("[1-5]", "X"), ("-", " ")])
    assert out.filter("str rlike '^item [X6-90]*$'").count() == 10
    new = fo.text_substitute(sample.limit(1), "str", [(r"(\w+)-(\d)", r"$\2 \1")], "new").first()
    assert (new.str, new.new) == ("item-0", "$0 item")
    named = fo.text_substitute(sample.limit(1), "str", [(r"(?P<w_x>\w)(?P<y>\w)", r"\g<y>\g<w_x>")]).first().str
    assert named == "time-0"
    twice = spark.createDataFrame([("aa-bc",)], "s string")
    assert fo.text_substitute(twice, "s", [(r"(?P<x_1>\w)(?P=x_1)", r"<\g<x_1>\g<0>$>")]).first().s == "<aaa$>-bc"
    strip = RowListSource([[" foo ", " bar ", " \tbaz\n ", " moo "]], [("str1", "string"), "x", ("str2", "text"), "f"]).read(spark)
    assert tuple(fo.string_strip(strip, ["str1", "str2"]).first()) == ("foo", " bar ", "baz", " moo ")
    typed = spark.createDataFrame([(" a ", 1)], "s string, i int")
    assert fo.string_strip(typed).first().s == "a" and fo.string_strip(typed, ["s"], " a").first().s == ""


def test_coalesce(spark):
    df = spark.createDataFrame([("foo", " 1 2 3 ", "1.5"), (" ", "x", "1d"), (None, None, None), (" 12 ", "1.5", "1e3")], "s string, i string, f string")
    out = fo.coalesce_value_to_type(df, [("s", "string"), ("i", "integer"), ("f", "float")], empty_values={"string": "-", "integer": 0})
    assert [tuple(r) for r in out.collect()] == [("foo", 123, 1.5), ("-", 0, None), ("-", 0, None), ("12", 0, 1000.0)]
    assert fo.coalesce_value_to_type(df, types=["integer"]).dtypes == df.dtypes


def test_thresholds(spark):
    df = spark.createDataFrame([(-1,), (0,), (5,), (10,), (11,), (None,)], "v int")
    bins = lambda *a, **k: [r[1] for r in fo.value_threshold(df, *a, **k).collect()]
    assert bins([("v",)], ["no", "yes"]) == ["no", "yes", "yes", "yes", "yes", None]
    assert bins([("v", 0, 10)]) == ["low", "medium", "medium", "medium", "high", None]
    assert bins([("v", 0, 10)], compat=True)[0] == "medium"
    assert fo.value_threshold(df, [("v", 1)], prefix="p_", suffix="_s").columns == ["v", "p_v_s"]
    for bad in ([("w", 1)], [("v", 1, 2, 3)]):
        with pytest.raises(FieldError):
            fo.value_threshold(df, bad)


def test_binning(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    bins = lambda *a: [r[1] for r in fo.binning(df, "v", *a).orderBy("v").collect()]
    assert bins("width", 4) == [0, 0, 0, 0, 4, 4, 4, 4, 8, 8] and bins("count", 3) == [1, 1, 1, 2, 2, 2, 3, 3, 3, 3]
    assert bins("ntile", 5) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5] and bins("rank") == list(range(10, 0, -1)) and bins("ntile_sum", 2) == [0, 1, 1, 1, 1, 1, 1, 2, 2, 2]
    with pytest.raises(FieldError):
        fo.binning(df, "v", "other")


def test_audit(groups, spark):
    out = quality.audit(groups)
    assert out.count() == 5 and len(out.columns) == 6
    df = spark.createDataFrame([("", 1, [1]), (None, 2, [1]), ("a", 3, [2]), ("a", 4, None)], "s string, i int, a array<int>")
    rows = {r.field_name: r for r in quality.audit(df, 4).collect()}
    assert tuple(rows["s"])[1:] == (4, 1, 0.25, 1, 3) and rows["i"].distinct_count is None and rows["a"].distinct_count == 3
    empty = {r.field_name: r for r in quality.audit(df.limit(0)).collect()}
    assert tuple(empty["s"])[1:] == (0, 0, 0.0, 0, 0)
    for name in ("s", "i"):
        assert rows[name].null_count + df.filter(f"{name} is not null").count() == rows[name].record_count
    assert {r.field_name: r.distinct_count for r in quality.audit(df, None, approximate=True).collect()} == {"s": 3, "i": 4, "a": 3}


def test_statistics_and_probes(spark):
    made = [{"i": i, "bubble": 20 + (i * 8) % 21, "even": True if i % 2 == 0 else None, "type": "abcd"[i % 4]} for i in range(101)]
    df = RecordListSource(made, [("i", "integer"), ("bubble", "integer"), ("even", "boolean"), ("type", "string")]).read(spark)
    stats = {r.field: r for r in quality.field_statistics(df).collect()}
    assert stats["even"].null_count == 50 and stats["even"].null_record_ratio == 50 / 101 and stats["even"].distinct_values == ["true"]
    assert stats["i"].distinct_overflow and stats["i"].distinct_values is None and stats["type"].distinct_values == ["a", "b", "c", "d"]
    assert quality.field_statistics(df, record_count=202).first().value_ratio == 0.5
    row = quality.probe(df, [quality.MissingValuesProbe(), quality.CompletenessProbe()], ["i", "even"]).first()
    assert (row.i_missing_values_count, row.even_missing_values_count, row.even_completeness_unknown, row.even_completeness_count) == (0, 50, 50, 101)
    row = quality.probe(df, [quality.StatisticsProbe()], ["i", "bubble"]).first()
    assert (row.i_statistics_min, row.i_statistics_max, row.i_statistics_sum, row.i_statistics_average) == (0, 100, 5050, 50)
    assert (row.bubble_statistics_min, row.bubble_statistics_max) == (20, 40)
    row = quality.probe(df, [quality.DistinctProbe(3), quality.DistinctProbe()][:1], ["type"]).first()
    assert row.type_distinct_values == ["a", "b", "c"] and row.type_distinct_overflow
    half = spark.createDataFrame([(2.0,), (None,)], "v double")
    assert quality.probe(half, [quality.StatisticsProbe(compat=True)]).first().v_statistics_average == 1.0
    assert quality.probe(df, [quality.ValueTypeProbe()], ["type"]).first().type_value_type_integer == 0


def test_places_over_a_whole_table(spark):
    rows = [(i, None if i % 50 == 0 else i % 7, float(i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "i bigint, v bigint, x double").repartition(5)
    order = F.expr("v")
    want = {r.i: (r.rank, r.tile) for r in df.selectExpr("i", "rank() over (order by v desc) rank", "ntile(9) over (order by i) tile").collect()}
    ranks = {r.i: r.place for r in fo.binning(df, "v", "rank", derived_field="place").collect()}
    tiles = {r.i: r.tile for r in fo.binning(df, "i", "ntile", 9, "tile").collect()}
    assert {i: (ranks[i], tiles[i]) for i in ranks} == want and len(ranks) == 200 and order is not None
    sums = {r.i: r.bin for r in fo.binning(df, "i", "ntile_sum", 4, "bin").collect()}
    total_ = sum(range(200))
    assert sums == {i: min(4, -(-4 * sum(range(i + 1)) // total_)) for i in range(200)}
    few = fo.binning(df.limit(3), "i", "ntile", 9, "tile")
    assert sorted(r.tile for r in few.collect()) == [1, 2, 3] and fo.binning(df.limit(0), "i", "ntile", 9).count() == 0


def test_all_but_the_first_of_a_hot_key(spark):
    df = spark.createDataFrame([(i, None if i % 100 == 0 else "hot" if i % 3 else f"k{i % 9}") for i in range(500)], "i bigint, k string").repartition(6)
    rest = {r.i for r in records.distinct(df, ["k"], discard=True, order_by=["i"]).collect()}
    firsts = {r.i for r in records.distinct(df, ["k"], order_by=["i"]).collect()}
    assert rest | firsts == set(range(500)) and not rest & firsts and len(firsts) == df.select("k").distinct().count()
    assert records.distinct(df.limit(0), ["k"], discard=True).count() == 0


def test_sort_intersect_and_except(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, None)], "i int, s string")
    b = spark.createDataFrame([(1, "x"), (None, None), (3, "z")], "j int, t string")
    assert [r.i for r in records.sort(a, ["i"], descending=True, limit=2).collect()] == [2, 1]
    assert sorted(map(tuple, records.intersect(a, b).collect()), key=str) == sorted([(1, "x"), (None, None)], key=str)
    assert [tuple(r) for r in records.subtract(a, b).collect()] == [(2, "y")] and records.subtract(a, b, keep_all=True).count() == 2
    with pytest.raises(FieldError):
        records.sort(a, ["i"], descending=[True, False])


def test_audits_count_small_fields_only_and_exactly(spark):
    rows = [(i, i % 5, None if i % 4 == 0 else f"v{i % 9}", (-0.0 if i % 2 else 0.0), [i % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "wide int, few int, text string, zero double, list array<int>")
    counts = {r.field_name: r.distinct_count for r in quality.audit(df, 10).collect()}
    assert counts == {"wide": None, "few": 5, "text": None, "zero": 1, "list": 3}
    assert {r.field_name: r.distinct_count for r in quality.audit(df, 11).collect()}["text"] == 10
    assert {r.field_name: r.distinct_count for r in quality.audit(df, None).collect()} == {"wide": 400, "few": 5, "text": 10, "zero": 1, "list": 3}
    assert {r.field_name: r.distinct_count for r in quality.audit(df.limit(0), 10).collect()} == dict.fromkeys(df.columns, 0)
    found = quality.probe(df, [quality.DistinctProbe(3), quality.MissingValuesProbe()], ["few", "text"]).first()
    assert found.few_distinct_values == [0, 1, 2] and found.few_distinct_overflow and found.few_distinct_count == 5 and found.text_missing_values_count == 100


def test_callables_see_bugs_of_their_own(spark):
    df = spark.createDataFrame([(1,)], "i int")
    with pytest.raises(NameError):
        fo.derive(df, lambda i: undefined_name + i, "x", storage_type="integer")  # noqa: F821


def test_random_samples_are_exact_and_need_no_sort(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5000).withColumn("v", F.col("id") % 3).repartition(6).write.parquet(path)
    df = spark.read.parquet(path)
    for n in (0, 1, 777, 4999, 5000, 9000):
        one, rest = records.sample(df, n, method="random", seed=2), records.sample(df, n, True, method="random", seed=2)
        assert one.count() == min(n, 5000) and rest.count() == 5000 - min(n, 5000) and one.intersect(rest).count() == 0
    plan = records.sample(df, 777, method="random")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    # Reads that may differ from each other are sorted.
    moved = df.repartition(3, "v")
    assert records.sample(moved, 100, method="random").count() == 100
    assert records.sample(df.limit(0), 10, method="random").count() == 0


def test_ranks_of_a_value_that_most_records_have(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2800, 7).when(F.col("id") == 2999, None).otherwise(F.col("id") % 11).cast("int").alias("v"))
    out = fo.binning(df, "v", "rank", derived_field="place").groupBy("v", "place").count().collect()
    assert len(out) == 12 and sum(r["count"] for r in out) == 3000
    values = sorted((r.v for r in df.collect() if r.v is not None), reverse=True)
    assert {r.v: r.place for r in out} == {None: 3000} | {v: values.index(v) + 1 for v in set(values)}
