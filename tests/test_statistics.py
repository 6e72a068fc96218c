"""Statistics that are kept and united, observed audits, probes with a state."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import FieldError, StreamError
from millrace.operators import probes, quality, statistics
from millrace.plans import create_builder
from millrace.sources import FileTarget, StreamAuditor

KIND = "i int, x double, s string, b boolean, a array<int>"


def made(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(5)]), rng.choice([None, 0.0, -0.0, rng.gauss(0, 1)]), rng.choice([None, "", "p", "q"]), rng.choice([None, True]), [1]) for _ in range(n)]


EXACT = ["value_count", "record_count", "null_count", "empty_string_count", "storage_types", "distinct_exact", "min", "max"]


def by_field(df):
    return {r.field: r for r in df.collect()}


def test_states_unite_to_that_of_the_whole(spark):
    a, b, c = made(1, 3000), made(2, 50), []
    frames = [spark.createDataFrame(x, KIND) for x in (a, b, c)]
    whole = by_field(statistics.finish(statistics.state(spark.createDataFrame(a + b + c, KIND)), quantiles=[0.0, 1.0]))
    parts = by_field(statistics.finish(statistics.unite(*(statistics.state(f) for f in frames)), quantiles=[0.0, 1.0]))
    assert set(whole) == set(parts) == {"i", "x", "s", "b", "a"}
    for name, own in parts.items():
        assert [own[k] for k in EXACT] == [whole[name][k] for k in EXACT]
        assert own.quantiles == whole[name].quantiles
    assert (parts["i"].distinct_count, parts["i"].distinct_values) == (6, ["0", "1", "2", "3", "4"])
    assert (parts["s"].distinct_count, parts["s"].distinct_values, parts["s"].empty_string_count) == (4, ["", "p", "q"], sum(r[2] == "" for r in a + b))
    assert parts["a"].distinct_count is None and parts["a"].distinct_values is None and parts["a"].unique_storage_type == "array"
    assert parts["x"].distinct_overflow and not parts["x"].distinct_exact
    real = len({r[1] for r in a + b} - {None}) + 1
    assert abs(parts["x"].distinct_count - real) <= 4 * statistics.DISTINCT_ERROR * real
    assert parts["x"].average == pytest.approx(sum(r[1] or 0 for r in a + b) / sum(r[1] is not None for r in a + b))


def test_a_part_that_comes_again_replaces_its_state(spark, tmp_path):
    kept = statistics.StatisticsTable(str(tmp_path / "kept"))
    kept.update(spark.createDataFrame(made(1, 10), KIND), "one")
    kept.update(spark.createDataFrame(made(2, 20), KIND), "two")
    kept.update(spark.createDataFrame(made(3, 5), KIND), "one")
    assert kept.parts(spark) == ["one", "two"]
    assert by_field(kept.statistics(spark))["i"].value_count == 25
    assert by_field(kept.statistics(spark, parts=["one"]))["i"].value_count == 5


def test_fields_that_some_parts_lack(spark):
    one, two = spark.createDataFrame([(1, "a")], "i int, s string"), spark.createDataFrame([("x",), ("",)], "i string")
    found = by_field(statistics.finish(statistics.unite(statistics.state(one), statistics.state(two))))
    assert (found["s"].value_count, found["s"].record_count, found["s"].value_ratio) == (1, 3, 1 / 3)
    assert (found["i"].storage_types, found["i"].unique_storage_type, found["i"].value_count) == (["integer", "string"], None, 3)


def test_many_values_are_counted_within_the_error(spark):
    df = spark.range(50_000).select(F.col("id").alias("k"), (F.col("id") % 300).alias("m"))
    found = by_field(statistics.finish(statistics.state(df), None, quantiles=[0.25]))
    assert abs(found["k"].distinct_count - 50_000) <= 4 * statistics.DISTINCT_ERROR * 50_000
    assert abs(found["m"].distinct_count - 300) <= 4 * statistics.DISTINCT_ERROR * 300
    assert abs(found["k"].quantiles[0] / 50_000 - 0.25) <= statistics.RANK_ERROR
    assert found["k"].distinct_overflow and found["k"].distinct_values is None


def test_parts_by_field_and_names_that_clash(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", None)], "p string, i int")
    found = {(r.p, r.field): r for r in statistics.finish(statistics.state(df, ["p"]), by=["p"]).collect()}
    assert {k: (r.value_count, r.record_count, r.null_count) for k, r in found.items()} == {(None, "i"): (2, 2, 0), ("a", "i"): (1, 1, 1)}
    with pytest.raises(FieldError):
        statistics.state(df.withColumnRenamed("p", "field"), ["field"])
    with pytest.raises(FieldError):
        statistics.unite()


def test_an_observed_audit_reads_its_table_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = made(4, 500)
    df = spark.createDataFrame(rows, KIND).mapInArrow(counted, KIND)
    auditor = StreamAuditor(target=FileTarget(str(tmp_path / "out")))
    auditor.write(df)
    assert read.value == 500
    assert spark.read.parquet(str(tmp_path / "out")).count() == 500
    plain = by_field(quality.field_statistics(spark.createDataFrame(rows, KIND)))
    for name, own in auditor.field_statistics.items():
        assert [own[k] for k in ("value_count", "null_count", "empty_string_count")] == [plain[name][k] for k in ("value_count", "null_count", "empty_string_count")]
    assert auditor.field_statistics["i"]["distinct_values"] == plain["i"].distinct_values
    united = by_field(statistics.finish(statistics.unite(auditor.state, statistics.state(df))))
    assert united["i"].value_count == 1000


def test_the_node(spark):
    main = create_builder(spark)
    main.stream_source(spark.createDataFrame(made(5, 40), KIND))
    main.field_statistics(quantiles=[0.5])
    assert by_field(main.dataframe(spark))["s"].value_count == 40


class Longest(probes.StatefulProbe):
    """The longest text, by the one-value protocol."""

    name = "longest"

    def __init__(self):
        self.text, self.seen = None, 0

    def probe(self, value):
        self.seen += 1
        if value is not None and (self.text is None or (len(value), value) > (len(self.text), self.text)):
            self.text = value

    def merge(self, other):
        seen = self.seen + other.seen
        self.probe(other.text)
        self.seen = seen

    def to_dict(self):
        return {"text": self.text, "seen": self.seen}


def test_probes_with_a_state(spark):
    rows = [(k, s) for k in (None, "a", "b") for s in ("x", "Xy 12", None, "99-a", "longer text", "")] * 7
    df = spark.createDataFrame(rows, "k string, s string").repartition(5)
    whole = probes.probe(df, [probes.ShapeProbe(), Longest()], ["s"]).first()
    assert whole.s_shape.shapes == {"a": 7 * 3, "Aa 9": 21, "9-a": 21, "a a": 21, "": 21} and whole.s_shape.nulls == 21
    assert whole.s_longest == '{"text": "longer text", "seen": 126}'
    each = {r.k: r for r in probes.probe(df, [Longest()], ["s"], by=["k"]).collect()}
    assert {k: r.s_longest for k, r in each.items()} == dict.fromkeys((None, "a", "b"), '{"text": "longer text", "seen": 42}')


def test_probes_of_nothing_and_of_many_shapes(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert probes.probe(empty, [probes.MomentsProbe()], ["v"]).first().v_moments.asDict() == {"count": 0, "left_out": 0, "mean": None, "variance": None, "skewness": None, "kurtosis": None}
    assert probes.probe(empty, [probes.MomentsProbe()], ["v"], by=["k"]).count() == 0
    many = spark.createDataFrame([("-" * 0 + "".join("a-" if c == "1" else "9-" for c in f"{i:b}"),) for i in range(64)], "s string")
    found = probes.probe(many, [probes.ShapeProbe(most=10)]).first().s_shape
    assert len(found.shapes) <= 10 and found.overflow and sum(found.shapes.values()) + found.other == 64


def test_moments_merge_without_loss(spark):
    rng = random.Random(8)
    values = [(rng.choice([None, float("nan"), rng.expovariate(1) + 1e6, rng.gauss(1e6, 5)]),) for _ in range(3000)]
    df = spark.createDataFrame(values, "v double").repartition(7)
    found = probes.probe(df, [probes.MomentsProbe()]).first().v_moments
    known = df.filter("v IS NOT NULL AND NOT isnan(v)")
    exact = known.agg(F.count("v"), F.avg("v"), F.var_pop("v"), F.skewness("v"), F.kurtosis("v")).first()
    assert found.left_out == 3000 - exact[0]
    assert [found[k] for k in ("count", "mean", "variance", "skewness", "kurtosis")] == pytest.approx(list(exact), rel=1e-6)


def test_probes_share_no_names(spark):
    with pytest.raises(FieldError):
        probes.probe(spark.range(3), [Longest(), Longest()])


def test_types_of_values(spark):
    rows = ['{"k":1,"j":"x"}', '{"k":1.5}', '{"k":null,"j":""}', '{"k":[1]}', '{"k":{"a":1}}', '{"k":true}', "nope", None, "3", "null", "{}"]
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    found = {r.key: r for r in quality.value_types(df, "p").collect()}
    assert found["k"].storage_types == ["array", "boolean", "float", "integer", "null", "unknown"] and found["k"].null_count == 1
    assert (found["j"].storage_types, found["j"].unique_storage_type, found["j"].empty_string_count) == (["string"], "string", 1)
    assert (found[None].storage_types, found[None].value_count, found[None].null_count) == (["integer", "null", "unknown"], 4, 2)
    one = quality.probe(df.select(F.try_parse_json("p").alias("v")), [quality.FieldTypeProbe(), quality.StorageTypeProbe()]).first()
    assert one.v_storage_type_types == ["integer", "null", "unknown"] and one.v_storage_type_unique is False and one.v_field_type_null_count == 3
    with pytest.raises(FieldError):
        quality.value_types(spark.range(2), "id")
    assert quality.value_types(spark.createDataFrame([], T.StructType([T.StructField("p", T.StringType())])), "p").count() == 0


def test_streams_are_refused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("i int").parquet(str(tmp_path / "in"))
    for refused in (lambda: statistics.state(stream), lambda: statistics.Observed(stream), lambda: probes.probe(stream, [Longest()]), lambda: quality.value_types(stream, "i")):
        with pytest.raises(StreamError):
            refused()
