"""Field statistics that can be kept, updated and united: a stored state per field and part of a table.

A state holds exact counts (records, nulls, empty text), the sum, least and largest of numbers, and three of Spark's mergeable
sketches: of distinct values (HLL), of the order of numbers (KLL) and of frequent values. All of a part's fields are one
aggregation of one pass; a task hands on a row. States of parts unite without reading the parts again, and what is finished
from them equals what is finished from the whole: exactly in the counts, within the sketches' errors in the rest.

Errors: the number of distinct values has a relative standard error of ``DISTINCT_ERROR``; a quantile's rank is within
``RANK_ERROR`` of the one asked for, with 99 % confidence. Few values, fewer than are tracked, are exact: their number, the
values and how often each occurs.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import FieldError
from millrace.operators.quality import _empties, _nulls, _plain
from millrace.schema import column, require, storage_of
from millrace.streaming.limits import require_batch

#: Registers of the sketch of distinct values, as bits, its error, and the error of ranks with the size of sketch that Spark has.
HLL_BITS, DISTINCT_ERROR, RANK_ERROR = 12, 1.04 / 64, 0.0165
#: Values of which a state knows how often each occurs.
TRACKED = 256

#: What is known of each field, and of the records of a part (``field`` null), but for the sketches.
_COUNTS = ("records", "nulls", "empties")
_SKETCH = T.StructType([T.StructField("sketch", T.BinaryType()), T.StructField("maxItemsTracked", T.IntegerType()), T.StructField("itemDataType", T.StringType()), T.StructField("itemDataTypeDDL", T.StringType())])
STATE = T.StructType(
    [T.StructField("field", T.StringType()), T.StructField("storage_types", T.ArrayType(T.StringType())), T.StructField("countable", T.BooleanType())]
    + [T.StructField(n, T.LongType()) for n in _COUNTS]
    + [T.StructField(n, T.DoubleType()) for n in ("total", "least", "most")]
    + [T.StructField("distinct", T.BinaryType()), T.StructField("ranks", T.BinaryType()), T.StructField("often", _SKETCH)]
)


def _text(c: Column, kind: T.DataType) -> Column:
    """Equal values as equal text; both zeros are one value. Null for types that have no such text."""
    if not _plain(kind):
        return F.lit(None).cast("string")
    return (c + F.lit(0.0) if isinstance(kind, (T.DoubleType, T.FloatType)) else c).cast("string")


def _measures(df: DataFrame) -> dict[str, Column]:
    """Aggregates of all fields, by field number and name; what none of a field's values is for is null."""
    out = {"records": F.count(F.lit(1))}
    for i, f in enumerate(df.schema):
        c, text = column(df, f.name), _text(column(df, f.name), f.dataType)
        number = c.cast("double") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")
        made = {
            "nulls": _nulls(c),
            "empties": _empties(c, f.dataType),
            "total": F.sum(number),
            "least": F.min(number),
            "most": F.max(number),
            "distinct": F.hll_sketch_agg(text, F.lit(HLL_BITS)),
            "ranks": F.kll_sketch_agg_double(number),
            "often": F.call_function("approx_top_k_accumulate", text, F.lit(TRACKED)),
        }
        out |= {f"{k}_{i}": v for k, v in made.items()}
    return out


def _fields(df: DataFrame) -> list[Column]:
    """A struct for each field over the columns of ``_measures``, and one for the records."""

    def row(name: str | None, **known: Column) -> Column:
        return F.struct(*(known.get(f.name, F.lit(name) if f.name == "field" else F.lit(None)).cast(f.dataType).alias(f.name) for f in STATE))

    rows = [row(None, storage_types=F.array(), records=F.col("records"), nulls=F.lit(0), empties=F.lit(0))]
    for i, f in enumerate(df.schema):
        parts = {k: F.col(f"{k}_{i}") for k in ("nulls", "empties", "total", "least", "most", "distinct", "ranks", "often")}
        rows.append(row(f.name, storage_types=F.array(F.lit(storage_of(f.dataType))), countable=F.lit(_plain(f.dataType)), records=F.col("records"), **parts))
    return rows


def state(df: DataFrame, part_by: Iterable = ()) -> DataFrame:
    """The states of ``df``'s fields, or those of each part: a row per field (and one for the records, its field null), with the
    values of ``part_by`` before it."""
    require_batch(df, "a state of statistics")
    names = require(df, part_by)
    if clash := {n.lower() for n in names} & {n.lower() for n in STATE.names}:
        raise FieldError(f"parts can't be named as columns of states are: {sorted(clash)}")
    slim = df.drop(*names) if names else df
    made = _measures(slim)
    keys = [column(df, n).alias(f"part_{i}") for i, n in enumerate(names)]
    totals = df.groupBy(*keys).agg(*(v.alias(k) for k, v in made.items()))
    each = totals.select(*(F.col(f"part_{i}").alias(n) for i, n in enumerate(names)), F.explode(F.array(*_fields(slim))).alias("of"))
    return each.select(*names, "of.*")


def unite(*states: DataFrame, by: Iterable = ()) -> DataFrame:
    """States of the same fields as one, for each value of ``by``; a field that only some parts have counts in these."""
    if not states:
        raise FieldError("there is no state to unite")
    names = list(by)
    whole = reduce(lambda a, b: a.unionByName(b), (s.select(*names, *STATE.names) for s in states))
    united = whole.groupBy(*names, "field").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("storage_types")))).alias("storage_types"),
        F.bool_and("countable").alias("countable"),
        *(F.sum(c).alias(c) for c in (*_COUNTS, "total")),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("ranks").alias("ranks"),
        F.call_function("approx_top_k_combine", F.col("often"), F.lit(TRACKED)).alias("often"),
    )
    return united.select(*names, *STATE.names)


def finish(states: DataFrame, distinct_threshold: int | None = 10, record_count: int | None = None, quantiles: Sequence[float] = (), by: Iterable = ()) -> DataFrame:
    """Statistics from states: a row per field (and value of ``by``) with field, value_count, record_count, value_ratio,
    null_count, null_value_ratio, null_record_ratio, empty_string_count, storage_types, unique_storage_type, distinct_count,
    distinct_exact, distinct_overflow, distinct_values (as text; null on overflow), sum, min, max, average and quantiles.

    Of records of parts that lack a field none counts as its value. A threshold beyond what states track has no values.
    """
    names = list(by)
    united = unite(states, by=names)
    records = united.filter("field IS NULL").select(*(F.col(n).alias(f"_of_{n}") for n in names), F.col("records").alias("_all"))
    same = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in names), F.lit(True))
    # A row for each value of ``by``; without any, one.
    joined = united.filter("field IS NOT NULL").join(records if names else F.broadcast(records), same)
    total = F.lit(record_count).cast("bigint") if record_count is not None else F.col("_all")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    top = F.call_function("approx_top_k_estimate", F.col("often"), F.lit(TRACKED))
    marked = joined.withColumn("_top", top)
    tracked = F.aggregate("_top", F.lit(0).cast("bigint"), lambda n, x: n + x["count"])
    plain = F.size("storage_types") > 0
    exact = F.col("countable") & (tracked == F.col("records")) & (F.size("_top") < TRACKED)
    estimate = F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0)) + F.when(F.col("nulls") > 0, 1).otherwise(0)
    counted = F.when(~F.col("countable"), None).when(exact, F.size("_top")).otherwise(estimate).cast("bigint")
    overflow = F.coalesce(counted >= distinct_threshold, F.lit(True)) if distinct_threshold else ~exact
    values = F.sort_array(F.transform(F.filter("_top", lambda x: x["item"].isNotNull()), lambda x: x["item"]))
    wanted = F.array(*(F.lit(float(q)) for q in quantiles)).cast("array<double>")
    out = marked.withColumn("distinct_count", counted).withColumn("distinct_overflow", overflow)
    return out.select(
        *names,
        "field",
        F.col("records").alias("value_count"),
        total.alias("record_count"),
        ratio(F.col("records"), total).alias("value_ratio"),
        F.col("nulls").alias("null_count"),
        ratio(F.col("nulls"), F.col("records")).alias("null_value_ratio"),
        ratio(F.col("nulls"), total).alias("null_record_ratio"),
        F.col("empties").alias("empty_string_count"),
        "storage_types",
        F.when(plain & (F.size("storage_types") == 1), F.col("storage_types")[0]).alias("unique_storage_type"),
        "distinct_count",
        exact.alias("distinct_exact"),
        "distinct_overflow",
        F.when(~F.col("distinct_overflow") & exact, values).alias("distinct_values"),
        F.col("total").alias("sum"),
        F.col("least").alias("min"),
        F.col("most").alias("max"),
        F.when(F.col("records") > F.col("nulls"), F.col("total") / (F.col("records") - F.col("nulls"))).alias("average"),
        (F.when(F.col("least").isNotNull(), F.kll_sketch_get_quantile_double("ranks", wanted)) if quantiles else F.lit(None).cast("array<double>")).alias("quantiles"),
    )


class StatisticsTable:
    """States of the parts of a growing table under a path: a part that comes again replaces its state, the others stay."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def update(self, df: DataFrame, part: str) -> None:
        """Keep the state of ``df`` as that of ``part``; only ``df`` is read."""
        self.keep(state(df), part)

    def keep(self, states: DataFrame, part: str) -> None:
        marked = states.select(*STATE.names, F.lit(str(part)).alias("part"))
        marked.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType([*STATE, T.StructField("part", T.StringType())])).parquet(self.path)

    def parts(self, spark: SparkSession) -> list[str]:
        return sorted(r.part for r in self.read(spark).select("part").distinct().collect())

    def statistics(self, spark: SparkSession, parts: Iterable[str] | None = None, **how) -> DataFrame:
        """Finished statistics of all parts or of some; no part's data is read."""
        found = self.read(spark)
        return finish(found if parts is None else found.filter(F.col("part").isin(list(parts))), **how)


class Observed:
    """A table on its way to a target, and the state of its fields once it is there: the audit costs no scan of its own."""

    def __init__(self, df: DataFrame):
        require_batch(df, "an observed audit")
        self._observation, self._fields = Observation(), _fields(df)
        self._spark = df.sparkSession
        made = {k: v.alias(k) for k, v in _measures(df).items()}
        self.df = df.observe(self._observation, *made.values())
        self._kinds = df.agg(*made.values()).schema

    def state(self) -> DataFrame:
        """The state, a row per field. Waits for the first job that reads the whole of ``df`` to end."""
        got = self._observation.get
        known = self._spark.createDataFrame([tuple(got[f.name] for f in self._kinds)], T.StructType([T.StructField(f.name, f.dataType, True) for f in self._kinds]))
        return known.select(F.explode(F.array(*self._fields)).alias("of")).select("of.*")
