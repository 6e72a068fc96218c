"""Data quality: audits, field statistics and probes, each one aggregation over all fields at once."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import FieldError
from millrace.schema import SPARK_TYPES, column, require, storage_of
from millrace.streaming.limits import require_batch


def _nulls(c: Column) -> Column:
    return F.count_if(c.isNull())


def _empties(c: Column, kind: T.DataType) -> Column:
    return F.count_if(c == "") if isinstance(kind, T.StringType) else F.lit(0).cast("bigint")


def _countable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))


def _distinct(c: Column, kind: T.DataType, approximate: bool) -> Column:
    """The number of values, null as one of them; null for types that have no equality."""
    if not _countable(kind):
        return F.lit(None).cast("bigint")
    n = F.approx_count_distinct(c) if approximate else F.count_distinct(c)
    return n + F.max(F.when(c.isNull(), 1).otherwise(0))


def audit(df: DataFrame, distinct_threshold: int | None = 10, approximate: bool = False) -> DataFrame:
    """A row per field: field_name, record_count, null_count, null_record_ratio, empty_string_count, distinct_count.

    The count of distinct values, null as one, is given where it is below the threshold (0 or None: always), else null.
    ``approximate`` counts by sketches: one pass without the rows that exact counts of many fields need, and the only way for
    streams.
    """
    if not approximate:
        require_batch(df, "an exact audit")
    # With a threshold, exact counts are only of fields that a sketch, which is one pass, takes for small.
    few = bool(distinct_threshold) and not approximate
    parts = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(df.schema):
        c = column(df, f.name)
        sketched = approximate or (few and _plain(f.dataType))
        parts += [_nulls(c).alias(f"nulls{i}"), _empties(c, f.dataType).alias(f"empties{i}"), F.coalesce(_distinct(c, f.dataType, sketched), F.lit(0) if _countable(f.dataType) else F.lit(None)).cast("bigint").alias(f"distinct{i}")]
    totals = df.agg(*parts)
    rows = [
        F.struct(
            F.lit(f.name).alias("field_name"),
            F.col("n").alias("record_count"),
            F.col(f"nulls{i}").alias("null_count"),
            F.when(F.col("n") > 0, F.col(f"nulls{i}") / F.col("n")).otherwise(F.lit(0.0)).alias("null_record_ratio"),
            F.col(f"empties{i}").cast("bigint").alias("empty_string_count"),
            (F.when(F.col(f"distinct{i}") < distinct_threshold, F.col(f"distinct{i}")) if distinct_threshold else F.col(f"distinct{i}")).alias("distinct_count"),
        )
        for i, f in enumerate(df.schema)
    ]
    if not few:
        return totals.select(F.inline(F.array(*rows)))
    small = [F.struct(F.lit(i).alias("at"), (F.col(f"distinct{i}") <= 2 * distinct_threshold + 10).alias("small")) for i, f in enumerate(df.schema) if _plain(f.dataType)]
    stats = totals.select(F.inline(F.array(*rows)))
    if not small:
        return stats
    counts = _values(df, totals.select(F.inline(F.array(*small))).filter("small").select("at")).groupBy("at").agg(F.count("*").alias("exact"))
    names = {i: f.name for i, f in enumerate(df.schema)}
    sketched = [i for i, f in enumerate(df.schema) if _plain(f.dataType)]
    each = counts.select(F.element_at(F.create_map(*(x for i, n in names.items() for x in (F.lit(i), F.lit(n)))), F.col("at")).alias("field_name"), "exact")
    joined = stats.join(F.broadcast(each), "field_name", "left")
    exact = F.when(F.coalesce("exact", F.when(F.col("record_count") == 0, 0)) < distinct_threshold, F.coalesce("exact", F.lit(0)).cast("bigint"))
    return joined.select(*(F.when(F.col("field_name").isin([names[i] for i in sketched]), exact).otherwise(F.col(c)).alias(c) if c == "distinct_count" else F.col(c) for c in stats.columns))


def _plain(kind: T.DataType) -> bool:
    """Whether a type's values, as text, are equal where they are equal."""
    return isinstance(kind, T.AtomicType) and not isinstance(kind, (T.VariantType, T.BinaryType))


def _values(df: DataFrame, fields: DataFrame) -> DataFrame:
    """(at, v): the distinct values, as text, of the plain fields whose numbers ``fields`` has; others are dropped first."""
    plain = [(i, column(df, f.name), f.dataType) for i, f in enumerate(df.schema) if _plain(f.dataType)]
    # Both zeros are one value.
    text = [F.struct(F.lit(i).alias("at"), (c + F.lit(0.0) if isinstance(k, (T.DoubleType, T.FloatType)) else c).cast("string").alias("v")) for i, c, k in plain]
    return df.select(F.inline(F.array(*text))).join(F.broadcast(fields), "at").distinct()


def field_statistics(df: DataFrame, distinct_threshold: int | None = 10, record_count: int | None = None) -> DataFrame:
    """A row per field: field, value_count, record_count, value_ratio, null_count, null_value_ratio, null_record_ratio,
    empty_string_count, storage_type, distinct_count, distinct_overflow and distinct_values (as text; null on overflow).

    Values are gathered only of fields with fewer distinct ones than the threshold; the others' are dropped before they move.
    Without a threshold all are gathered, as asked.
    """
    require_batch(df, "field statistics")
    parts = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(df.schema):
        c = column(df, f.name)
        parts += [_nulls(c).alias(f"nulls{i}"), _empties(c, f.dataType).alias(f"empties{i}"), F.coalesce(_distinct(c, f.dataType, False), F.lit(0) if _countable(f.dataType) else F.lit(None)).cast("bigint").alias(f"distinct{i}")]
    totals = df.agg(*parts)
    total = F.lit(record_count).cast("bigint") if record_count is not None else F.col("n")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    rows = [
        F.struct(
            F.lit(f.name).alias("field"),
            F.col("n").alias("value_count"),
            total.alias("record_count"),
            ratio(F.col("n"), total).alias("value_ratio"),
            F.col(f"nulls{i}").alias("null_count"),
            ratio(F.col(f"nulls{i}"), F.col("n")).alias("null_value_ratio"),
            ratio(F.col(f"nulls{i}"), total).alias("null_record_ratio"),
            F.col(f"empties{i}").cast("bigint").alias("empty_string_count"),
            F.lit(storage_of(f.dataType)).alias("storage_type"),
            F.col(f"distinct{i}").alias("distinct_count"),
            (F.coalesce(F.col(f"distinct{i}") >= distinct_threshold, F.lit(True)) if distinct_threshold else F.lit(False)).alias("distinct_overflow"),
        )
        for i, f in enumerate(df.schema)
    ]
    stats = totals.select(F.inline(F.array(*rows)))
    plain = [(i, f.name) for i, f in enumerate(df.schema) if _plain(f.dataType)]
    if not plain:
        return stats.withColumn("distinct_values", F.lit(None).cast("array<string>"))
    numbers = F.create_map(*(x for i, n in plain for x in (F.lit(n), F.lit(i))))
    few = stats.filter("not distinct_overflow").select(numbers[F.col("field")].alias("at")).filter("at is not null")
    values = _values(df, few).groupBy("at").agg(F.sort_array(F.collect_list("v")).alias("distinct_values"))
    joined = stats.join(F.broadcast(values), numbers[F.col("field")] == F.col("at"), "left").drop("at")
    return joined.withColumn("distinct_values", F.when(~F.col("distinct_overflow"), F.coalesce("distinct_values", F.array().cast("array<string>"))))


# Probes. Each gives aggregate columns of one field; ``probe`` runs several over several fields in one pass.


class Probe:
    """Aggregates of one field, by name."""

    name = "probe"

    def columns(self, c: Column, kind: T.DataType) -> dict[str, Column]:
        raise NotImplementedError

    def tables(self, df: DataFrame, name: str) -> dict[str, DataFrame]:
        """Results that are no aggregates of the same pass: tables of one row and one column."""
        return {}


class MissingValuesProbe(Probe):
    name = "missing_values"

    def columns(self, c, kind):
        return {"count": _nulls(c)}


class CompletenessProbe(Probe):
    name = "completeness"

    def columns(self, c, kind):
        return {"count": F.count(F.lit(1)), "unknown": _nulls(c)}


class StatisticsProbe(Probe):
    """min, max, sum, count of records and average; ``compat`` divides by all records, nulls included."""

    name = "statistics"

    def __init__(self, compat: bool = False):
        self.compat = compat

    def columns(self, c, kind):
        average = F.sum(c) / F.count(F.lit(1)) if self.compat else F.avg(c)
        return {"min": F.min(c), "max": F.max(c), "sum": F.sum(c), "count": F.count(F.lit(1)), "average": average}


class DistinctProbe(Probe):
    """The values, null left out, and whether there are more than the threshold; with one, the least so many are kept.

    With a threshold the values are the first ones of an order over the distinct ones, of which each task keeps so many; without
    one all are gathered, as asked.
    """

    name = "distinct"

    def __init__(self, threshold: int | None = None):
        self.threshold = threshold

    def columns(self, c, kind):
        n = F.count_distinct(c)
        if not self.threshold:
            return {"values": F.sort_array(F.collect_set(c)), "overflow": F.lit(False), "count": n}
        return {"overflow": n > self.threshold, "count": n}

    def tables(self, df, name):
        if not self.threshold:
            return {}
        least = df.select(column(df, name).alias("v")).filter("v is not null").distinct().orderBy("v").limit(self.threshold)
        return {"values": least.agg(F.sort_array(F.collect_list("v")))}


def _types(c: Column, kind: T.DataType) -> Column:
    """The storage type of each value: of a variant its own, ``null`` where there is none; of other columns that of the column."""
    if not isinstance(kind, T.VariantType):
        return F.when(c.isNull(), "null").otherwise(F.lit(storage_of(kind)))
    name = F.regexp_extract(F.schema_of_variant(c), r"^\w+", 0)
    named = F.when(name.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer").when(name.isin("DOUBLE", "FLOAT", "DECIMAL"), "float")
    named = named.when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name.isin("DATE", "TIMESTAMP", "TIMESTAMP_NTZ"), "date")
    named = named.when(name == "ARRAY", "array").when(name.isin("VOID", ""), "null").otherwise("unknown")
    return F.when(c.isNull(), "null").otherwise(named)


class StorageTypeProbe(Probe):
    """The set of ``types`` that values have, null as one; the ``type`` that all others have, if it is one, and whether it is
    ``unique``. A column that is no variant has the type of the column. There are no more types than storage types."""

    name = "storage_type"

    def columns(self, c, kind):
        types = F.array_sort(F.collect_set(_types(c, kind)))
        if not isinstance(kind, T.VariantType):
            return {"type": F.first(F.lit(storage_of(kind))), "unique": F.lit(True), "types": types}
        real = F.array_remove(types, "null")
        return {"type": F.when(F.size(real) == 1, real[0]), "unique": F.size(real) == 1, "types": types}


class FieldTypeProbe(Probe):
    """Types as ``StorageTypeProbe`` has them, and the numbers of nulls and empty strings; a variant's own ones count, too."""

    name = "field_type"

    def columns(self, c, kind):
        found = {k: v for k, v in StorageTypeProbe().columns(c, kind).items() if k != "unique"}
        variant = isinstance(kind, T.VariantType)
        nulls = F.count_if(_types(c, kind) == "null") if variant else _nulls(c)
        empties = F.count_if(F.try_variant_get(c, "$", "string") == "") if variant else _empties(c, kind)
        return {**found, "null_count": nulls, "empty_string_count": empties}


def value_types(df: DataFrame, field: str) -> DataFrame:
    """A row per key of the objects in a field of JSON text, or of variants: key, value_count, null_count, empty_string_count,
    storage_types (sorted) and unique_storage_type. Records that hold no object count under the key null, by their own type;
    text that is no JSON has the type ``unknown``."""
    require_batch(df, "types of values")
    name = require(df, [field])[0]
    kind, c = df.schema[name].dataType, column(df, name)
    if not isinstance(kind, (T.StringType, T.VariantType)):
        raise FieldError(f"{name!r} holds neither text nor variants")
    slim = df.select((F.try_parse_json(c) if isinstance(kind, T.StringType) else c).alias("v"), c.isNull().alias("absent"))
    slim = slim.withColumn("object", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    # Every row of the function has a key, so that a record without an object has one row, of itself.
    inner = slim.filter("object").lateralJoin(slim.sparkSession.tvf.variant_explode(F.col("v").outer()))
    each = inner.select("key", F.col("value"), F.lit(True).alias("json"))
    own = slim.filter("NOT object").select(F.lit(None).cast("string").alias("key"), F.col("v").alias("value"), (F.col("v").isNotNull() | F.col("absent")).alias("json"))
    both = each.unionAll(own)
    marked = both.withColumn("type", F.when(F.col("json"), _types(F.col("value"), T.VariantType())).otherwise("unknown")).withColumn("empty", F.coalesce(F.try_variant_get("value", "$", "string") == "", F.lit(False)) & (F.col("type") == "string"))
    types = F.array_sort(F.collect_set("type"))
    return marked.groupBy("key").agg(
        F.count("*").alias("value_count"), F.count_if(F.col("type") == "null").alias("null_count"), F.count_if("empty").alias("empty_string_count"), types.alias("storage_types"), F.when(F.size(types) == 1, types[0]).alias("unique_storage_type")
    )


class ValueTypeProbe(Probe):
    """How many values could be read as each storage type: an extension."""

    name = "value_type"

    def columns(self, c, kind):
        return {s: F.count(c.cast("string").try_cast(SPARK_TYPES[s])) for s in ("integer", "float", "boolean", "date")}


class MultiProbe(Probe):
    name = "multi"

    def __init__(self, *probes: Probe):
        self.probes = probes

    def columns(self, c, kind):
        return {f"{p.name}_{k}": v for p in self.probes for k, v in p.columns(c, kind).items()}

    def tables(self, df, name):
        return {f"{p.name}_{k}": v for p in self.probes for k, v in p.tables(df, name).items()}


ProbeSet = MultiProbe


def probe(df: DataFrame, probes: Iterable[Probe], fields: Iterable | None = None) -> DataFrame:
    """One row: for each field and probe, columns <field>_<probe>_<result>, all but values up to a threshold from one pass."""
    require_batch(df, "probing")
    names = require(df, fields) if fields is not None else df.columns
    found = MultiProbe(*probes)
    out = df.agg(*(v.alias(f"{n}_{k}") for n in names for k, v in found.columns(column(df, n), df.schema[n].dataType).items()))
    for n in names:
        for k, made in found.tables(df, n).items():
            # One row each.
            out = out.crossJoin(F.broadcast(made.toDF(f"{n}_{k}")))
    return out
