"""Record operators: selection, sampling, distinct records, appending, merging and aggregation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import FieldError, StreamError
from millrace.functions.expressions import translate
from millrace.operators import order
from millrace.operators.fields import call
from millrace.schema import FieldMap, column, named, require
from millrace.streaming.limits import require_batch


def _filtered(df: DataFrame, condition: Column, discard: bool) -> DataFrame:
    """Records for which the condition is true; with ``discard`` all others, those of which it is null as well."""
    return df.filter(~F.coalesce(condition.cast("boolean"), F.lit(False))) if discard else df.filter(condition.cast("boolean"))


def select(df: DataFrame, condition: str | Callable | Column | None = None, discard: bool = False, compat: bool = False) -> DataFrame:
    """Records that meet an expression, a column or a callable over the record; without a condition all."""
    if condition is None:
        return df.limit(0) if discard else df
    if isinstance(condition, Column):
        made = condition
    elif callable(condition):
        made = call(condition, df, df.columns, T.BooleanType())
    else:
        made = translate(condition, df, compat)
    return _filtered(df, made, discard)


def function_select(df: DataFrame, function: Callable, fields: Iterable, discard: bool = False, **kwargs) -> DataFrame:
    """Records for which a function of some fields, by position, is true. One that returns a column stays native."""
    return _filtered(df, call(function, df, require(df, fields), T.BooleanType(), by_name=False, **kwargs), discard)


def set_select(df: DataFrame, field: str, value_set: Iterable, discard: bool = False) -> DataFrame:
    """Records whose value is in a set; None is a value like others."""
    c = column(df, field)
    values = list(value_set)
    known = [v for v in values if v is not None]
    found = F.coalesce(c.isin(known), F.lit(False)) if known else F.lit(False)
    if None in values:
        found = found | c.isNull()
    return df.filter(~found if discard else found)


def _ordered(df: DataFrame, order_by: Iterable | None) -> list[Column]:
    """Columns of an order; without one that of reading, which holds only within one source."""
    if not order_by:
        return [F.monotonically_increasing_id()]
    return [c if isinstance(c, Column) else column(df, c) for c in order_by]


SAMPLINGS = ("first", "random", "percent", "nth")


def sample(
    df: DataFrame,
    size: float = 1000,
    discard_sample: bool = False,
    method: str = "first",
    order_by: Iterable | None = None,
    seed: int = 0,
) -> DataFrame:
    """A sample of records, or with ``discard_sample`` the rest.

    ``first`` takes the first ``size`` in the given order, ``random`` that many at random (by random keys, whose cut-off is found
    first where each read of the table is the same, else by sorting), ``percent`` each with that chance, ``nth`` (an extension) every ``size``-th. The same seed takes the same records of the same partitions.
    """
    if method not in SAMPLINGS:
        raise FieldError(f"unknown sampling {method!r}")
    if method == "percent":
        if not 0 <= size <= 100:
            raise ValueError("a percentage is from 0 to 100")
        chance = F.rand(seed) < size / 100
        return df.filter(~chance if discard_sample else chance)
    size = int(size)
    if size < 0 or (method == "nth" and size < 1):
        raise ValueError(f"a sample of {size}")
    if method == "first" and not order_by and not discard_sample:
        return df.limit(size)
    require_batch(df, f"sampling by {method}")
    if method == "random" and (size == 0 or _scanned(df)):
        return _at_random(df, size, discard_sample, seed)
    keys = [F.rand(seed)] if method == "random" else _ordered(df, order_by)
    if method != "nth" and not discard_sample:
        return df.orderBy(*keys).limit(size)
    return _numbered(df, keys, lambda n: n % size == 0 if method == "nth" else n <= size, discard_sample)


def _scanned(df: DataFrame) -> bool:
    """Whether each read of ``df`` has the same records in the same order of the same partitions: no exchange, no Python."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Scan" in plan and not any(x in plan for x in ("Exchange", "Python", "Arrow", "Pandas", "InMemoryTableScan", "CollectLimit", "GlobalLimit"))


def _at_random(df: DataFrame, size: int, rest: bool, seed: int) -> DataFrame:
    """So many records at random, or all others, by the cut-off of random keys: no sort and no stored copy, a few scans of one
    column at most."""
    if not size:
        return df if rest else df.limit(0)
    names = [named(n) for n in df.columns]
    keyed = df.withColumn("_random", F.rand(seed))
    cut = order.cut_off(keyed, F.col("_random"), size)
    if cut is None:
        return df.limit(0) if rest else df
    taken = F.col("_random") <= cut
    return keyed.filter(~taken if rest else taken).select(*names)


def _numbered(df: DataFrame, keys: Sequence[Column], taken: Callable[[Column], Column], rest: bool) -> DataFrame:
    """Records whose place in an order is taken, or the others, without bringing all into one task.

    The sorted rows are a stored table, written here.
    """
    at = order.numbered(df, keys)
    kept = taken(F.col(order.PLACE))
    return at.filter(~kept if rest else kept).drop(order.PLACE, order.TOTAL)


def distinct(df: DataFrame, distinct_fields: Iterable | None = None, discard: bool = False, order_by: Iterable | None = None) -> DataFrame:
    """The first record of each key in an order, or with ``discard`` all but the first. Without keys records pass through.

    Without an order the first is any one of its key. The limit on the first row of a key runs before the exchange as well,
    so that a hot key is one row per task; for the others of a key all records are sorted by range, which splits a hot one.
    """
    names = require(df, distinct_fields or ())
    if not names:
        return df.limit(0) if discard else df
    if not discard and not order_by:
        return df.dropDuplicates(names)
    require_batch(df, "distinct records in an order")
    keys = [column(df, n) for n in names]
    if discard:
        return order.firsts_marked(df, keys, _ordered(df, order_by), "_is_first").filter("not _is_first").drop("_is_first")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*_ordered(df, order_by)))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def sort(df: DataFrame, order_by: Iterable, descending: bool | Sequence[bool] = False, limit: int | None = None) -> DataFrame:
    """Records in an order, or the first ``limit`` of it; a field in falling order where ``descending`` says so. An extension."""
    require_batch(df, "sorting")
    names = list(order_by)
    falling = [descending] * len(names) if isinstance(descending, bool) else list(descending)
    if len(falling) != len(names):
        raise FieldError("descending has a flag for each field, or one for all")
    keys = [c.desc() if d else c for c, d in zip(_ordered(df, names), falling)]
    ordered = df.orderBy(*keys)
    return ordered if limit is None else ordered.limit(int(limit))


MOVING = {"sum": F.sum, "average": F.avg, "min": F.min, "max": F.max, "count": F.count, "first": F.first, "last": F.last}


def moving(df: DataFrame, order_by: Iterable, measures: dict, before: int, after: int) -> DataFrame:
    """Append aggregates over a moving frame of records in one order of all: from ``before`` to ``after`` places away, negative
    ones before. ``measures`` has new names and (aggregation, field), or columns. An extension.

    The value so many places away is ``first`` of the frame that is that place only. No task has the whole order.
    """
    require_batch(df, "a moving frame")
    if before > after:
        raise FieldError("a frame ends before it begins")
    made = {n: m if isinstance(m, Column) else MOVING[m[0]](named(require(df, [m[1]])[0])) for n, m in measures.items()}
    return order.moving(df, _ordered(df, list(order_by)), before, after, made)


def intersect(*inputs: DataFrame, keep_all: bool = False) -> DataFrame:
    """Records of the first input that are in all others, each once, or as often as in all of them. An extension."""
    if not inputs:
        raise StreamError("intersect needs an input")
    return reduce(DataFrame.intersectAll if keep_all else DataFrame.intersect, inputs)


def subtract(*inputs: DataFrame, keep_all: bool = False) -> DataFrame:
    """Records of the first input that are in no other, each once, or as often as they are left over. An extension."""
    if not inputs:
        raise StreamError("except needs an input")
    return reduce(DataFrame.exceptAll if keep_all else DataFrame.subtract, inputs)


def append(*inputs: DataFrame) -> DataFrame:
    """All records of all inputs, by position, under the names of the first."""
    if not inputs:
        raise StreamError("append needs an input")
    return reduce(DataFrame.unionAll, inputs)


def append_by_name(*inputs: DataFrame, source_field: str | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """All records by field name; absent fields are null. ``source_field`` gets each input's name or number."""
    if not inputs:
        raise StreamError("append needs an input")
    labels = list(names) if names else [str(i) for i in range(len(inputs))]
    marked = [d.withColumn(source_field, F.lit(x)) if source_field else d for d, x in zip(inputs, labels)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def _tuple(key) -> list[str]:
    return [str(key)] if isinstance(key, str) or not isinstance(key, (list, tuple)) else [str(k) for k in key]


DUPLICATES = ("last", "first", "error", "expand")


def merge(
    inputs: Sequence[DataFrame],
    joins: Iterable,
    master: int = 0,
    maps: dict | None = None,
    how: str = "inner",
    duplicates: str = "last",
    order_by: dict[int, Iterable] | None = None,
) -> DataFrame:
    """Join a master with details on keys that may be several fields; nulls match nulls.

    ``joins`` has (input, master key[, detail key]); ``maps`` a field map per input, applied after joining. Of details with
    equal keys the last, or first, in ``order_by`` of that input stays (any one without an order); ``error`` makes the run
    fail on them, ``expand`` keeps all. Other values of ``how`` than inner are an extension. Whether a detail is broadcast is
    left to its size as Spark measures it.
    """
    if duplicates not in DUPLICATES:
        raise StreamError(f"unknown treatment of duplicates {duplicates!r}")
    maps = {int(k): FieldMap.of(v) for k, v in (maps or {}).items()}
    marked = {i: d.select(*(column(d, n).alias(f"_{i}_{k}") for k, n in enumerate(d.columns))) for i, d in enumerate(inputs)}
    at = lambda i, n: F.col(f"_{i}_{inputs[i].columns.index(require(inputs[i], [n])[0])}")
    out, joined = marked[master], {master}
    for given in joins:
        if not 2 <= len(given) <= 3:
            raise StreamError(f"a join has an input, a master key and perhaps a detail key: {given!r}")
        tag, master_key, detail_key = int(given[0]), _tuple(given[1]), _tuple(given[2] if len(given) == 3 else given[1])
        if tag == master:
            raise StreamError("the master can't be joined with itself")
        if tag not in marked or tag in joined:
            raise StreamError(f"no input {tag} to join")
        if len(master_key) != len(detail_key):
            raise StreamError(f"keys of different lengths: {master_key} and {detail_key}")
        detail = _one_per_key(marked[tag], inputs[tag], tag, detail_key, duplicates, (order_by or {}).get(tag))
        condition = reduce(lambda a, b: a & b, [at(master, m).eqNullSafe(at(tag, d)) for m, d in zip(master_key, detail_key)])
        out = out.join(detail, condition, how)
        if how not in ("semi", "left_semi", "anti", "left_anti"):
            joined.add(tag)
    columns = []
    for i in sorted(joined):
        m = maps.get(i, FieldMap())
        columns += [F.col(f"_{i}_{k}").alias(m.new_name(n), metadata=inputs[i].schema[n].metadata) for k, n in enumerate(inputs[i].columns) if m.keeps(n)]
    return out.select(*columns)


def _one_per_key(marked: DataFrame, original: DataFrame, tag: int, key: list[str], duplicates: str, order_by) -> DataFrame:
    if duplicates == "expand":
        return marked
    names = [f"_{tag}_{original.columns.index(require(original, [k])[0])}" for k in key]
    if duplicates == "error":
        n = F.count("*").over(Window.partitionBy(*names))
        return marked.withColumn("_n", n).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit(f"input {tag} has several records of one key"))).otherwise(F.col("_n"))).filter("_n >= 1").drop("_n")
    if not order_by:
        return marked.dropDuplicates(names)
    columns = [F.col(f"_{tag}_{original.columns.index(str(n))}") for n in order_by]
    order = [c.desc() for c in columns] if duplicates == "last" else columns
    return marked.withColumn("_n", F.row_number().over(Window.partitionBy(*names).orderBy(*order))).filter("_n = 1").drop("_n")


AGGREGATIONS = ("sum", "min", "max", "average")


def measured(df: DataFrame, measures: Iterable | None, default_aggregations: Iterable | None = None, compat: bool = False) -> list[Column]:
    """The aggregates of measures, each a name or (name, aggregations), as ``aggregate`` names them."""
    out: list[Column] = []
    for measure in measures or ():
        name, chosen = (measure, None) if isinstance(measure, str) or not isinstance(measure, (list, tuple)) else (measure[0], measure[1] if len(measure) > 1 else None)
        name = require(df, [name])[0]
        chosen = AGGREGATIONS if compat else [chosen] if isinstance(chosen, str) else list(chosen or default_aggregations or AGGREGATIONS)
        if odd := set(chosen) - set(AGGREGATIONS):
            raise FieldError(f"unknown aggregation {sorted(odd)}")
        c = column(df, name)
        zero = F.lit(0).cast(df.schema[name].dataType)
        whole = isinstance(df.schema[name].dataType, T.IntegralType)
        made = {
            "sum": F.sum(c),
            "min": F.least(zero, F.min(c)) if compat else F.min(c),
            "max": F.greatest(zero, F.max(c)) if compat else F.max(c),
            "average": F.floor(F.sum(c) / F.count("*")) if compat and whole else F.avg(c),
        }
        out += [made[a].alias(f"{name}_{a}") for a in AGGREGATIONS if a in chosen]
    return out


def aggregate(
    df: DataFrame,
    keys: Iterable | None = None,
    measures: Iterable | None = None,
    default_aggregations: Iterable | None = None,
    record_count_field: str = "record_count",
    grouping: str = "group",
    compat: bool = False,
) -> DataFrame:
    """Sum, min, max and average of measures by key, and the number of records; one row without keys, none without records.

    A measure is a name or (name, aggregations). ``grouping`` may be cube or rollup, an extension. ``compat`` starts minima and
    maxima at 0, floors averages of whole numbers and makes all four aggregations of each measure.
    """
    names = require(df, keys or ())
    out = measured(df, measures, default_aggregations, compat)
    out.append(F.count(F.lit(1)).alias(record_count_field))
    columns = [column(df, n) for n in names]
    if not names:
        return df.agg(*out).filter(F.col(record_count_field) > 0)
    grouped = {"group": df.groupBy, "cube": df.cube, "rollup": df.rollup}[grouping]
    return grouped(*columns).agg(*out)
