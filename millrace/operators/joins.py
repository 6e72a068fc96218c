"""Joins on order: the last match before a record, and points in intervals. Extensions of ``merge``, which joins equal keys."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import FieldError, StreamError
from millrace.operators import order
from millrace.schema import column, named, require
from millrace.session import ship_package
from millrace.streaming.limits import require_batch

#: Each level's cells are so many times as wide as those of the level below, and levels at most.
STEP, LEVELS = 16, 16
#: Places of a block, at least, and blocks at most, where pairs of places are counted.
BLOCK, BLOCKS = 1 << 16, 512


def free_names(left: DataFrame, names: Iterable[str], suffix: str) -> list[str]:
    """Names for the right side's columns, with the suffix where the left one has them."""
    taken = {n.lower() for n in left.columns}
    out = []
    for n in names:
        new = n if n.lower() not in taken else n + suffix
        if new.lower() in taken:
            raise FieldError(f"no name for {n!r} on the right side")
        taken.add(new.lower())
        out.append(new)
    return out


def as_of(
    left: DataFrame,
    right: DataFrame,
    at: str,
    by: Iterable = (),
    right_at: str | None = None,
    right_by: Iterable | None = None,
    direction: str = "backward",
    strict: bool = False,
    tolerance: Column | None = None,
    how: str = "left",
    order_by: Iterable = (),
    suffix: str = "_right",
) -> DataFrame:
    """Each record of ``left`` with the last one of ``right`` of the same keys that isn't later (``forward``: the first that
    isn't earlier; ``strict``: earlier, or later); of those at one time the last, or first, by ``order_by``.

    ``tolerance`` is how far away it may be. Nulls among keys match nulls; a null time matches nothing. Both sides are sorted
    together by key and time into ranges, and the last record of the right side is carried on from range to range: a key of
    most records is many ranges, and no pair of records is made that isn't a match.
    """
    require_batch(left, "an as-of join")
    if direction not in ("backward", "forward"):
        raise StreamError(f"unknown direction {direction!r}")
    if how not in ("left", "inner"):
        raise StreamError(f"an as-of join is left or inner, not {how!r}")
    keys, right_keys = require(left, by), require(right, right_by if right_by is not None else by)
    if len(keys) != len(right_keys):
        raise StreamError(f"keys of different lengths: {keys} and {right_keys}")
    time, right_time, ties = require(left, [at])[0], require(right, [right_at or at])[0], require(right, order_by)
    kept = [n for n in right.columns if n not in right_keys]
    names = free_names(left, kept, suffix)
    of_left = F.struct(*(column(left, n).alias(f"l{i}") for i, n in enumerate(left.columns)))
    of_right = F.struct(*(column(right, n).alias(f"r{i}") for i, n in enumerate(kept)), column(right, right_time).alias("t"))
    tie = F.struct(*(column(right, n).alias(f"o{i}") for i, n in enumerate(ties)), F.lit(0).alias("o"))
    one = left.select(*(column(left, k).alias(f"k{i}") for i, k in enumerate(keys)), column(left, time).alias("t"), F.lit(None).cast(right.select(tie.alias("x")).schema["x"].dataType).alias("tie"), of_left.alias("left"), F.lit(None).cast(right.select(of_right.alias("x")).schema["x"].dataType).alias("right"))
    two = right.filter(column(right, right_time).isNotNull()).select(
        *(column(right, k).alias(f"k{i}") for i, k in enumerate(right_keys)), column(right, right_time).alias("t"), tie.alias("tie"), F.lit(None).cast(one.schema["left"].dataType).alias("left"), of_right.alias("right")
    )
    both = one.unionAll(two)
    # At one time the right side comes first, unless it may not match.
    side = F.col("left").isNull() if strict else F.col("left").isNotNull()
    back = direction == "backward"
    sort = [F.col("t").asc_nulls_first() if back else F.col("t").desc_nulls_first(), side, F.col("tie") if back else F.col("tie").desc()]
    found = order.carried(both, [F.col(f"k{i}") for i in range(len(keys))], sort, F.col("right"), "match").filter("left IS NOT NULL")
    near = F.col("match").isNotNull() & F.col("t").isNotNull()
    if tolerance is not None:
        near = near & (F.col("t") - F.col("match.t") <= tolerance if back else F.col("match.t") - F.col("t") <= tolerance)
    near = F.coalesce(near, F.lit(False))
    chosen = found if how == "left" else found.filter(near)
    return chosen.select(
        *(F.col(f"left.l{i}").alias(n, metadata=left.schema[n].metadata) for i, n in enumerate(left.columns)),
        *(F.when(near, F.col(f"match.r{i}")).alias(new, metadata=right.schema[n].metadata) for i, (n, new) in enumerate(zip(kept, names))),
    )


def _number(c: Column, kind: T.DataType) -> Column:
    """A number in the order of the values, for cells; values themselves are compared as they are."""
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        # Without a zone, whose changes of the clock would break the order.
        return F.unix_date(c.cast("date")) * 86_400e6 + F.hour(c) * 3600e6 + F.minute(c) * 60e6 + F.extract(F.lit("SECOND"), c).cast("double") * 1e6
    raise FieldError(f"no intervals over {kind.simpleString()}")


def _inside(value: Column, low: Column, high: Column, closed: str) -> Column:
    return (value >= low if closed in ("left", "both") else value > low) & (value <= high if closed in ("right", "both") else value < high)


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    at: str,
    low: str,
    high: str,
    by: Iterable = (),
    interval_by: Iterable | None = None,
    closed: str = "left",
    how: str = "inner",
    width: float | None = None,
    suffix: str = "_right",
) -> DataFrame:
    """Each record of ``points`` with each of ``intervals`` (and of the same keys) that holds it; ``closed`` names the ends that
    belong to an interval: left, right, both or neither.

    Intervals are dealt to cells of levels whose width grows by ``STEP``: at the first level whose cells are no narrower than the
    interval it lies in two cells, or three where numbers are rounded, however long it is. A point is in one cell of each level
    that there is, so that each pair meets once, in a join on equal cells; a crowded cell is split as any skewed key. ``width``
    is that of the first level's cells; without it the median length, which a first job finds. Empty intervals and nulls match
    nothing. ``how``: inner, left or left_anti.
    """
    require_batch(points, "an interval join")
    require_batch(intervals, "an interval join")
    if closed not in ("left", "right", "both", "neither"):
        raise StreamError(f"unknown ends {closed!r}")
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise StreamError(f"unknown kind of interval join {how!r}")
    keys, other_keys = require(points, by), require(intervals, interval_by if interval_by is not None else by)
    at, low, high = require(points, [at])[0], *require(intervals, [low, high])
    names = free_names(points, intervals.columns, suffix)
    right = intervals.select(*(column(intervals, n).alias(f"i{k}") for k, n in enumerate(intervals.columns)))
    of = lambda n: F.col(f"i{intervals.columns.index(n)}")
    begin, end = (_number(of(n), intervals.schema[n].dataType) for n in (low, high))
    right = right.filter((of(low) <= of(high)) if closed == "both" else (of(low) < of(high)))
    long = end - begin
    if width is None:
        width = right.agg(F.percentile_approx(long, 0.5)).first()[0]
    width = float(width) if width and width > 0 else 1.0
    widths = [width * STEP**i for i in range(LEVELS)]
    level = F.lit(LEVELS - 1)
    for i in reversed(range(LEVELS - 1)):
        level = F.when(long <= widths[i], i).otherwise(level)
    level = level.cast("int")
    cell = lambda c, i: F.floor(c / F.element_at(F.array(*map(F.lit, widths)), i + 1))
    dealt = right.withColumn("level", level).withColumn("cell", F.explode(F.sequence(cell(begin, F.col("level")), cell(end, F.col("level")))))
    # At most LEVELS numbers.
    present = sorted(r.level for r in right.select(level.alias("level")).distinct().collect())
    left = points.select(*(column(points, n).alias(f"p{k}") for k, n in enumerate(points.columns)))
    place = F.col(f"p{points.columns.index(at)}")
    number = _number(place, points.schema[at].dataType)
    left = left.withColumn("_row", F.monotonically_increasing_id()) if how == "left" else left
    levels = F.explode(F.array(*map(F.lit, present)).cast("array<int>")).alias("at_level")
    met = left.filter(place.isNotNull()).select("*", levels).withColumn("at_cell", cell(number, F.col("at_level")))
    condition = (F.col("level") == F.col("at_level")) & (F.col("cell") == F.col("at_cell")) & _inside(place, of(low), of(high), closed)
    for a, b in zip(keys, other_keys):
        condition = condition & F.col(f"p{points.columns.index(a)}").eqNullSafe(of(b))
    here = [F.col(f"p{k}").alias(n, metadata=points.schema[n].metadata) for k, n in enumerate(points.columns)]
    there = [F.col(f"i{k}").alias(new, metadata=intervals.schema[n].metadata) for k, (n, new) in enumerate(zip(intervals.columns, names))]
    if how == "inner":
        return met.join(dealt, condition).select(*here, *there)
    # What a point matches at one level only still matches: pairs first, then the points that have none.
    if how == "left":
        pairs = met.join(dealt, condition, "left")
        matched = F.max(F.col("level").isNotNull()).over(Window.partitionBy("_row"))
        marked = pairs.withColumn("_any", matched).filter(F.col("level").isNotNull() | (~F.col("_any") & (F.col("at_level") == (present[0] if present else 0))))
        alone = left if not present else left.filter(place.isNull())
        empty = [F.lit(None).cast(intervals.schema[n].dataType).alias(new) for n, new in zip(intervals.columns, names)]
        return marked.select(*here, *there).unionAll(alone.select(*here, *empty))
    kind = "left_semi" if how == "left_semi" else "left_anti"
    if not present:
        return left.select(*here) if kind == "left_anti" else left.limit(0).select(*here)
    # A semi join of all levels as one array of cells a point would need a row each again: semi joins in turn, one a level.
    out = left
    halves = []
    for i in present:
        one = dealt.filter(F.col("level") == i)
        on = (F.col("cell") == cell(number, F.lit(i))) & _inside(place, of(low), of(high), closed)
        for a, b in zip(keys, other_keys):
            on = on & F.col(f"p{points.columns.index(a)}").eqNullSafe(of(b))
        halves.append(out.join(one, on, "left_semi"))
        out = out.join(one, on, "left_anti")
    if kind == "left_anti":
        return out.select(*here)
    whole = halves[0]
    for more in halves[1:]:
        whole = whole.unionAll(more)
    return whole.select(*here)


def overlap_join(a: DataFrame, b: DataFrame, low: str, high: str, by: Iterable = (), other_low: str | None = None, other_high: str | None = None, other_by: Iterable | None = None, width: float | None = None, suffix: str = "_right") -> DataFrame:
    """Pairs of intervals [low, high) of ``a`` and ``b`` that overlap (and have the same keys), each once: either the one of
    ``b`` holds the beginning of the one of ``a``, or begins inside of it, later."""
    other_low, other_high = other_low or low, other_high or high
    mine, theirs = require(a, [low, high]), require(b, [other_low, other_high])
    names = free_names(a, b.columns, suffix)
    keys, other_keys = list(by), list(other_by if other_by is not None else by)
    full_a, full_b = a.filter(column(a, mine[0]) < column(a, mine[1])), b.filter(column(b, theirs[0]) < column(b, theirs[1]))
    one = interval_join(full_a, full_b, mine[0], *theirs, by=keys, interval_by=other_keys, width=width, suffix=suffix)
    back = interval_join(full_b, full_a, theirs[0], *mine, by=other_keys, interval_by=keys, closed="neither", width=width, suffix="\0")
    return one.unionAll(back.select(*(named(c) for c in back.columns[len(b.columns) :]), *(named(c) for c in back.columns[: len(b.columns)])).toDF(*a.columns, *names))


def below(x: np.ndarray, y: np.ndarray, most_x: np.ndarray, most_y: np.ndarray) -> np.ndarray:
    """How many points (x, y) are less in both than each (most_x, most_y): the bits of the ranks of y, the highest first, in the
    order of x; each bit splits what is left of a prefix in two."""
    by_x = np.argsort(x, kind="stable")
    ranks = np.empty(len(y), np.int64)
    ranks[np.argsort(y, kind="stable")] = np.arange(len(y))
    left, limit = ranks[by_x], np.searchsorted(np.sort(y), most_y)
    begin, end = np.zeros(len(most_x), np.int64), np.searchsorted(x[by_x], most_x)
    found = np.zeros(len(most_x), np.int64)
    for bit in reversed(range(len(y).bit_length())):
        high = (left >> bit & 1).astype(bool)
        lows = np.concatenate([[0], np.cumsum(~high)])
        a, b, up = lows[begin], lows[end], (limit >> bit & 1).astype(bool)
        found += np.where(up, b - a, 0)
        begin, end = np.where(up, lows[-1] + begin - a, a), np.where(up, lows[-1] + end - b, b)
        left = np.concatenate([left[~high], left[high]])
    return found


def _dominated(points: DataFrame, asked: DataFrame, total: int, block: int | None = None) -> DataFrame:
    """``asked`` (pairs of places x and y, all different) with ``n``: how many of ``points`` (x, y; y is 0 or another's x) are
    less in both. Rows of one pair may be several, whose ``n`` add up.

    Places are dealt to blocks. Points whose blocks are both before those of a pair are counted by a table of the counts of
    blocks, of at most ``BLOCKS`` squared rows; those of the same block of x, or of an earlier one and the same of y, in a
    task for that block, which has no more rows than it has places.
    """
    ship_package(points.sparkSession)
    size = block or max(BLOCK, -(-(total + 1) // BLOCKS))
    at = lambda c: F.floor(F.col(c) / F.lit(size)).cast("int")
    points = points.withColumns({"bx": at("x"), "by": F.when(F.col("y") > 0, at("y")).otherwise(-1)})
    asked = asked.withColumns({"bx": at("x"), "by": at("y")})
    sides = []
    for rows, ask in ((points, False), (asked, True)):
        one = lambda axis, b, x: F.struct(F.lit(axis).alias("axis"), F.col(b).alias("block"), F.col(x).cast("bigint").alias("p"), "x", "y", F.lit(ask).alias("ask"))  # noqa: B023, E731
        sides.append(rows.select(F.inline(F.array(one(0, "bx", "x"), one(1, "by", "bx")))).filter("block >= 0"))
    kind = "x bigint, y bigint, n bigint"

    def count(table: pa.Table) -> pa.Table:
        p, x, y, ask = (table.column(c).to_numpy() for c in ("p", "x", "y", "ask"))
        return pa.table({"x": x[ask], "y": y[ask], "n": below(p[~ask], y[~ask], p[ask], y[ask])})

    near = sides[0].unionAll(sides[1]).groupBy("axis", "block").applyInArrow(count, kind)
    blocks = points.sparkSession.range(total // size + 1).select(F.col("id").cast("int").alias("b"))
    cells = blocks.withColumnRenamed("b", "bx").crossJoin(blocks.select(F.col("b").alias("by")).unionAll(points.sparkSession.range(1).select(F.lit(-1).alias("by"))))
    counted = cells.join(points.groupBy("bx", "by").agg(F.count("*").alias("_c")), ["bx", "by"], "left").fillna(0, ["_c"])
    before = lambda of, by: F.coalesce(F.sum("_c").over(Window.partitionBy(of).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = counted.withColumn("_c", before("by", "bx")).withColumn("_c", before("bx", "by"))
    far = asked.join(summed, ["bx", "by"]).select("x", "y", F.col("_c").cast("bigint").alias("n"))
    return near.unionAll(far)


def interval_statistics(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, distinct: str | None = None, names: Iterable[str] = ("records", "first", "last", "distinct"), block: int | None = None) -> DataFrame:
    """Each of ``intervals`` [low, high) that holds any of ``points``, with their number, the first and last place, and how
    many values of the field ``distinct`` they have, nulls apart: an ``interval_join`` and totals without any pair.

    Points and ends are sorted together once. What is before an end is counted there. The values of an interval are the points
    in it whose last point of the same value lies before it, or that have none; see ``_dominated``.
    """
    require_batch(points, "interval statistics")
    require_batch(intervals, "interval statistics")
    at, low, high = require(points, [at])[0], *require(intervals, [low, high])
    names = free_names(intervals, list(names)[: 4 if distinct else 3], "_points")
    lo, hi = column(intervals, low), column(intervals, high)
    ends = intervals.filter(lo < hi).select(lo.alias("low"), hi.alias("high")).distinct()
    ends = ends.select("low", "high", F.inline(F.array(F.struct(F.col("low").alias("t"), F.lit(1).alias("kind")), F.struct(F.col("high").alias("t"), F.lit(2).alias("kind")))))
    value = column(points, require(points, [distinct])[0]) if distinct else F.lit(None).cast("int")
    none = lambda n: F.lit(None).cast(ends.schema[n].dataType).alias(n)
    placed = points.filter(column(points, at).isNotNull()).select(none("low"), none("high"), column(points, at).alias("t"), F.lit(3).alias("kind"), value.alias("value"))
    both = placed.unionAll(ends.withColumn("value", F.lit(None).cast(placed.schema["value"].dataType)))
    point = F.col("kind") == 3
    before = {"_n": (F.sum, F.when(point, 1).otherwise(0)), "_filled": (F.sum, F.when(point & F.col("value").isNotNull(), 1).otherwise(0)), "_last": (F.max, F.when(point, F.col("t")))}
    # Ends come before points of the same time: the place of an end is after all earlier points, and before all others.
    found = order.accumulated(both, [F.col("t"), point], before, {"_next": (F.min, F.when(point, F.col("t")))})
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    held = found.filter(~point).groupBy("low", "high").agg(
        (of(2, "_n") - of(1, "_n")).alias("_n"), of(1, "_next").alias("_first"), of(2, "_last").alias("_last"), of(1, "_filled").alias("_before"), of(2, order.PLACE).alias("x"), of(1, order.PLACE).alias("y")
    ).filter("_n > 0")
    made = ["_n", "_first", "_last"]
    if distinct:
        held = order.kept(held, "intervals")
        total = found.count()
        seen = order.lagged(found.filter(point & F.col("value").isNotNull()).select("value", F.col(order.PLACE).alias("x")), F.col("value"), [F.col("x")], F.col("x"), "y")
        pairs = _dominated(seen.select("x", F.coalesce("y", F.lit(0)).alias("y")), held.select("x", "y"), total, block)
        held = held.join(pairs.groupBy("x", "y").agg(F.sum("n").alias("_d")), ["x", "y"]).withColumn("_d", F.col("_d") - F.col("_before"))
        made.append("_d")
    held = held.select(F.col("low").alias("_low"), F.col("high").alias("_high"), *made)
    out = intervals.withColumns({"_a": lo, "_b": hi}).join(held, (F.col("_a") == F.col("_low")) & (F.col("_b") == F.col("_high")))
    return out.select(*(named(c) for c in intervals.columns), *(F.col(m).alias(n) for m, n in zip(made, names)))


def overlap_counts(a: DataFrame, b: DataFrame, low: str, high: str, by: Iterable = (), name: str = "overlaps") -> DataFrame:
    """Each interval [low, high) of ``a`` that isn't empty with how many of ``b`` (of the same keys; nulls match nulls) overlap
    it: those that begin before its end, less those that end by its beginning, each counted in one order of all ends."""
    require_batch(a, "overlap counts")
    require_batch(b, "overlap counts")
    keys, other_keys = require(a, by), require(b, by)
    name = free_names(a, [name], "_right")[0]
    mine, theirs = ([column(df, n) for n in require(df, [low, high])] for df in (a, b))
    key = lambda df, ns: F.struct(*(column(df, n).alias(f"k{i}") for i, n in enumerate(ns)), F.lit(0).alias("k"))
    ends = lambda df, ns, lo, hi, kinds: df.filter(lo < hi).select(key(df, ns).alias("key"), lo.alias("low"), hi.alias("high")).groupBy("key", "low", "high").agg(F.count("*").alias("n")).select(
        "*", F.inline(F.array(F.struct(F.col("high" if kinds[0] == 0 else "low").alias("t"), F.lit(kinds[0]).alias("kind")), F.struct(F.col("low" if kinds[0] == 0 else "high").alias("t"), F.lit(kinds[1]).alias("kind"))))
    )
    # At one time: the ends that ask for beginnings before it, beginnings (1) and ends (2), the beginnings that ask for ends by it.
    both = ends(a, keys, *mine, (0, 3)).unionAll(ends(b, other_keys, *theirs, (1, 2)))
    kind = F.col("kind")
    counted = order.accumulated(both, [F.col("key"), F.col("t"), kind], {"_begun": (F.sum, F.when(kind == 1, F.col("n")).otherwise(0)), "_ended": (F.sum, F.when(kind == 2, F.col("n")).otherwise(0))})
    # Keys before have as many beginnings as ends.
    found = counted.filter(kind.isin(0, 3)).groupBy("key", "low", "high").agg((F.max(F.when(kind == 0, F.col("_begun"))) - F.max(F.when(kind == 3, F.col("_ended")))).alias("_found"))
    found = found.select(F.col("key").alias("_key"), F.col("low").alias("_low"), F.col("high").alias("_high"), "_found")
    out = a.withColumns({"_k": key(a, keys), "_a": mine[0], "_b": mine[1]})
    same = F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_a") == F.col("_low")) & (F.col("_b") == F.col("_high"))
    return out.join(found, same).select(*(named(c) for c in a.columns), F.col("_found").alias(name))
