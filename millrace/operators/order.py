"""Places of records in an order over a whole table, without bringing all of them into one task.

Records are sorted by range into partitions and written to the shared folder; what depends on the partitions before (their
counts, sums, or last keys) is a row per partition, which is summed up and sent to all.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.session import shared_dir

#: Columns that these functions add, and their callers drop.
PART, INDEX, PLACE, TOTAL = "_part", "_index", "_place", "_total"


def _before() -> WindowSpec:
    """The partitions before, over tables of a row per partition."""
    return Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a stored table, for several readers."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_rows(df: DataFrame, keys: Sequence[Column], **columns: Column) -> DataFrame:
    """``df`` with its partition in the order, its number there from 0, and ``columns``; a stored table, so that every
    reader sees the same partitions and a lost executor costs no sorting."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sorted-{uuid.uuid4().hex}"
    at = df.withColumns(columns).orderBy(*keys).withColumn(INDEX, F.monotonically_increasing_id())
    at = at.withColumn(PART, F.shiftright(INDEX, 33)).withColumn(INDEX, F.col(INDEX).bitwiseAND((1 << 33) - 1))
    at.write.parquet(path)
    return spark.read.schema(at.schema).parquet(path)


def numbered(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """``df`` with each record's place from 1, and the number of all."""
    at = sorted_rows(df, keys)
    counts = at.groupBy(PART).agg(F.max(INDEX).alias("_n"))
    counts = counts.select(PART, (F.coalesce(F.sum(F.col("_n") + 1).over(_before()), F.lit(0)) + 1).alias("_start"), F.sum(F.col("_n") + 1).over(Window.partitionBy(F.lit(0))).alias(TOTAL))
    return at.join(F.broadcast(counts), PART).withColumn(PLACE, F.col("_start") + F.col(INDEX)).drop(PART, INDEX, "_start")


def ranked(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with each record's rank by falling value. Only values and how often they occur are sorted; a value that most
    records have is one row of a join, whose other side is split as any skewed key."""
    marked = df.withColumn("_value", value)
    counts = marked.groupBy("_value").agg(F.count("*").alias("_n"))
    placed = running(counts, [F.col("_value").desc()], F.col("_n"), "_so_far", TOTAL)
    ranks = placed.select(F.col("_value").alias("_v"), (F.col("_so_far") - F.col("_n") + 1).cast("int").alias(name))
    return marked.join(ranks, F.col("_value").eqNullSafe(F.col("_v"))).drop("_value", "_v")


def running(df: DataFrame, keys: Sequence[Column], value: Column, so_far: str, total: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to each record in the order, and that of all."""
    at = sorted_rows(df, keys, _added=value)
    sums = at.groupBy(PART).agg(F.sum("_added").alias("_sum"))
    sums = sums.select(PART, F.coalesce(F.sum("_sum").over(_before()), F.lit(0)).alias("_start"), F.sum("_sum").over(Window.partitionBy(F.lit(0))).alias(total))
    inside = F.sum("_added").over(Window.partitionBy(PART).orderBy(INDEX).rowsBetween(Window.unboundedPreceding, 0))
    out = at.withColumn("_inside", inside).join(F.broadcast(sums), PART)
    return out.withColumn(so_far, F.when(F.col("_inside").isNotNull() | (F.col("_start") != 0), F.col("_start") + F.coalesce("_inside", F.lit(0)))).drop(PART, INDEX, "_added", "_inside", "_start")


def accumulated(df: DataFrame, keys: Sequence[Column], before: dict[str, tuple[Callable, Column]], after: dict[str, tuple[Callable, Column]] | None = None) -> DataFrame:
    """``df`` with each record's place from 1 and, by name, the sum, least or largest (F.sum, F.min, F.max) of a value over the
    records up to it or, ``after``, from it on."""
    every = before | (after or {})
    at = sorted_rows(df, keys, **{f"_v{i}": c for i, (_, c) in enumerate(every.values())})
    earlier, later = _before(), Window.orderBy(PART).rowsBetween(1, Window.unboundedFollowing)
    parts = at.groupBy(PART).agg((F.max(INDEX) + 1).alias("_n"), *(f(f"_v{i}").alias(f"_a{i}") for i, (f, _) in enumerate(every.values())))
    others = [f(f"_a{i}").over(earlier if n in before else later).alias(f"_o{i}") for i, (n, (f, _)) in enumerate(every.items())]
    parts = parts.select(PART, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + 1).alias("_start"), *others)
    # Backward, for what comes after: a frame that ends with the last record is read anew for each one.
    up, on = (Window.partitionBy(PART).orderBy(c).rowsBetween(Window.unboundedPreceding, 0) for c in (F.col(INDEX), F.col(INDEX).desc()))
    united = {F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), F.min: F.least, F.max: F.greatest}
    out = at.withColumns({f"_i{i}": f(f"_v{i}").over(up if n in before else on) for i, (n, (f, _)) in enumerate(every.items())})
    out = out.join(F.broadcast(parts), PART).withColumn(PLACE, F.col("_start") + F.col(INDEX))
    return out.select(*df.columns, PLACE, *(united[f](F.col(f"_i{i}"), F.col(f"_o{i}")).alias(n) for i, (n, (f, _)) in enumerate(every.items())))


def lagged(df: DataFrame, group: Column, keys: Sequence[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the ``value`` of the record before each one in the order of ``keys``, among records of the same ``group``.
    A hot group is many ranges."""
    at = sorted_rows(df, [group, *keys], _k=group, _value=value)
    here = F.struct(F.col("_k").alias("of"), F.col("_value").alias("is"))
    lasts = at.groupBy(PART).agg(F.max_by(here, INDEX).alias("_last")).select(PART, F.lag("_last").over(Window.orderBy(PART)).alias("_last"))
    out = at.withColumn("_before", F.lag(here).over(Window.partitionBy(PART).orderBy(INDEX))).join(F.broadcast(lasts), PART)
    found = F.when(F.col(INDEX) == 0, F.col("_last")).otherwise(F.col("_before"))
    return out.withColumn(name, F.when(found["of"].eqNullSafe(F.col("_k")), found["is"])).drop(PART, INDEX, "_before", "_last", "_k", "_value")


def firsts_marked(df: DataFrame, names: Sequence[Column], keys: Sequence[Column], mark: str) -> DataFrame:
    """``df`` with whether a record is the first of its ``names`` in the order of ``keys``. A hot key is many ranges."""
    held = {f"_k{i}": c for i, c in enumerate(names)}
    key = F.struct(*held)
    at = sorted_rows(df, [*names, *keys], **held)
    lasts = at.groupBy(PART).agg(F.max_by(key, INDEX).alias("_last")).select(PART, F.lag("_last").over(Window.orderBy(PART)).alias("_last"))
    before = F.lag(key).over(Window.partitionBy(PART).orderBy(INDEX))
    out = at.withColumn("_before", before).join(F.broadcast(lasts), PART)
    return out.withColumn(mark, ~key.eqNullSafe(F.when(F.col(INDEX) == 0, F.col("_last")).otherwise(F.col("_before")))).drop(PART, INDEX, "_before", "_last", *held)


def moving(df: DataFrame, keys: Sequence[Column], before: int, after: int, columns: dict[str, Column], rows: int = 1 << 16) -> DataFrame:
    """``df`` with aggregates over the records from ``before`` to ``after`` places away (negative: before), in one order of all.

    Places are dealt to blocks of ``rows``, or as many as a frame has; a record goes to its own block and to those whose frames
    reach it, so that each block is a window of its own and no more than frames' ends move twice.
    """
    at = numbered(df, keys)
    size = max(rows, abs(before) + abs(after) + 1)
    block = lambda c: F.floor(c / F.lit(size)).cast("bigint")
    # A record at place p is in the frames of the records from p - after to p - before.
    first, last = block(F.least(F.col(PLACE), F.col(PLACE) - after)), block(F.greatest(F.col(PLACE), F.col(PLACE) - before))
    dealt = at.withColumn("_block", F.explode(F.sequence(F.greatest(first, block(F.lit(1))), F.least(last, block(F.col(TOTAL))))))
    over = Window.partitionBy("_block").orderBy(PLACE).rowsBetween(before, after)
    made = dealt.withColumns({n: c.over(over) for n, c in columns.items()})
    return made.filter(F.col("_block") == block(F.col(PLACE))).drop("_block", PLACE, TOTAL)


def carried(df: DataFrame, group: Sequence[Column], keys: Sequence[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the last ``value`` that isn't null up to each record, among records of the same ``group``, in the order of
    ``keys``. Records are sorted by group and keys into ranges, so that a large group is many of them; what a range ends with
    is a row that is handed on to the next ones."""
    held = {f"_k{i}": c for i, c in enumerate(group)}
    same = F.struct(*held) if held else F.struct(F.lit(0).alias("_k"))
    at = sorted_rows(df, [*group, *keys], **held, _value=value)
    kept = F.when(F.col("_value").isNotNull(), F.struct(same.alias("of"), F.col("_value").alias("is")))
    ends = at.groupBy(PART).agg(F.max_by(kept, F.when(F.col("_value").isNotNull(), F.col(INDEX))).alias("_end"))
    ends = ends.select(F.col(PART).alias("_p"), F.last("_end", ignorenulls=True).over(_before()).alias("_end"))
    inside = Window.partitionBy(PART).orderBy(INDEX).rowsBetween(Window.unboundedPreceding, 0)
    joined = at.withColumn("_inside", F.last(kept, ignorenulls=True).over(inside)).join(F.broadcast(ends), F.col(PART) == F.col("_p"))
    found = F.coalesce("_inside", "_end")
    return joined.withColumn(name, F.when(found["of"].eqNullSafe(same), found["is"])).drop(PART, INDEX, "_p", "_end", "_inside", "_value", *held)


#: Bins of a histogram of random keys, as bits.
_BINS = 16


def cut_off(df: DataFrame, key: Column, size: int) -> float | None:
    """The largest of the ``size`` least keys, which are from 0 to 1, by histograms ever finer about the place of the cut, one
    scan each; None if there are no more keys than that."""
    low, width, left = 0.0, 1.0, size
    keyed = df.select(key.alias("k"))
    while True:
        step = width / (1 << _BINS)
        inside = keyed.filter((F.col("k") >= low) & (F.col("k") < low + width))
        bins = {r.b: r.n for r in inside.groupBy(F.least(F.floor((F.col("k") - low) / step), F.lit((1 << _BINS) - 1)).alias("b")).agg(F.count("*").alias("n")).collect()}
        if width == 1.0 and sum(bins.values()) <= size:
            return None
        for b in sorted(bins):
            if bins[b] >= left:
                break
            left -= bins[b]
        low, width = low + b * step, step
        # Few keys are left, or no finer bins: these few are looked at themselves. Bins may differ by rounding at their ends.
        if bins[b] <= 1 << _BINS or width < 2.0**-48:
            near = sorted(r.k for r in keyed.filter((F.col("k") >= low - width) & (F.col("k") < low + 2 * width)).collect())
            before = keyed.filter(F.col("k") < low - width).count()
            return near[size - before - 1]
