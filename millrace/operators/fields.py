"""Field operators: mapping, deriving, cleansing, thresholds and bins."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import FieldError
from millrace.functions import cleansing
from millrace.functions.expressions import translate
from millrace.operators import order
from millrace.schema import SPARK_TYPES, Field, FieldList, FieldMap, column, require, with_field
from millrace.streaming.limits import require_batch


def field_map(df: DataFrame, map_fields: dict | None = None, drop_fields: Iterable | None = None, keep_fields: Iterable | None = None) -> DataFrame:
    """Rename fields, and drop or keep some by their names on input."""
    return FieldMap(rename=map_fields, drop=drop_fields, keep=keep_fields).apply(df)


def call(function: Callable, df: DataFrame, names: Sequence[str], result: T.DataType, by_name: bool = True, **kwargs) -> Column:
    """The column of a callable: native if it takes columns and returns one, else called for each record of Arrow batches.

    ``by_name`` passes fields as keyword arguments, else by position.
    """
    columns = [column(df, n) for n in names]
    try:
        made = function(**dict(zip(names, columns)), **kwargs) if by_name else function(*columns, **kwargs)
        if isinstance(made, Column):
            return made
    except (TypeError, ValueError, AttributeError, PySparkException):  # what columns raise where values are wanted
        pass

    def each(*values):
        return function(**dict(zip(names, values)), **kwargs) if by_name else function(*values, **kwargs)

    return F.udf(each, result, useArrow=True)(*columns)


def derive(
    df: DataFrame,
    formula: str | Callable | Column | None = None,
    field_name: str = "new_field",
    analytical_type: str | None = None,
    storage_type: str = "unknown",
    compat: bool = False,
) -> DataFrame:
    """Append a field made by an expression, a column or a callable over the record; no formula makes nulls.

    A callable that returns a column stays native; another is called for each record and needs a storage type.
    """
    kind = SPARK_TYPES[storage_type]
    if formula is None:
        value = F.lit(None).cast(kind)
    elif isinstance(formula, Column):
        value = formula
    elif callable(formula):
        value = call(formula, df, df.columns, kind)
    else:
        value = translate(formula, df, compat)
    if storage_type != "unknown":
        value = value.cast(kind)
    like = Field(field_name, storage_type=storage_type, analytical_type=None if analytical_type == "unknown" else analytical_type)
    return with_field(df, field_name, value, like if storage_type != "unknown" or like.analytical_type != "typeless" else None)


def value_threshold(
    df: DataFrame,
    thresholds: Iterable,
    bin_names: Sequence[str] | None = None,
    prefix: str | None = None,
    suffix: str | None = None,
    compat: bool = False,
) -> DataFrame:
    """Append a bin name per (field[, low[, high]]): below low the first, above high the last, else the middle one.

    With one threshold, values from it on get the last bin. A null has no bin. ``compat`` lets the second test of two
    overwrite the first, so that low values are called middle ones.
    """
    bins = list(bin_names or ("low", "medium", "high"))
    out = df
    for given in thresholds:
        name, *limits = (given,) if isinstance(given, str) else tuple(given)
        if len(limits) > 2:
            raise FieldError(f"a threshold has one or two limits, not {len(limits)}")
        require(df, [name])
        v = column(df, name)
        if len(limits) < 2:
            binned = F.when(v < (limits[0] if limits else 0), bins[0]).when(v.isNotNull(), bins[-1])
        else:
            low, high = limits
            if len(bins) < 3:
                raise FieldError("two limits need three bin names")
            binned = F.when(v > high, bins[-1]) if compat else F.when(v < low, bins[0]).when(v > high, bins[-1])
            binned = binned.when(v.isNotNull(), bins[1])
        new = f"{prefix or ''}{name}{'_bin' if suffix is None else suffix}"
        out = with_field(out, new, binned, Field(new, storage_type="string", analytical_type="set"))
    return out


def text_substitute(df: DataFrame, field: str, substitutions: Iterable[tuple[str, str]] = (), derived_field: str | None = None) -> DataFrame:
    """Replace all matches, rule after rule, in place or into a new field."""
    require(df, [field])
    return with_field(df, derived_field or field, cleansing.substitute(column(df, field), substitutions), df.schema[field])


def _of_type(df: DataFrame, *storage_types: str) -> list[str]:
    return [f.name for f in FieldList.of_schema(df.schema) if f.storage_type in storage_types and isinstance(df.schema[f.name].dataType, T.StringType)]


def string_strip(df: DataFrame, fields: Iterable | None = None, chars: str | None = None) -> DataFrame:
    """Strip white space, or ``chars``, from both ends of fields; by default of all that are string or text."""
    names = require(df, fields) if fields is not None else _of_type(df, "string", "text")
    return df.select(*(cleansing.strip(column(df, n), chars).alias(n, metadata=df.schema[n].metadata) if n in names else column(df, n) for n in df.columns))


def coalesce_value_to_type(df: DataFrame, fields: Iterable | None = None, types: Iterable | None = None, empty_values: dict | None = None) -> DataFrame:
    """Bring fields to their storage types; what can't be is the type's empty value.

    ``fields`` are names or fields; by default all. ``types`` limits the storage types that are treated.
    """
    known = FieldList.of_schema(df.schema)
    wanted = {f.name: f for f in (FieldList(fields) if fields is not None else known)}
    require(df, wanted)
    empty, out = empty_values or {}, []
    for name in df.columns:
        c, f = column(df, name), wanted.get(name)
        storage = f.storage_type if f is not None and f.storage_type != "unknown" else known.field(name).storage_type
        if f is not None and (types is None or storage in types):
            is_text = isinstance(df.schema[name].dataType, T.StringType)
            if storage in ("string", "text"):
                c = cleansing.to_string(c, empty.get(storage))
            elif storage in ("integer", "float"):
                c = cleansing.to_number(c, storage, is_text, empty.get(storage))
        out.append(c.alias(name, metadata=df.schema[name].metadata))
    return df.select(*out)


BINNINGS = ("width", "count", "ntile", "ntile_sum", "rank")


def binning(df: DataFrame, field: str, method: str = "width", size: float = 1, derived_field: str | None = None, partition_by: Iterable = ()) -> DataFrame:
    """Append a bin: an extension, as the methods were only ever described.

    ``width`` is the start of the bin of a fixed width; ``count`` one of a fixed number of bins of equal width; ``ntile`` and
    ``ntile_sum`` one of ``size`` bins of equal numbers of records, or of equal sums; ``rank`` the rank by falling value.
    """
    require(df, [field])
    if method not in BINNINGS:
        raise FieldError(f"unknown binning {method!r}")
    v = column(df, field)
    new = derived_field or f"{field}_bin"
    if method == "width":
        return with_field(df, new, F.floor(v / size) * size)
    require_batch(df, f"binning by {method}")
    if method == "count":
        ends = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
        # One row of two numbers.
        joined = df.crossJoin(F.broadcast(ends))
        step = (F.col("_hi") - F.col("_lo")) / size
        binned = F.when(step == 0, F.lit(1).cast("bigint")).otherwise(F.least(F.floor((v - F.col("_lo")) / step) + 1, F.lit(int(size)).cast("bigint")))
        return joined.withColumn(new, F.when(v.isNotNull(), binned)).drop("_lo", "_hi")
    names = require(df, partition_by)
    if not names:
        return _binned_over_all(df, v, method, int(size), new)
    over = Window.partitionBy(*(column(df, n) for n in names))
    if method == "rank":
        return with_field(df, new, F.rank().over(over.orderBy(v.desc())))
    if method == "ntile":
        return with_field(df, new, F.ntile(int(size)).over(over.orderBy(v)))
    running = F.sum(v).over(over.orderBy(v).rowsBetween(Window.unboundedPreceding, 0))
    return with_field(df, new, _of_sums(running, F.sum(v).over(over), int(size)))


def _of_sums(running: Column, total: Column, bins: int) -> Column:
    return F.least(F.ceil(running / total * bins), F.lit(bins).cast("bigint"))


def _binned_over_all(df: DataFrame, v: Column, method: str, bins: int, new: str) -> DataFrame:
    """Bins of one order over all records, which no task holds alone."""
    if method == "rank":
        return _kept(df, order.ranked(df, v, "_bin"), new)
    if method == "ntile":
        at = order.numbered(df, [v])
        each, more = F.floor(F.col(order.TOTAL) / bins), F.col(order.TOTAL) % bins
        place = F.col(order.PLACE)
        late = more + F.ceil((place - more * (each + 1)) / F.greatest(each, F.lit(1)))
        return _kept(df, at.withColumn("_bin", F.when(place <= more * (each + 1), F.ceil(place / (each + 1))).otherwise(late).cast("int")), new)
    at = order.running(df, [v], v, "_so_far", "_sum")
    return _kept(df, at.withColumn("_bin", _of_sums(F.col("_so_far"), F.col("_sum"), bins)), new)


def _kept(df: DataFrame, binned: DataFrame, new: str) -> DataFrame:
    return with_field(binned.select(*(column(binned, n) for n in df.columns), "_bin"), new, F.col("_bin")).drop("_bin")
