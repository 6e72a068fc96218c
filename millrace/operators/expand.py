"""Several records for each record: a Python function of fields, joined to its record."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.errors import FieldError
from millrace.schema import FieldList, fitting, named, require
from millrace.session import ship_package

#: Python classes of values by their Spark type: a value of another class would silently be null.
_CLASSES = {
    "boolean": bool,
    "byte": int,
    "short": int,
    "integer": int,
    "float": float,
    "decimal": decimal.Decimal,
    "date": datetime.date,
    "timestamp": datetime.datetime,
    "timestamp_ntz": datetime.datetime,
    "binary": (bytes, bytearray),
    "array": (list, tuple),
    "map": dict,
}


def _sent(value: Any, kind: str) -> Any:
    """A value as it is sent to a field of a Spark type, by name."""
    value = fitting(value, kind)
    if isinstance(value, np.generic):
        value = value.item()
    if kind == "float" and isinstance(value, int):
        value = float(value)
    if value is not None and not isinstance(value, _CLASSES.get(kind, object)):
        raise TypeError(f"{value!r} for a field of type {kind}")
    return value


def table_function(df: DataFrame, function: Callable, fields: Iterable, outputs: Iterable, keep_empty: bool = False, **kwargs) -> DataFrame:
    """``df`` with a record for each row that ``function`` yields of ``fields``, by position; ``outputs`` are the new fields.

    Records for which it yields nothing go or, with ``keep_empty``, stay once, with nulls. The function runs in the tasks
    and needs only its fields. Its rows are pickled: Arrow would make a batch for each record, which costs more than the rows. Values take the types of their fields, those of no type become text.
    """
    names, new = require(df, fields), FieldList(outputs)
    if clash := {n.lower() for n in df.columns} & {n.lower() for n in new.names()}:
        raise FieldError(f"fields that are there already: {sorted(clash)}")
    if not len(new):
        raise FieldError("a table function needs fields")
    ship_package(df.sparkSession)
    schema = new.spark()
    kinds = [f.dataType.typeName() for f in schema]

    class Rows:
        def eval(self, *values):
            found = False
            for row in function(*values, **kwargs):
                found = True
                row = tuple(row) if isinstance(row, (tuple, list)) else (row,)
                if len(row) != len(kinds):
                    raise ValueError(f"a row of {len(row)} values for {len(kinds)} fields")
                yield tuple(_sent(v, k) for v, k in zip(row, kinds))
            if keep_empty and not found:
                yield (None,) * len(kinds)

    made = F.udtf(Rows, returnType=schema, useArrow=False)
    joined = df.lateralJoin(made(*(named(n).outer() for n in names)))
    old = len(df.columns)
    placed = joined.toDF(*(f"c{i}" for i in range(len(joined.columns))))
    every = [*df.schema, *schema]
    return placed.select(*(F.col(f"c{i}").alias(f.name, metadata=f.metadata) for i, f in enumerate(every[: old + len(kinds)])))
