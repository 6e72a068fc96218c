"""Fields, field lists and field maps, and their place in Spark schemas.

A field's label, types and missing values travel in the metadata of its ``StructField``. Operators that compute a column
put the metadata back (``with_field``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import FieldError

#: Fixed names.
STORAGE_TYPES = ("unknown", "string", "text", "integer", "float", "boolean", "date", "array")
ANALYTICAL_TYPES = ("default", "typeless", "flag", "discrete", "range", "set", "ordered_set")
DEFAULT_ANALYTICAL = {"integer": "discrete", "float": "range"}
RETYPED = ("storage_type", "analytical_type", "concrete_storage_type", "missing_values")

SPARK_TYPES: dict[str, T.DataType] = {
    "unknown": T.StringType(),
    "string": T.StringType(),
    "text": T.StringType(),
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "array": T.ArrayType(T.StringType()),
}


def storage_of(kind: T.DataType) -> str:
    """The storage type of a Spark type."""
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, T.FractionalType):
        return "float"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "array" if isinstance(kind, T.ArrayType) else "unknown"


@dataclass(eq=True)
class Field:
    """A named column: equal to another if all attributes are."""

    name: str
    label: str | None = None
    storage_type: str = "unknown"
    analytical_type: str | None = None
    concrete_storage_type: Any = None
    missing_values: Any = None

    def __post_init__(self):
        if self.storage_type not in STORAGE_TYPES:
            raise FieldError(f"unknown storage type {self.storage_type!r} of field {self.name!r}")
        if self.analytical_type in (None, "default"):
            self.analytical_type = DEFAULT_ANALYTICAL.get(self.storage_type, "typeless")
        if self.analytical_type not in ANALYTICAL_TYPES:
            raise FieldError(f"unknown analytical type {self.analytical_type!r} of field {self.name!r}")

    __hash__ = None

    def __str__(self) -> str:
        return self.name

    def to_dict(self) -> dict:
        return asdict(self)

    def spark(self) -> T.StructField:
        concrete = self.concrete_storage_type
        kind = concrete if isinstance(concrete, T.DataType) else SPARK_TYPES[self.storage_type]
        return T.StructField(self.name, kind, True, self.metadata())

    def metadata(self) -> dict:
        kept = {"label": self.label, "storage_type": self.storage_type, "analytical_type": self.analytical_type, "missing_values": self.missing_values}
        if self.concrete_storage_type is not None:
            kept["concrete_storage_type"] = str(self.concrete_storage_type)
        return {k: v for k, v in kept.items() if v is not None}

    @classmethod
    def of(cls, value: Any) -> Field:
        """From a field, a name, (name, storage[, analytical]) or a dict of attributes."""
        if isinstance(value, Field):
            return value
        if isinstance(value, str):
            return cls(value)
        if isinstance(value, dict):
            known = {k: v for k, v in value.items() if k in cls.__dataclass_fields__}
            if "name" not in known:
                raise FieldError(f"field without a name: {value!r}")
            return cls(**known)
        if isinstance(value, (list, tuple)) and 1 <= len(value) <= 3:
            name, storage, analytical = (*value, None, None)[:3]
            return cls(name, storage_type=storage or "unknown", analytical_type=analytical)
        raise FieldError(f"not a field: {value!r}")

    @classmethod
    def of_spark(cls, column: T.StructField) -> Field:
        m = column.metadata or {}
        storage = m.get("storage_type") or storage_of(column.dataType)
        return cls(column.name, m.get("label"), storage, m.get("analytical_type"), m.get("concrete_storage_type"), m.get("missing_values"))


class FieldList:
    """An ordered list of fields with lookup by name."""

    def __init__(self, fields: Iterable = ()):
        self._fields: list[Field] = [Field.of(f) for f in fields or ()]

    @classmethod
    def of_schema(cls, schema: T.StructType) -> FieldList:
        return cls([Field.of_spark(c) for c in schema])

    def spark(self) -> T.StructType:
        return T.StructType([f.spark() for f in self._fields])

    def append(self, field: Any) -> None:
        self._fields.append(Field.of(field))

    def names(self, indexes: Iterable[int] | None = None) -> list[str]:
        return [f.name for f in self._fields] if indexes is None else [self._fields[i].name for i in indexes]

    def index(self, field: Any) -> int:
        try:
            return self.names().index(str(field))
        except ValueError:
            raise KeyError(f"no field {str(field)!r} in {self.names()}") from None

    def indexes(self, fields: Iterable) -> tuple[int, ...]:
        return tuple(self.index(f) for f in fields)

    def selectors(self, fields: Iterable | None = None) -> list[bool]:
        """Whether each field is among ``fields``; all are if none is given."""
        wanted = None if fields is None else {str(f) for f in fields}
        return [wanted is None or n in wanted for n in self.names()]

    def field(self, name: Any) -> Field:
        return self._fields[self.index(name)]

    def fields(self, names: Iterable | None = None) -> list[Field]:
        return list(self._fields) if names is None else [self.field(n) for n in names]

    def copy(self, fields: Iterable | None = None) -> FieldList:
        return FieldList(self.fields(fields))

    def retype(self, changes: dict[str, dict]) -> None:
        for name, new in changes.items():
            if odd := set(new) - set(RETYPED):
                raise FieldError(f"can't retype {sorted(odd)} of field {name!r}")
            i = self.index(name)
            if "storage_type" in new and "analytical_type" not in new:
                new = {**new, "analytical_type": None}
            self._fields[i] = replace(self._fields[i], **new)

    def __len__(self) -> int:
        return len(self._fields)

    def __iter__(self) -> Iterator[Field]:
        return iter(self._fields)

    def __getitem__(self, i):
        return self._fields[i]

    def __setitem__(self, i, field) -> None:
        self._fields[i] = Field.of(field)

    def __delitem__(self, i) -> None:
        del self._fields[i]

    def __contains__(self, field) -> bool:
        return field in self._fields if isinstance(field, Field) else str(field) in self.names()

    def __add__(self, other) -> FieldList:
        return FieldList([*self._fields, *FieldList(other)])

    def __iadd__(self, other) -> FieldList:
        self._fields += FieldList(other)._fields
        return self

    def __eq__(self, other) -> bool:
        return isinstance(other, FieldList) and self._fields == other._fields

    __hash__ = None

    def __repr__(self) -> str:
        return f"FieldList({self.names()})"


fieldlist = FieldList


class FieldMap:
    """Renames, and drops or keeps, fields by their names on input; unknown names are no matter."""

    def __init__(self, rename: dict | None = None, drop: Iterable | None = None, keep: Iterable | None = None):
        if drop and keep:
            raise FieldError("a field map either drops or keeps")
        self.rename = {str(k): str(v) for k, v in (rename or {}).items()}
        self.drop = {str(f) for f in drop or ()}
        self.keep = {str(f) for f in keep or ()}

    @classmethod
    def of(cls, value: Any) -> FieldMap:
        return value if isinstance(value, FieldMap) else cls(**(value or {}))

    def keeps(self, name: str) -> bool:
        return name in self.keep if self.keep else name not in self.drop

    def new_name(self, name: str) -> str:
        return self.rename.get(name, name)

    def map(self, fields: Iterable) -> FieldList:
        return FieldList([replace(f, name=self.new_name(f.name)) for f in FieldList(fields) if self.keeps(f.name)])

    def field_selectors(self, fields: Iterable) -> list[bool]:
        return [self.keeps(f.name) for f in FieldList(fields)]

    def row_filter(self, fields: Iterable) -> Callable[[Iterable], list]:
        mask = self.field_selectors(fields)
        return lambda row: [v for v, kept in zip(row, mask) if kept]

    def columns(self, df: DataFrame) -> list[Column]:
        return [column(df, n).alias(self.new_name(n)) for n in df.columns if self.keeps(n)]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*self.columns(df))


def quoted(name: str) -> str:
    """``name`` as a column reference, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def column(df: DataFrame, name: Any) -> Column:
    """A column by its plain name; a dot is part of it."""
    if str(name) not in df.columns:
        raise FieldError(f"no field {str(name)!r} in {df.columns}")
    return df[quoted(str(name))]


def require(df: DataFrame, names: Iterable) -> list[str]:
    """The names as text; all are columns."""
    out = [str(n) for n in names]
    if missing := [n for n in out if n not in df.columns]:
        raise FieldError(f"no field {missing} in {df.columns}")
    return out


def with_field(df: DataFrame, name: str, value: Column, like: Field | T.StructField | None = None) -> DataFrame:
    """``df`` with a column computed anew, in place or at the end, and the metadata of ``like``."""
    if isinstance(like, Field):
        meta = like.metadata()
    else:
        meta = dict(like.metadata) if like is not None else None
    made = value.alias(name, metadata=meta) if meta else value.alias(name)
    if name in df.columns:
        return df.select(*(made if n == name else column(df, n) for n in df.columns))
    return df.select(*(column(df, n) for n in df.columns), made)


def apply_fields(df: DataFrame, fields: FieldList) -> DataFrame:
    """Cast and annotate the columns that ``fields`` names; a value that doesn't fit is null."""
    return df.select(*(_typed(df, n, fields.field(n)) if n in fields else column(df, n) for n in df.columns))


def _typed(df: DataFrame, name: str, field: Field) -> Column:
    wanted = field.spark().dataType
    c = column(df, name)
    value = c if field.storage_type == "unknown" or df.schema[name].dataType == wanted else c.try_cast(wanted)
    if field.missing_values:
        value = F.when(value.cast("string").isin([str(x) for x in _listed(field.missing_values)]), None).otherwise(value)
    return value.alias(name, metadata=field.metadata())


def _listed(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def retype(df: DataFrame, changes: dict[str, dict]) -> DataFrame:
    fields = FieldList.of_schema(df.schema)
    fields.retype(changes)
    return apply_fields(df, FieldList([fields.field(n) for n in changes]))


# Nested records.


def collapse_record(record: dict, separator: str = ".") -> dict:
    """A nested dict as one level of joined keys; lists stay as they are."""
    out: dict = {}
    stack = [("", record)]
    while stack:
        prefix, level = stack.pop()
        for key, value in level.items():
            if isinstance(value, dict):
                stack.append((f"{prefix}{key}{separator}", value))
            else:
                out[f"{prefix}{key}"] = value
    return out


def expand_record(record: dict, separator: str = ".") -> dict:
    """The inverse of ``collapse_record``."""
    out: dict = {}
    for key, value in record.items():
        *path, last = key.split(separator)
        level = out
        for step in path:
            level = level.setdefault(step, {})
        level[last] = value
    return out


def collapse(df: DataFrame, separator: str = ".") -> DataFrame:
    """Struct columns, of any depth, as flat columns with joined names."""

    def leaves(kind: T.StructType, path: tuple[str, ...]) -> Iterator[Column]:
        for f in kind:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here)
            else:
                yield F.col(".".join(quoted(p) for p in here)).alias(separator.join(here))

    return df.select(*leaves(df.schema, ()))


def expand(df: DataFrame, separator: str = ".") -> DataFrame:
    """The inverse of ``collapse``: columns that share a prefix become a struct."""

    def build(names: list[tuple[tuple[str, ...], str]]) -> list[Column]:
        groups: dict[str, list] = {}
        for path, whole in names:
            groups.setdefault(path[0], []).append((path[1:], whole))
        out = []
        for head, rest in groups.items():
            if len(rest) == 1 and not rest[0][0]:
                out.append(column(df, rest[0][1]).alias(head))
            else:
                out.append(F.struct(*build([r for r in rest if r[0]])).alias(head))
        return out

    return df.select(*build([(tuple(n.split(separator)), n) for n in df.columns]))


def coalesce_value(value: Any, storage_type: str, empty_values: dict | None = None, strip: bool = False) -> Any:
    """One Python value brought to a storage type; what can't be is the empty value of that type, or none."""
    empty = (empty_values or {}).get(storage_type)
    if storage_type in ("string", "text"):
        text = None if value is None else str(value)
        text = text.strip() if strip and text else text
        return text or empty
    if storage_type in ("integer", "float"):
        plain = re.sub(r"\s+", "", value) if isinstance(value, str) else value
        try:
            return int(plain) if storage_type == "integer" else float(plain)
        except (TypeError, ValueError):
            return empty
    if storage_type == "list":
        return value.split(",") if isinstance(value, str) else (empty if value is None else list(value))
    return value


def fitting(value: Any, kind: str) -> Any:
    """A Python value for a field of a Spark type, by name; None stays, what can't be a number is None."""
    if value is None:
        return None
    if kind == "string":
        return value if isinstance(value, str) else str(value)
    if kind == "long":
        return coalesce_value(value, "integer")
    if kind == "double":
        return coalesce_value(value, "float")
    return value


def named(name: str) -> Column:
    """A column by its whole name, of whatever table it is used on."""
    return F.col("`" + name.replace("`", "``") + "`")
