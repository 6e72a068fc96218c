"""Python-like expressions as Spark columns, without evaluating any user text.

The text is parsed, and a fixed set of constructs becomes columns; anything else is refused. Nulls follow SQL. With
``compat`` the division of whole numbers floors, as it did in the language that such expressions come from. Text that
begins with "sql:" is a Spark SQL expression.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import FieldError
from millrace.schema import column


class _Typed:
    """A column, and whether it is known to be text or a whole number."""

    def __init__(self, value: Column, kind: str = ""):
        self.value, self.kind = value, kind


def _kind(t: T.DataType) -> str:
    return "text" if isinstance(t, T.StringType) else "whole" if isinstance(t, T.IntegralType) else ""


_COMPARE: dict[type, Callable[[Column, Column], Column]] = {
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}

_CALLS: dict[str, tuple[Callable[..., Column], str]] = {
    "len": (lambda x: F.length(x), "whole"),
    "abs": (F.abs, ""),
    "round": (lambda x, n=None: F.round(x, n) if n is not None else F.round(x), ""),
    "min": (lambda *x: F.least(*x), ""),
    "max": (lambda *x: F.greatest(*x), ""),
    "str": (lambda x: x.cast("string"), "text"),
    "int": (lambda x: x.try_cast("bigint"), "whole"),
    "float": (lambda x: x.try_cast("double"), ""),
    "upper": (F.upper, "text"),
    "lower": (F.lower, "text"),
    "strip": (lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), "text"),
    "coalesce": (lambda *x: F.coalesce(*x), ""),
}


def translate(text: str, df: DataFrame, compat: bool = False) -> Column:
    """The column that ``text`` means over the fields of ``df``."""
    if text.lstrip().startswith("sql:"):
        return F.expr(text.lstrip()[4:])
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as e:
        raise FieldError(f"can't read expression {text!r}: {e.msg}") from None
    return _walk(tree.body, df, compat, text).value


def _walk(node: ast.AST, df: DataFrame, compat: bool, text: str) -> _Typed:
    go = lambda n: _walk(n, df, compat, text)
    match node:
        case ast.Constant(value=v) if v is None or isinstance(v, (bool, int, float, str)):
            return _Typed(F.lit(v), "text" if isinstance(v, str) else "whole" if isinstance(v, int) and not isinstance(v, bool) else "")
        case ast.Name(id=name):
            return _Typed(column(df, name), _kind(df.schema[name].dataType))
        case ast.BoolOp(op=op, values=values):
            parts = [go(v).value for v in values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(op, ast.And) else out | p
            return _Typed(out)
        case ast.UnaryOp(op=ast.Not(), operand=x):
            return _Typed(~go(x).value)
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return _Typed(-go(x).value, go(x).kind)
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return go(x)
        case ast.BinOp(left=a, op=op, right=b):
            return _arithmetic(go(a), op, go(b), compat, text)
        case ast.Compare(left=first, ops=ops, comparators=rest):
            out, left = None, first
            for op, right in zip(ops, rest):
                part = _compare(left, op, right, go, text)
                out, left = part if out is None else out & part, right
            return _Typed(out)
        case ast.IfExp(test=t, body=a, orelse=b):
            return _Typed(F.when(go(t).value, go(a).value).otherwise(go(b).value), go(a).kind)
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _CALLS:
            function, kind = _CALLS[name]
            if name == "round" and len(args) == 2 and isinstance(args[1], ast.Constant):
                return _Typed(function(go(args[0]).value, args[1].value))
            try:
                return _Typed(function(*(go(a).value for a in args)), kind)
            except TypeError:
                raise FieldError(f"wrong number of arguments of {name} in {text!r}") from None
        case ast.Call(func=ast.Attribute(value=owner, attr=("upper" | "lower" | "strip") as name), args=[], keywords=[]):
            return _Typed(_CALLS[name][0](go(owner).value), "text")
    raise FieldError(f"{type(node).__name__} is not allowed in expression {text!r}")


def _arithmetic(a: _Typed, op: ast.operator, b: _Typed, compat: bool, text: str) -> _Typed:
    whole = "whole" if a.kind == b.kind == "whole" else ""
    match op:
        case ast.Add():
            return _Typed(F.concat(a.value, b.value), "text") if "text" in (a.kind, b.kind) else _Typed(a.value + b.value, whole)
        case ast.Sub():
            return _Typed(a.value - b.value, whole)
        case ast.Mult():
            return _Typed(a.value * b.value, whole)
        case ast.Div():
            if compat and whole:
                return _Typed(F.floor(F.try_divide(a.value, b.value)), "whole")
            return _Typed(F.try_divide(a.value.cast("double"), b.value.cast("double")))
        case ast.FloorDiv():
            return _Typed(F.floor(F.try_divide(a.value.cast("double"), b.value.cast("double"))), whole)
        case ast.Mod():
            # The sign of the divisor, as in Python.
            return _Typed(F.try_mod(F.try_mod(a.value, b.value) + b.value, b.value), whole)
        case ast.Pow():
            return _Typed(F.pow(a.value, b.value))
    raise FieldError(f"{type(op).__name__} is not allowed in expression {text!r}")


def _compare(left: ast.AST, op: ast.cmpop, right: ast.AST, go, text: str) -> Column:
    if isinstance(op, (ast.Is, ast.IsNot)):
        if not (isinstance(right, ast.Constant) and right.value is None):
            raise FieldError(f"'is' takes None only in expression {text!r}")
        found = go(left).value.isNull()
        return found if isinstance(op, ast.Is) else ~found
    if isinstance(op, (ast.In, ast.NotIn)):
        if not isinstance(right, (ast.List, ast.Tuple, ast.Set)):
            if isinstance(right, ast.Name) or (isinstance(right, ast.Constant) and isinstance(right.value, str)):
                found = F.contains(go(right).value, go(left).value)
                return found if isinstance(op, ast.In) else ~found
            raise FieldError(f"'in' takes a list in expression {text!r}")
        found = go(left).value.isin([go(x).value for x in right.elts])
        return found if isinstance(op, ast.In) else ~found
    if isinstance(right, ast.Constant) and right.value is None and isinstance(op, (ast.Eq, ast.NotEq)):
        found = go(left).value.isNull()
        return found if isinstance(op, ast.Eq) else ~found
    return _COMPARE[type(op)](go(left).value, go(right).value)
