"""Column functions that clean values: substitution, stripping and coalescing to a type."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = {"integer": r"^[+-]?[0-9]+$", "float": r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?([iI]nf(inity)?|[nN]a[nN])$"}


def java_pattern(pattern: str) -> str:
    """A Python regular expression for Java: named groups and back-references by name."""
    plain = lambda m: m[1].replace("_", "")  # noqa: E731  Java's group names have no underscores
    pattern = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{plain(m)}>", pattern)
    return re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{plain(m)}>", pattern)


def java_replacement(replacement: str) -> str:
    r"""A Python replacement for Java: \1 and \g<name> become $1 and ${name}; a dollar is itself."""
    out = replacement.replace("$", r"\$")
    out = re.sub(r"\\g<(\d+)>", r"$\1", out)
    out = re.sub(r"\\g<(\w+)>", lambda m: "${" + m[1].replace("_", "") + "}", out)
    return re.sub(r"\\(\d)", r"$\1", out)


def substitute(value: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Each rule's matches replaced, rule after rule; null stays null."""
    for pattern, replacement in rules:
        value = F.regexp_replace(value, java_pattern(pattern), java_replacement(replacement))
    return value


def strip(value: Column, chars: str | None = None) -> Column:
    """Both ends without ``chars``, or without any white space."""
    if chars:
        return F.btrim(value, F.lit(chars))
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def to_string(value: Column, empty=None) -> Column:
    """Text without white space at the ends; the empty value where nothing is left."""
    text = strip(value.cast("string"))
    return F.coalesce(F.when(text != "", text), F.lit(empty).cast("string"))


def to_number(value: Column, storage_type: str, is_text: bool, empty=None) -> Column:
    """A whole number or float, of text without any white space; the empty value where it isn't one."""
    kind = "bigint" if storage_type == "integer" else "double"
    if is_text:
        text = F.regexp_replace(value, r"(?U)\s+", "")
        number = F.when(text.rlike(_NUMBER[storage_type]), text).try_cast(kind)
    else:
        number = value.try_cast(kind)
    return F.coalesce(number, F.lit(empty).cast(kind))
