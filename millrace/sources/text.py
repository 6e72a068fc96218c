"""Text targets: formatted lines, boxed tables and HTML, streamed through the driver a partition at a time."""

from __future__ import annotations

import html
import sys
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.schema import FieldList, column
from millrace.sources.base import Target
from millrace.sources.resources import open_resource


class FormattedPrinter(Target):
    """A line per record by a format string over its fields; by default the values, tab-separated, under their names.

    A header or footer is text; None as the header prints names where there is no format, "" an empty line.
    """

    def __init__(self, format: str | None = None, target: Any = None, delimiter: str = "\n", header: str | None = None, footer: str | None = None):
        self.format, self.target, self.delimiter, self.header, self.footer = format, target, delimiter, header, footer

    def write(self, df: DataFrame) -> None:
        handle, close = open_resource(sys.stdout if self.target is None else self.target, "w")
        names = df.columns
        if self.header is not None:
            handle.write(self.header + self.delimiter)
        elif self.format is None:
            handle.write("\t".join(names) + self.delimiter)
        for row in df.toLocalIterator():
            line = self.format.format(**dict(zip(names, row))) if self.format is not None else "\t".join(str(v) for v in row)
            handle.write(line + self.delimiter)
        if self.footer is not None:
            handle.write(self.footer + self.delimiter)
        if close:
            handle.close()


class PrettyPrinter(Target):
    """A boxed table; one aggregation finds the widths, so that no rows are held."""

    def __init__(self, target: Any = None, max_column_width: int | None = None, min_column_width: int = 0, sample: int | None = None, print_names: bool = True, print_labels: bool = False):
        self.target, self.most, self.least, self.sample, self.print_names, self.print_labels = target, max_column_width, min_column_width, sample, print_names, print_labels

    def write(self, df: DataFrame) -> None:
        handle, close = open_resource(sys.stdout if self.target is None else self.target, "w")
        shown = df.limit(self.sample) if self.sample else df
        text = shown.select(*(F.coalesce(column(df, n).cast("string"), F.lit("")).alias(f"c{i}") for i, n in enumerate(df.columns)))
        found = text.agg(*(F.max(F.length(c)) for c in text.columns)).first()
        fields = FieldList.of_schema(df.schema)
        heads = ([fields.names()] if self.print_names else []) + ([[f.label or f.name for f in fields]] if self.print_labels else [])
        widths = [max([w or 0, self.least, *(len(h[i]) for h in heads)]) for i, w in enumerate(found)]
        widths = [min(w, self.most) if self.most else w for w in widths]
        right = [f.storage_type in ("integer", "float") for f in fields]
        rule = "+" + "+".join("-" * w for w in widths) + "+\n"
        cell = lambda v, i: v[: widths[i]].rjust(widths[i]) if right[i] else v[: widths[i]].ljust(widths[i])
        handle.write(rule)
        for h in heads:
            handle.write("|" + "|".join(v[: widths[i]].ljust(widths[i]) for i, v in enumerate(h)) + "|\n")
        if heads:
            handle.write(rule)
        for row in text.toLocalIterator():
            handle.write("|" + "|".join(cell(v, i) for i, v in enumerate(row)) + "|\n")
        handle.write(rule)
        if close:
            handle.close()


class HTMLTarget(Target):
    """An HTML table. ``html_header`` True wraps a whole page, text is written before it; values are escaped unless told not to."""

    def __init__(self, resource: Any, html_header: bool | str | None = True, html_footer: str | None = None, write_headers: bool = True, table_attributes: dict | None = None, escape: bool = True):
        self.resource, self.header, self.footer, self.write_headers, self.attributes, self.escape = resource, html_header, html_footer, write_headers, table_attributes or {}, escape

    def write(self, df: DataFrame) -> None:
        handle, close = open_resource(self.resource, "w")
        safe = html.escape if self.escape else str
        if self.header is True:
            handle.write('<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n</head>\n<body>\n')
        elif self.header:
            handle.write(self.header)
        handle.write("<table" + "".join(f' {k}="{html.escape(str(v))}"' for k, v in self.attributes.items()) + ">\n")
        if self.write_headers:
            heads = [f.label or f.name for f in FieldList.of_schema(df.schema)]
            handle.write("<tr>" + "".join(f"<th>{safe(h)}</th>" for h in heads) + "</tr>\n")
        for row in df.toLocalIterator():
            handle.write("<tr>" + "".join(f"<td>{'' if v is None else safe(str(v))}</td>" for v in row) + "</tr>\n")
        handle.write("</table>\n")
        if self.header is True:
            handle.write("</body>\n</html>\n")
        if self.footer:
            handle.write(self.footer)
        if close:
            handle.close()
