"""Delimited text."""

from __future__ import annotations

import codecs
import csv
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import FieldError
from millrace.functions.cleansing import to_number
from millrace.schema import Field, FieldList, quoted
from millrace.sources.base import Source, Target
from millrace.sources.resources import fetched


def dialect_options(dialect: Any, **more: Any) -> dict[str, str]:
    """Reader and writer options of a dialect of Python's csv module, by name or object, and single settings over it."""
    if isinstance(dialect, str):
        try:
            dialect = csv.get_dialect(dialect)
        except csv.Error as e:
            raise ValueError(f"{e}: {dialect!r}") from None
    given = {k: getattr(dialect, k) for k in ("delimiter", "quotechar", "escapechar", "doublequote")} if dialect is not None else {}
    given |= {k: v for k, v in more.items() if v is not None}
    out = {"sep": given.get("delimiter") or ",", "quote": given.get("quotechar") or '"'}
    out["escape"] = given.get("escapechar") or (out["quote"] if given.get("doublequote", True) else "\\")
    return out


#: Names of encodings that Spark spells in its own way.
_SPELLED = {"iso8859-1": "iso-8859-1", "ascii": "us-ascii"}


def charset(encoding: str | None) -> str:
    """Spark's name of an encoding by any of Python's."""
    try:
        name = codecs.lookup(encoding or "utf-8").name
    except LookupError:
        return encoding
    return _SPELLED.get(name, name)


class CSVSource(Source):
    """A delimited file, directory or glob.

    Names come from ``fields``, else from the header; all columns are text then. A header is read past where there is one,
    and sniffed for with ``detect_header``. ``skip_rows`` leaves out that many lines before the header of one file; quoted line
    breaks aren't possible with it. Fields with a storage type are cast, and what doesn't fit is null; empty text is null
    unless ``empty_as_null`` is false.
    """

    def __init__(
        self,
        resource: Any,
        read_header: bool = True,
        dialect: Any = None,
        encoding: str | None = None,
        detect_header: bool = False,
        sample_size: int = 200,
        skip_rows: int | None = None,
        empty_as_null: bool = True,
        fields: Any = None,
        multiline: bool = False,
        **csv_args: Any,
    ):
        self.resource, self.read_header, self.dialect, self.encoding = resource, read_header, dialect, encoding
        self.detect_header, self.sample_size, self.skip_rows = detect_header, sample_size, skip_rows
        self.empty_as_null, self.fields, self.multiline, self.csv_args = empty_as_null, fields, multiline, csv_args

    def read(self, spark: SparkSession) -> DataFrame:
        path, options = fetched(spark, self.resource), dialect_options(self.dialect, **self.csv_args)
        options |= {"encoding": charset(self.encoding), "nullValue": "", "emptyValue": "", "multiLine": str(self.multiline).lower()}
        lines = spark.read.option("encoding", options["encoding"]).text(path)
        header = self.read_header
        skip = int(self.skip_rows or 0)
        if self.detect_header:
            head = "\n".join(r[0] for r in lines.limit(skip + 50).collect()[skip:])[: self.sample_size]
            try:
                header = csv.Sniffer().has_header(head)
            except csv.Error:
                header = False
        fields = FieldList(self.fields) if self.fields is not None else None
        if fields is None:
            if not header:
                raise FieldError("a file without a header needs fields")
            first = lines.limit(skip + 1).collect()
            if len(first) <= skip:
                raise FieldError(f"no header in {self.resource}")
            row = next(csv.reader([first[skip][0].lstrip("﻿")], delimiter=options["sep"], quotechar=options["quote"]))
            fields = FieldList([Field(n, storage_type="string") for n in row])
        self.fields = fields
        text = T.StructType([T.StructField(n, T.StringType()) for n in fields.names()])
        if skip:
            # Lines of one file are numbered from its first partition on.
            kept = lines.filter(F.monotonically_increasing_id() >= skip + bool(header))
            plain = {k: v for k, v in options.items() if k not in ("encoding", "multiLine")}
            df = kept.select(F.from_csv("value", ", ".join(f"{quoted(n)} string" for n in fields.names()), plain).alias("r")).select("r.*")
        else:
            df = spark.read.options(**options).csv(path, schema=text, header=bool(header), enforceSchema=True)
        return df.select(*(self._typed(f).alias(f.name, metadata=f.metadata()) for f in fields))

    def _typed(self, f: Field):
        c = F.col(quoted(f.name))
        if not self.empty_as_null and f.storage_type in ("string", "text", "unknown"):
            return F.coalesce(c, F.lit(""))
        if f.storage_type in ("integer", "float"):
            return to_number(c, f.storage_type, True)
        if f.storage_type == "boolean":
            return F.when(F.lower(c).isin("true", "t", "yes", "y", "1"), True).when(F.lower(c).isin("false", "f", "no", "n", "0"), False)
        return c if f.storage_type in ("string", "text", "unknown") else F.split(c, ",") if f.storage_type == "array" else c.try_cast("date")


class CSVTarget(Target):
    """A directory of delimited files or, with ``single``, one file that the driver streams.

    ``truncate`` overwrites, else rows are added.
    """

    def __init__(
        self, resource: Any, write_headers: bool = True, truncate: bool = True, encoding: str = "utf-8", dialect: Any = None, fields: Any = None, single: bool | None = None, **kwargs: Any
    ):
        self.resource, self.write_headers, self.truncate, self.encoding, self.dialect = resource, write_headers, truncate, encoding, dialect
        self.fields, self.csv_args = fields, kwargs
        self.single = hasattr(resource, "write") if single is None else single

    def write(self, df: DataFrame) -> None:
        if self.fields is not None:
            names = FieldList(self.fields).names()
            df = df.select(*(F.col(quoted(n)) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names))
        if not self.single:
            options = dialect_options(self.dialect, **self.csv_args)
            df.write.mode("overwrite" if self.truncate else "append").options(encoding=charset(self.encoding), header=str(self.write_headers).lower(), nullValue="", emptyValue="", **options).csv(self.resource)
            return
        from millrace.sources.resources import open_resource

        handle, close = open_resource(self.resource, "w" if self.truncate else "a", self.encoding)
        settings = {k: v for k, v in self.csv_args.items() if v is not None}
        writer = csv.writer(handle, self.dialect or "excel", **settings)
        fresh = self.truncate or not (close and handle.tell())
        if self.write_headers and fresh:
            writer.writerow(df.columns)
        for row in df.toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])
        if close:
            handle.close()
