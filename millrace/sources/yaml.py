"""Directories of YAML files, a record each."""

from __future__ import annotations

import datetime
import json
import os
from string import Template

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import order
from millrace.schema import FieldList, collapse_record, expand_record
from millrace.session import ship_package
from millrace.sources.base import Source, Target, needs_fields


class YamlDirectorySource(Source):
    """Records of the files with an extension under a path; absent keys are null, ``expand`` flattens nested ones.

    Files are read and parsed on the executors.
    """

    def __init__(self, path: str, extension: str = "yml", expand: bool = False, filename_field: str | None = None, fields=None):
        self.path, self.extension, self.expand, self.filename_field, self.fields = path, extension, expand, filename_field, fields

    def read(self, spark: SparkSession) -> DataFrame:
        ship_package(spark)
        fields = needs_fields(self.fields)
        names, expand, filename = fields.names(), self.expand, self.filename_field
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{self.extension}").load(self.path).select("path", "content")

        def parse(batches):
            import pyarrow as pa
            import yaml

            for batch in batches:
                out = []
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    record = yaml.safe_load(content) or {}
                    record = collapse_record(record) if expand else record
                    if filename:
                        record[filename] = os.path.basename(path)
                    out.append([None if (v := record.get(n)) is None else v if isinstance(v, str) else json.dumps(v, default=str) for n in names])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out) if out else [[] for _ in names])], names=[f"c{i}" for i in range(len(names))])

        raw = files.mapInArrow(parse, T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]))
        target = fields.spark()
        return raw.select(*(_cast(F.col(f"c{i}"), f.dataType).alias(f.name, metadata=f.metadata) for i, f in enumerate(target)))


def _cast(c, kind: T.DataType):
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.ArrayType):
        return F.from_json(c, kind)
    return F.btrim(c, F.lit('"')).try_cast(kind)


def _folder(path: str):
    """The file system of a path or URI, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


class YamlDirectoryTarget(Target):
    """A file per record, written by the tasks to a folder that all of them share; names are a template over the record and
    ``__index``, the number in the order of reading. A task that runs again writes the same files."""

    def __init__(self, path: str, filename_template: str = "record_${__index}.yml", expand: bool = False, filename_start_index: int = 0, truncate: bool = False):
        self.path, self.template, self.expand, self.start, self.truncate = path, filename_template, expand, filename_start_index, truncate

    def write(self, df: DataFrame) -> None:
        from pyarrow import fs

        files, root = _folder(self.path)
        kind = files.get_file_info(root).type
        if kind == fs.FileType.File:
            raise OSError(f"{self.path} is not a directory")
        if self.truncate and kind == fs.FileType.Directory:
            files.delete_dir_contents(root)
        files.create_dir(root, recursive=True)
        ship_package(df.sparkSession)
        names = FieldList.of_schema(df.schema).names()
        path, template, nested, start, width = self.path, self.template, self.expand, self.start, len(names)
        placed = df.toDF(*(f"c{i}" for i in range(width)))
        numbered = order.numbered(placed, [F.monotonically_increasing_id()]) if "__index" in template else placed.withColumn(order.PLACE, F.lit(0).cast("bigint"))

        def run(batches):
            import pyarrow as pa
            import yaml

            out, folder = _folder(path)
            for batch in batches:
                columns = [[_plain(v) for v in c.to_pylist()] for c in batch.columns]
                for *row, place in zip(*columns):
                    record = dict(zip(names, row))
                    name = Template(template).substitute(record | {"__index": start + place - 1})
                    text = yaml.safe_dump(expand_record(record) if nested else record, allow_unicode=True, sort_keys=False)
                    with out.open_output_stream(f"{folder}/{name}") as file:
                        file.write(text.encode("utf-8"))
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

        numbered.select(*(f"c{i}" for i in range(width)), order.PLACE).mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def _plain(value):
    """A time without its zone, as the session shows it."""
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value
