"""The nodes: each names its attributes, and calls one operator, source or target."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from millrace import sources
from millrace.errors import StreamError
from millrace.operators import fields as field_operators
from millrace.operators import expand, joins, quality, records, statistics
from millrace.plans.node import Node, register
from millrace.schema import FieldList


def _declared(name: str, kind: str, attributes: dict[str, str], defaults: dict[str, Any], doc: str, arity=(1, 1), protected=(), order=None, extra: str | None = None) -> type[Node]:
    """A node class whose attributes are its constructor's arguments; ``extra`` gathers other keyword arguments."""
    order = order or list(attributes)

    def __init__(self, *args, **kwargs):
        Node.__init__(self)
        for key in attributes:
            value = defaults.get(key)
            setattr(self, key, list(value) if isinstance(value, list) else dict(value) if isinstance(value, dict) else value)
        if len(args) > len(order):
            if "args" not in attributes:
                raise TypeError(f"{name} takes at most {len(order)} arguments")
            self.args = list(args[len(order) :])
        given = dict(zip(order, args)) | kwargs
        for key, value in given.items():
            if key in attributes:
                setattr(self, key, value)
            elif extra:
                getattr(self, extra)[key] = value
            else:
                raise TypeError(f"{name} has no attribute {key!r}")

    return type(name, (Node,), {"__init__": __init__, "__doc__": doc, "name": name, "kind": kind, "attributes": attributes, "arity": arity, "protected": protected})


def _source(name: str, doc: str, make: Callable[[Node], sources.base.Source], attributes: dict[str, str], defaults: dict[str, Any] | None = None, **more) -> None:
    cls = _declared(name, "source", {**attributes, "fields": "fields of the table"}, defaults or {}, doc, (0, 0), **more)

    def read(self, spark):
        made = make(self)
        if self.fields is not None:
            made.fields = FieldList(self.fields)
        return made.read(spark)

    cls.read = read
    register(cls)


def _target(name: str, doc: str, write: Callable[[Node, DataFrame], None], attributes: dict[str, str], defaults: dict[str, Any] | None = None, **more) -> None:
    cls = _declared(name, "target", attributes, defaults or {}, doc, **more)
    cls.write = write
    register(cls)


def _step(name: str, doc: str, transform: Callable[..., DataFrame], attributes: dict[str, str], defaults: dict[str, Any] | None = None, **more) -> type[Node]:
    cls = _declared(name, "processing", attributes, defaults or {}, doc, **more)
    cls.transform = transform
    return register(cls)


def _given(node: Node, *names: str) -> dict[str, Any]:
    """Attributes that are set."""
    return {n: v for n in names if (v := getattr(node, n)) is not None}


# Sources.

_source("row_list_source", "Rows of a list of sequences.", lambda n: sources.RowListSource(n.list), {"list": "the rows"})
_source("record_list_source", "Rows of a list of dicts.", lambda n: sources.RecordListSource(n.list), {"list": "the records"})
_source(
    "generator_function_source",
    "Rows that a generator function yields.",
    lambda n: sources.GeneratorSource(n.function, n.fields, *(n.args or ()), partitions=n.partitions, **(n.kwargs or {})),
    {"function": "the function", "args": "its arguments", "kwargs": "its keyword arguments", "partitions": "lists of arguments, a call in a task for each"},
    {"kwargs": {}},
    order=["function", "fields"],
    extra="kwargs",
    protected=("function",),
)


@register
class StreamSource(_declared("stream_source", "source", {"stream": "a source object, a DataFrame, or a function that returns one"}, {}, "Whatever a source object reads.", (0, 0), ("stream",))):
    """Whatever a source object, a DataFrame or a function gives."""

    name = "stream_source"

    def read(self, spark):
        if isinstance(self.stream, DataFrame):
            return self.stream
        return self.stream.read(spark) if hasattr(self.stream, "read") else self.stream()


_CSV = {
    "resource": "path, URL or handle",
    "read_header": "whether names are read from the header",
    "dialect": "dialect by name or object",
    "encoding": "encoding of the text",
    "detect_header": "whether to look for a header first",
    "sample_size": "characters to look at for that",
    "skip_rows": "lines to leave out at the start",
    "empty_as_null": "whether empty text is null",
    "csv_args": "single settings of a dialect",
}
_source(
    "csv_source",
    "A delimited text file.",
    lambda n: sources.CSVSource(n.resource, n.read_header, n.dialect, n.encoding, n.detect_header, n.sample_size, n.skip_rows, n.empty_as_null, **(n.csv_args or {})),
    _CSV,
    {"read_header": True, "detect_header": False, "sample_size": 200, "empty_as_null": True, "csv_args": {}},
    extra="csv_args",
)
_source(
    "xls_source",
    "A sheet of a workbook.",
    lambda n: sources.XLSSource(n.resource, n.sheet, n.encoding, n.skip_rows, n.read_header),
    {"resource": "path, URL or handle", "sheet": "number or name", "encoding": "encoding of text", "skip_rows": "rows to leave out", "read_header": "whether names are read from the header"},
    {"read_header": True},
)
_source(
    "yaml_directory_source",
    "A directory of YAML files, a record each.",
    lambda n: sources.YamlDirectorySource(n.path, n.extension, n.expand, n.filename_field),
    {"path": "the directory", "extension": "of the files", "expand": "whether nested records are flattened", "filename_field": "field for the file's name"},
    {"extension": "yml", "expand": False},
)
_source(
    "sql_source",
    "A table or statement of a database, or of Spark's catalog without a URL.",
    lambda n: sources.SQLSource(n.url or n.uri, n.table, n.statement, n.schema, partitioning=n.partitioning, **(n.options or {})),
    {"url": "of the database, for JDBC", "uri": "the same", "table": "its name", "statement": "a query instead", "schema": "of the table", "partitioning": "column, bounds and number for reading in parallel", "options": "of the reader"},
    {"options": {}},
    extra="options",
)
_source(
    "file_source",
    "Parquet, ORC or JSON files.",
    lambda n: sources.FileSource(n.path, n.format, expand=n.expand, **(n.options or {})),
    {"path": "of the files", "format": "of the files", "expand": "whether nested records are flattened", "options": "of the reader"},
    {"format": "parquet", "expand": False, "options": {}},
    extra="options",
)
_source(
    "es_source",
    "Documents of an Elasticsearch index.",
    lambda n: sources.ElasticsearchSource(n.document_type, n.database, n.host, n.port, n.expand),
    {"document_type": "type of document", "database": "the index", "host": "of the server", "port": "of the server", "expand": "whether nested records are flattened"},
    {"database": "test", "host": "localhost", "port": 9200, "expand": False},
)
_source(
    "mongo_source",
    "Documents of a MongoDB collection.",
    lambda n: sources.MongoSource(n.collection, n.database, n.host, n.port, n.expand),
    {"collection": "its name", "database": "its name", "host": "of the server", "port": "of the server", "expand": "whether nested records are flattened"},
    {"host": "localhost", "port": 27017, "expand": False},
)
_GOOGLE = ("spreadsheet_key", "spreadsheet_name", "worksheet_id", "worksheet_name", "query_string", "username", "password")
_source("google_spreadsheet_source", "A published sheet.", lambda n: sources.GoogleSpreadsheetSource(*(getattr(n, k) for k in _GOOGLE)), {k: k.replace("_", " ") for k in _GOOGLE})
_source("scraper_wiki_source", "A scraper's table; the service is gone.", lambda n: sources.ScraperWikiSource(n.scraper), {"scraper": "its name"})


# Targets.


def _rows(self, df):
    self.rows = self.list = [tuple(r) for r in df.toLocalIterator()]


def _records(self, df):
    self.records = self.list = [r.asDict(recursive=True) for r in df.toLocalIterator()]


_target("row_list_target", "A list of tuples on the driver, in the attribute rows.", _rows, {"list": "the rows"})
_target("record_list_target", "A list of dicts on the driver, in the attribute records.", _records, {"list": "the records"})
_target("stream_target", "A target object, or a function of a DataFrame.", lambda n, df: n.stream.write(df) if hasattr(n.stream, "write") else n.stream(df), {"stream": "the target"}, protected=("stream",))
_target(
    "csv_target",
    "Delimited text.",
    lambda n, df: sources.CSVTarget(n.resource, n.write_headers, n.truncate, n.encoding, n.dialect, single=n.single, **(n.csv_args or {})).write(df),
    {"resource": "path or handle", "write_headers": "whether names are written", "truncate": "whether what is there goes", "encoding": "of the text", "dialect": "by name or object", "single": "one file, streamed through the driver", "csv_args": "single settings of a dialect"},
    {"write_headers": True, "truncate": True, "encoding": "utf-8", "single": True, "csv_args": {}},
    extra="csv_args",
)
_target(
    "file_target",
    "Parquet, ORC or JSON files.",
    lambda n, df: sources.FileTarget(n.path, n.format, n.truncate, n.partition_by or (), n.expand, **(n.options or {})).write(df),
    {"path": "of the files", "format": "of the files", "truncate": "whether what is there goes", "partition_by": "fields", "expand": "whether dotted fields are nested", "options": "of the writer"},
    {"format": "parquet", "truncate": False, "expand": False, "options": {}},
    extra="options",
)
_target(
    "formatted_printer",
    "A line of text per record.",
    lambda n, df: sources.FormattedPrinter(n.format, n.target or n.output, n.delimiter, n.header, n.footer).write(df),
    {"format": "with names in braces", "target": "path or handle", "output": "the same", "delimiter": "after lines", "header": "text before", "footer": "text after"},
    {"delimiter": "\n"},
    order=["format", "target", "delimiter", "header", "footer"],
)
_target(
    "pretty_printer",
    "A boxed table.",
    lambda n, df: sources.PrettyPrinter(n.target, n.max_column_width, n.min_column_width, n.sample, n.print_names, n.print_labels).write(df),
    {"target": "path or handle", "max_column_width": "characters at most", "min_column_width": "characters at least", "sample": "records to print", "print_names": "whether names are printed", "print_labels": "whether labels are printed"},
    {"min_column_width": 0, "print_names": True, "print_labels": False},
)
_target(
    "html_target",
    "An HTML table.",
    lambda n, df: sources.HTMLTarget(n.resource, n.html_header, n.html_footer, n.write_headers, n.table_attributes, n.escape).write(df),
    {"resource": "path or handle", "html_header": "True, or text", "html_footer": "text", "write_headers": "whether names are written", "table_attributes": "of the table element", "escape": "whether values are escaped"},
    {"html_header": True, "write_headers": True, "escape": True},
)
_target(
    "yaml_directory_target",
    "A directory of YAML files.",
    lambda n, df: sources.YamlDirectoryTarget(n.path, n.filename_template, n.expand, n.filename_start_index, n.truncate).write(df),
    {"path": "the directory", "filename_template": "over the record and __index", "expand": "whether dotted fields are nested", "filename_start_index": "first number", "truncate": "whether what is there goes"},
    {"filename_template": "record_${__index}.yml", "expand": False, "filename_start_index": 0, "truncate": False},
)
_SQL = {k: k.replace("_", " ") for k in ("url", "table", "schema", "truncate", "create", "replace", "add_id_key", "id_key_name", "buffer_size", "fields", "concrete_type_map", "options")}
_target(
    "sql_table_target",
    "A table of a database, or of Spark's catalog without a URL.",
    lambda n, df: sources.SQLTarget(**{k: getattr(n, k) for k in _SQL if k != "options"}, **(n.options or {})).write(df),
    _SQL,
    {"truncate": False, "create": False, "replace": False, "add_id_key": False, "id_key_name": "id", "buffer_size": 1000, "options": {}},
    order=["url", "table", "truncate", "create", "replace"],
    extra="options",
)
_target(
    "es_target",
    "Documents of an Elasticsearch index.",
    lambda n, df: sources.ElasticsearchTarget(n.document_type, n.database, n.host, n.port, n.truncate, n.expand).write(df),
    {"document_type": "type of document", "database": "the index", "host": "of the server", "port": "of the server", "truncate": "whether what is there goes", "expand": "whether dotted fields are nested"},
    {"database": "test", "host": "localhost", "port": 9200, "truncate": False, "expand": False},
)
_target(
    "mongo_target",
    "Documents of a MongoDB collection.",
    lambda n, df: sources.MongoTarget(n.collection, n.database, n.host, n.port, n.truncate, n.expand).write(df),
    {"collection": "its name", "database": "its name", "host": "of the server", "port": "of the server", "truncate": "whether what is there goes", "expand": "whether dotted fields are nested"},
    {"host": "localhost", "port": 27017, "truncate": False, "expand": False},
)


# Field nodes.


class FieldMapNode(
    _step(
        "field_map",
        "Rename fields, and drop or keep some.",
        lambda n, df: field_operators.field_map(df, n.map_fields, n.drop_fields, n.keep_fields),
        {"map_fields": "new names by old", "drop_fields": "names", "keep_fields": "names"},
        {"map_fields": {}, "drop_fields": [], "keep_fields": []},
    )
):
    """Rename fields, and drop or keep some."""

    def rename_field(self, source: str, target: str) -> None:
        self.map_fields = {**(self.map_fields or {}), source: target}

    def drop_field(self, name: str) -> None:
        self.drop_fields = [*(self.drop_fields or []), name]


register(FieldMapNode)


class TextSubstituteNode(
    _step(
        "text_substitute",
        "Replace what regular expressions match.",
        lambda n, df: field_operators.text_substitute(df, n.field, n.substitutions, n.derived_field),
        {"field": "its name", "derived_field": "name of a new field for the result", "substitutions": "pairs of pattern and replacement"},
        {"substitutions": []},
    )
):
    """Replace what regular expressions match."""

    def add_substitution(self, pattern: str, replacement: str) -> None:
        self.substitutions = [*self.substitutions, (pattern, replacement)]


register(TextSubstituteNode)

_step("string_strip", "Strip both ends of text.", lambda n, df: field_operators.string_strip(df, n.fields, n.chars), {"fields": "names", "chars": "to strip"})
_step(
    "coalesce_value_to_type",
    "Bring values to their fields' types.",
    lambda n, df: field_operators.coalesce_value_to_type(df, n.fields, n.types, n.empty_values),
    {"fields": "names or fields", "types": "storage types to treat", "empty_values": "values by storage type"},
)
_step(
    "value_threshold",
    "Bin values by thresholds.",
    lambda n, df: field_operators.value_threshold(df, n.thresholds, n.bin_names, n.prefix, n.suffix, n.compat),
    {"thresholds": "field, low and high each", "bin_names": "names of bins", "prefix": "of new fields", "suffix": "of new fields", "compat": "whether low values are called middle ones"},
    {"compat": False},
)
_step(
    "derive",
    "Append a field made by a formula.",
    lambda n, df: field_operators.derive(df, n.formula, n.field_name, n.analytical_type, n.storage_type, n.compat),
    {"formula": "expression or function", "field_name": "of the new field", "analytical_type": "of the new field", "storage_type": "of the new field", "compat": "whether whole numbers divide to whole ones"},
    {"field_name": "new_field", "analytical_type": "unknown", "storage_type": "unknown", "compat": False},
)
_step(
    "binning",
    "Append a bin.",
    lambda n, df: field_operators.binning(df, n.field, n.method, n.size, n.derived_field, n.partition_by or ()),
    {"field": "its name", "method": "width, count, ntile, ntile_sum or rank", "size": "width or number", "derived_field": "name of the new field", "partition_by": "fields in whose groups ntile, ntile_sum and rank count"},
    {"method": "width", "size": 1},
)


# Record nodes.

_step(
    "select",
    "Records that meet a condition.",
    lambda n, df: records.select(df, n.condition, n.discard, n.compat),
    {"condition": "expression or function", "discard": "whether these go instead", "compat": "whether whole numbers divide to whole ones"},
    {"discard": False, "compat": False},
)
_step(
    "function_select",
    "Records for which a function of fields is true.",
    lambda n, df: records.function_select(df, n.function, n.fields, n.discard, **(n.kwargs or {})),
    {"function": "of the fields' values", "fields": "names", "discard": "whether these go instead", "kwargs": "further arguments"},
    {"discard": False, "kwargs": {}},
    extra="kwargs",
    protected=("function",),
)
_step(
    "set_select",
    "Records whose value is in a set.",
    lambda n, df: records.set_select(df, n.field, n.value_set or (), n.discard),
    {"field": "its name", "value_set": "the values", "discard": "whether these go instead"},
    {"discard": False},
)
_step(
    "sample",
    "A sample of records.",
    lambda n, df: records.sample(df, float(n.size), n.discard_sample, n.method, n.order_by, n.seed),
    {"size": "number or percentage", "discard_sample": "whether the sample goes instead", "method": "first, random, percent or nth", "order_by": "fields", "seed": "of random numbers"},
    {"size": 1000, "discard_sample": False, "method": "first", "seed": 0},
)
_step(
    "distinct",
    "The first record of each key.",
    lambda n, df: records.distinct(df, n.distinct_fields or n.keys, n.discard, n.order_by),
    {"distinct_fields": "names", "keys": "the same", "discard": "whether the first ones go instead", "order_by": "fields"},
    {"discard": False},
    order=["distinct_fields", "discard"],
)
_step(
    "sort",
    "Records in an order, or the first of it.",
    lambda n, df: records.sort(df, n.order_by or (), n.descending, n.limit),
    {"order_by": "fields", "descending": "whether the order falls, for all fields or each", "limit": "records to keep"},
    {"order_by": [], "descending": False},
)
_step(
    "moving",
    "Append aggregates over a moving frame of one order of all records.",
    lambda n, df: records.moving(df, n.order_by or (), n.measures, int(n.before), int(n.after)),
    {"order_by": "fields", "measures": "aggregation and field by new name", "before": "first place of the frame, from the record's own", "after": "its last place"},
    {"order_by": [], "measures": {}, "before": 0, "after": 0},
)
_step("intersect", "Records that are in all inputs.", lambda n, *inputs: records.intersect(*inputs, keep_all=n.keep_all), {"keep_all": "whether repeated records stay"}, {"keep_all": False}, arity=(1, None))
_step("except", "Records of the first input that are in no other.", lambda n, *inputs: records.subtract(*inputs, keep_all=n.keep_all), {"keep_all": "whether repeated records stay"}, {"keep_all": False}, arity=(1, None))
_step("append", "All records of all inputs.", lambda n, *inputs: records.append(*inputs), {}, arity=(1, None))
_step(
    "append_by_name",
    "All records of all inputs, by field name.",
    lambda n, *inputs: records.append_by_name(*inputs, source_field=n.source_field, names=n.names),
    {"source_field": "field for the input's name", "names": "of inputs"},
    arity=(1, None),
)
_step(
    "merge",
    "Join a master with details.",
    lambda n, *inputs: records.merge(inputs, n.joins, n.master, n.maps, n.how, n.duplicates, n.order_by),
    {"joins": "input, master key and detail key each", "master": "its number", "maps": "field maps by input", "how": "kind of join", "duplicates": "last, first, error or expand", "order_by": "fields by input"},
    {"joins": [], "master": 0, "maps": {}, "how": "inner", "duplicates": "last"},
    arity=(1, None),
)


_step(
    "as_of_join",
    "Join each record with the last one of another input that isn't later.",
    lambda n, a, b: joins.as_of(a, b, n.at, n.by or (), n.right_at, n.right_by, n.direction, n.strict, None, n.how, n.order_by or ()),
    {"at": "field of the time", "by": "keys", "right_at": "field of the time on the right", "right_by": "keys on the right", "direction": "backward or forward", "strict": "whether equal times don't match", "how": "left or inner", "order_by": "fields that order what is at one time on the right"},
    {"by": [], "direction": "backward", "strict": False, "how": "left"},
    arity=(2, 2),
)
_step(
    "interval_join",
    "Join each record with the intervals of another input that hold it.",
    lambda n, a, b: joins.interval_join(a, b, n.at, n.low, n.high, n.by or (), n.interval_by, n.closed, n.how),
    {"at": "field of the value", "low": "field of the begin", "high": "field of the end", "by": "keys", "interval_by": "keys of the intervals", "closed": "ends that belong to an interval: left, right, both or neither", "how": "inner, left, left_semi or left_anti"},
    {"by": [], "closed": "left", "how": "inner"},
    arity=(2, 2),
)
_step(
    "table_function",
    "A record for each row that a function yields of a record's fields.",
    lambda n, df: expand.table_function(df, n.function, n.fields, n.outputs, n.keep_empty, **(n.kwargs or {})),
    {"function": "of the fields' values", "fields": "names", "outputs": "new fields", "keep_empty": "whether records without a row stay", "kwargs": "further arguments"},
    {"keep_empty": False, "kwargs": {}},
    extra="kwargs",
    protected=("function",),
)
_step(
    "field_statistics",
    "Statistics of each field, from sketches that could be kept and united.",
    lambda n, df: statistics.finish(statistics.state(df), n.distinct_threshold, quantiles=n.quantiles or ()),
    {"distinct_threshold": "below which distinct values are listed", "quantiles": "shares"},
    {"distinct_threshold": 10, "quantiles": []},
)
_step("value_types", "Types of the values of each key of JSON objects.", lambda n, df: quality.value_types(df, n.field), {"field": "its name"})


class AggregateNode(
    _step(
        "aggregate",
        "Sum, min, max and average by key.",
        lambda n, df: records.aggregate(df, n.keys, n.measures, n.default_aggregations, n.record_count_field, n.grouping, n.compat),
        {"keys": "names", "measures": "names, or names and aggregations", "default_aggregations": "of measures without", "record_count_field": "name of the count", "grouping": "group, cube or rollup", "compat": "whether minima and maxima start at 0 and averages are whole"},
        {"keys": [], "measures": [], "record_count_field": "record_count", "grouping": "group", "compat": False},
    )
):
    """Sum, min, max and average by key."""

    def add_measure(self, field: str, aggregations=None) -> None:
        self.measures = [*(self.measures or []), (field, aggregations)]


register(AggregateNode)
_step(
    "audit",
    "Counts of records, nulls, empty strings and distinct values of each field.",
    lambda n, df: quality.audit(df, n.distinct_threshold, n.approximate),
    {"distinct_threshold": "below which distinct values are counted", "approximate": "whether by sketches"},
    {"distinct_threshold": 10, "approximate": False},
)


def _check() -> None:
    from millrace.plans.node import _REGISTRY

    for name, cls in _REGISTRY.items():
        if cls.name != name:
            raise StreamError(f"{cls} is not {name}")


_check()
