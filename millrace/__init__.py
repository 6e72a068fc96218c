"""millrace: record-stream analytics and data quality, declared on Spark DataFrames."""

from millrace.errors import ConnectorUnavailable, FieldError, StreamError, StreamRuntimeError
from millrace.plans import Graph, Node, Stream, create_builder, create_node, node_catalogue, node_dictionary, stream_from_dict
from millrace.schema import Field, FieldList, FieldMap, coalesce_value, collapse_record, expand_record, fieldlist

__all__ = [
    "ConnectorUnavailable",
    "Field",
    "FieldError",
    "FieldList",
    "FieldMap",
    "Graph",
    "Node",
    "Stream",
    "StreamError",
    "StreamRuntimeError",
    "coalesce_value",
    "collapse_record",
    "create_builder",
    "create_node",
    "expand_record",
    "fieldlist",
    "node_catalogue",
    "node_dictionary",
    "stream_from_dict",
]
