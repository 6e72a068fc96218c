"""Graphs of nodes, compiled to lazy DataFrames."""

import re

from millrace.plans.builder import Fork, create_builder
from millrace.plans.graph import Graph
from millrace.plans.node import Node, create_node, node_catalogue, node_dictionary, register
from millrace.plans.stream import Stream, stream_from_dict

__all__ = ["Fork", "Graph", "Node", "Stream", "create_builder", "create_node", "node_catalogue", "node_dictionary", "register", "stream_from_dict"]


def __getattr__(name: str):
    """Node classes by name as well: CSVSourceNode is the class of csv_source."""
    if name.endswith("Node") and name != "Node":
        parted = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name.removesuffix("Node"))
        identifier = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", parted).lower()
        if identifier in node_dictionary():
            return node_dictionary()[identifier]
    raise AttributeError(name)
