"""Running a graph: nodes become lazy DataFrames in order, and targets start the jobs."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.errors import StreamError, StreamRuntimeError
from millrace.plans.graph import Graph
from millrace.plans.node import Node, create_node


class Stream(Graph):
    """A graph that runs. Nodes may be given as dicts with a ``type``."""

    def __init__(self, nodes: dict | Iterable | None = None, connections: Iterable | None = None, spark: SparkSession | None = None):
        super().__init__()
        self.spark = spark
        self.update(nodes, connections)

    def update(self, nodes: dict | Iterable | None = None, connections: Iterable | None = None) -> None:
        """Add nodes and connections, each of them ready or described."""
        listed = nodes.items() if isinstance(nodes, dict) else ((n.get("name") if isinstance(n, dict) else None, n) for n in nodes or ())
        for name, node in listed:
            self.add(node if isinstance(node, Node) else _made(node), name)
        for pair in connections or ():
            if isinstance(pair, dict):
                pair = (pair["source"], pair["target"])
            self.connect(*pair)

    def configure(self, config: Iterable[dict] | None = None) -> None:
        """Set attributes: dicts of node, attribute and value, or of node and config."""
        for entry in config or ():
            node = self.node(entry.get("node") or entry.get("node_name"))
            if "attribute" in entry:
                if entry["attribute"] not in node.attributes:
                    raise StreamError(f"{node.identifier()} has no attribute {entry['attribute']!r}")
                node.configure({entry["attribute"]: entry.get("value")}, protected=True)
            if "config" in entry:
                node.configure(entry["config"], protected=True)

    def fork(self) -> Any:
        from millrace.plans.builder import Fork

        return Fork(self)

    def compile(self, spark: SparkSession | None = None) -> dict[str, DataFrame]:
        """The lazy output of each node that isn't a target, by name; nothing runs but what reading schemas needs."""
        return {n: d for n, d in self._compiled(spark).items() if d is not None}

    def _session(self, spark: SparkSession | None) -> SparkSession:
        return spark or self.spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()

    def _compiled(self, spark: SparkSession | None) -> dict[str, DataFrame | None]:
        session, out = self._session(spark), {}
        names = {id(x): n for n, x in self.nodes.items()}
        for node in self.sorted_nodes():
            name = names[id(node)]
            inputs = [out[names[id(s)]] for s in self.node_sources(node)]
            least, most = node.arity
            if any(i is None for i in inputs):
                raise StreamError(f"{name} takes input from a target")
            if len(inputs) < least or (most is not None and len(inputs) > most):
                raise StreamError(f"{name} ({node.identifier()}) has {len(inputs)} inputs")
            out[name] = None if node.kind == "target" else self._guarded(name, node, inputs, lambda n=node, i=inputs: n.output(session, i))
        return out

    @staticmethod
    def _guarded(name: str, node: Node, inputs: list[DataFrame], step):
        try:
            return step()
        except StreamRuntimeError:
            raise
        except Exception as e:
            raise StreamRuntimeError(f"{type(e).__name__}: {e}", name, node.identifier(), node.settings(), [d.schema.simpleString() for d in inputs]) from e

    def run(self, spark: SparkSession | None = None) -> None:
        """Run all targets. What several of them are made from is kept for the time of the run."""
        outputs = self._compiled(spark)
        names = {id(x): n for n, x in self.nodes.items()}
        reached = {n: len(self._targets_below(x)) for n, x in self.nodes.items()}
        kept = []
        try:
            for name, node in self.nodes.items():
                below = self.node_targets(node)
                if outputs[name] is not None and reached[name] > 1 and len(below) > 1 and not outputs[name].isStreaming:
                    kept.append(outputs[name].persist())
            for node in self.sorted_nodes():
                if node.kind == "target":
                    inputs = [outputs[names[id(s)]] for s in self.node_sources(node)]
                    self._guarded(names[id(node)], node, inputs, lambda n=node, i=inputs: n.write(i[0]))
        finally:
            for df in kept:
                df.unpersist()

    def _targets_below(self, node: Node) -> list[Node]:
        found, todo, seen = [], [node], set()
        while todo:
            here = todo.pop()
            if id(here) in seen:
                continue
            seen.add(id(here))
            if here.kind == "target":
                found.append(here)
            todo += self.node_targets(here)
        return found


def _made(description: dict) -> Node:
    if "type" not in description:
        raise StreamError(f"a node needs a type: {description!r}")
    node = create_node(description["type"])
    node.configure({k: v for k, v in description.items() if k not in ("type", "name")})
    return node


def stream_from_dict(description: dict, spark: SparkSession | None = None) -> Stream:
    return Stream(description.get("nodes"), description.get("connections"), spark)


def stream_from_json(resource: str, spark: SparkSession | None = None) -> Stream:
    """A stream described in a JSON file, by path or URL."""
    from millrace.sources.resources import open_resource

    handle, close = open_resource(resource)
    try:
        return stream_from_dict(json.load(handle), spark)
    finally:
        if close:
            handle.close()
