"""Named nodes and ordered connections."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from typing import Any

from millrace.errors import StreamError
from millrace.plans.node import Node


class Graph:
    """A directed graph without cycles. The inputs of a node come in the order in which they were connected."""

    def __init__(self, nodes: dict[str, Node] | None = None, connections: Iterable | None = None):
        self.nodes: dict[str, Node] = {}
        self.connections: list[tuple[Node, Node]] = []
        for name, node in (nodes or {}).items():
            self.add(node, name)
        for source, target in connections or ():
            self.connect(source, target)

    def _free_name(self) -> str:
        i = len(self.nodes) + 1
        while f"node{i}" in self.nodes:
            i += 1
        return f"node{i}"

    def add(self, node: Node, name: str | None = None) -> str:
        name = name or self._free_name()
        if name in self.nodes:
            raise KeyError(f"there is a node {name!r} already")
        self.nodes[name] = node
        return name

    def node(self, reference: Any) -> Node:
        """A node by itself or by name."""
        if isinstance(reference, Node):
            return reference
        if reference not in self.nodes:
            raise KeyError(f"no node {reference!r}")
        return self.nodes[reference]

    coalesce_node = node

    def node_name(self, node: Node) -> str | None:
        return next((n for n, x in self.nodes.items() if x is node), None)

    def rename_node(self, reference: Any, name: str) -> None:
        node = self.node(reference)
        if name in self.nodes and self.nodes[name] is not node:
            raise KeyError(f"there is a node {name!r} already")
        self.nodes = {name if x is node else n: x for n, x in self.nodes.items()}

    def remove(self, reference: Any) -> None:
        """Take a node and its connections out."""
        node = self.node(reference)
        self.nodes = {n: x for n, x in self.nodes.items() if x is not node}
        self.connections = [(a, b) for a, b in self.connections if a is not node and b is not node]

    def connect(self, source: Any, target: Any) -> None:
        self.connections.append((self.node(source), self.node(target)))

    def remove_connection(self, source: Any, target: Any) -> None:
        a, b = self.node(source), self.node(target)
        self.connections = [(x, y) for x, y in self.connections if x is not a or y is not b]

    def node_sources(self, reference: Any) -> list[Node]:
        node = self.node(reference)
        return [a for a, b in self.connections if b is node]

    def node_targets(self, reference: Any) -> list[Node]:
        node = self.node(reference)
        return [b for a, b in self.connections if a is node]

    def sorted_nodes(self) -> list[Node]:
        """Nodes after all that they take input from."""
        waiting = {id(n): len(self.node_sources(n)) for n in self.nodes.values()}
        ready = deque(n for n in self.nodes.values() if not waiting[id(n)])
        out = []
        while ready:
            out.append(node := ready.popleft())
            for following in self.node_targets(node):
                waiting[id(following)] -= 1
                if not waiting[id(following)]:
                    ready.append(following)
        if len(out) < len(self.nodes):
            raise StreamError("the graph has a cycle")
        return out

    def dot(self) -> str:
        """The graph for Graphviz."""
        names = {id(x): n for n, x in self.nodes.items()}
        lines = [f'  "{n}" [label="{x.identifier()}"];' for n, x in self.nodes.items()]
        lines += [f'  "{names[id(a)]}" -> "{names[id(b)]}";' for a, b in self.connections]
        return "\n".join(["digraph stream {", *lines, "}"])
