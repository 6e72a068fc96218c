"""Building a stream by calling nodes by name on a fork of it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.node import Node, create_node, node_dictionary
from millrace.plans.stream import Stream


class Fork:
    """A place in a stream: ``fork.audit(...)`` appends a node there and moves to it."""

    def __init__(self, stream: Stream, node: Node | None = None):
        self.stream, self.node = stream, node

    def __iadd__(self, node: Node) -> Fork:
        """Append a node."""
        self.stream.add(node)
        if self.node is not None:
            self.stream.connect(self.node, node)
        self.node = node
        return self

    def fork(self) -> Fork:
        """Another fork at the same place."""
        return Fork(self.stream, self.node)

    def set_name(self, name: str) -> None:
        """Name the node at this place."""
        self.stream.rename_node(self.node, name)

    def _joined(self, identifier: str, others: tuple[Fork, ...], kwargs: dict) -> Fork:
        node = create_node(identifier, **kwargs)
        self.stream.add(node)
        for fork in (self, *others):
            if fork.stream is not self.stream:
                raise ValueError("forks of different streams can't meet")
            self.stream.connect(fork.node, node)
        self.node = node
        return self

    def append(self, *forks: Fork) -> Fork:
        """All records of this fork and others."""
        return self._joined("append", forks, {})

    def append_by_name(self, *forks: Fork, **kwargs: Any) -> Fork:
        return self._joined("append_by_name", forks, kwargs)

    def intersect(self, *forks: Fork, **kwargs: Any) -> Fork:
        """Records of this fork that are in all others."""
        return self._joined("intersect", forks, kwargs)

    def subtract(self, *forks: Fork, **kwargs: Any) -> Fork:
        """Records of this fork that are in no other."""
        return self._joined("except", forks, kwargs)

    def merge(self, *forks: Fork, **kwargs: Any) -> Fork:
        """This fork as the master, joined with others as details."""
        return self._joined("merge", forks, kwargs)

    def as_of_join(self, fork: Fork, **kwargs: Any) -> Fork:
        """This fork's records with the last ones of another."""
        return self._joined("as_of_join", (fork,), kwargs)

    def interval_join(self, fork: Fork, **kwargs: Any) -> Fork:
        """This fork's records with the intervals of another that hold them."""
        return self._joined("interval_join", (fork,), kwargs)

    def dataframe(self, spark: SparkSession | None = None) -> DataFrame:
        """The lazy table at this place."""
        return self.stream.compile(spark)[self.stream.node_name(self.node)]

    def __getattr__(self, identifier: str) -> Callable[..., Fork]:
        if identifier.startswith("_"):
            raise AttributeError(identifier)
        if identifier not in node_dictionary():
            raise KeyError(f"no node {identifier!r}")

        def appended(*args: Any, **kwargs: Any) -> Fork:
            self.__iadd__(create_node(identifier, *args, **kwargs))
            return self

        return appended


def create_builder(spark: SparkSession | None = None) -> Fork:
    """A fork of a new stream."""
    return Fork(Stream(spark=spark))
