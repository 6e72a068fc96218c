"""Nodes: a configuration, and a function from input DataFrames to a DataFrame or, for a target, an action."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.errors import StreamError
from millrace.schema import FieldList
from millrace.schema import retype as retype_columns

_REGISTRY: dict[str, type[Node]] = {}


class Node:
    """One step of a graph.

    ``attributes`` names what can be configured, with a line on each; ``protected`` what a configuration from outside may not
    set. A subclass gives ``transform``; sources give ``read`` and targets ``write`` instead.
    """

    name = ""
    kind = "processing"
    label = ""
    attributes: dict[str, str] = {}
    protected: tuple[str, ...] = ()
    #: Numbers of inputs, least and most.
    arity: tuple[int, int | None] = (1, 1)

    def __init__(self) -> None:
        self.retyped: dict[str, dict] = {}

    def identifier(self) -> str:
        return self.name

    def configure(self, config: dict, protected: bool = False) -> None:
        """Set attributes by name; unknown ones are ignored. With ``protected`` a protected one raises."""
        for key, value in config.items():
            if key not in self.attributes:
                continue
            if protected and key in self.protected:
                raise StreamError(f"attribute {key!r} of {self.name} is protected")
            setattr(self, key, value)

    def settings(self) -> dict[str, Any]:
        return {k: getattr(self, k, None) for k in self.attributes}

    def retype(self, changes: dict[str, dict]) -> None:
        """Change types of fields that the node puts out."""
        self.retyped |= changes

    def reset_type(self, name: str) -> None:
        self.retyped.pop(name, None)

    def read(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def transform(self, *inputs: DataFrame) -> DataFrame:
        raise NotImplementedError

    def write(self, df: DataFrame) -> None:
        raise NotImplementedError

    def output(self, spark: SparkSession, inputs: list[DataFrame]) -> DataFrame:
        out = self.read(spark) if self.kind == "source" else self.transform(*inputs)
        return retype_columns(out, self.retyped) if self.retyped else out

    def output_fields(self, spark: SparkSession, *inputs: DataFrame) -> FieldList:
        return FieldList.of_schema(self.output(spark, list(inputs)).schema)


def register(cls: type[Node]) -> type[Node]:
    """Make a node class known by its name."""
    if not cls.name:
        raise StreamError(f"{cls.__name__} has no name")
    _REGISTRY[cls.name] = cls
    return cls


def node_dictionary() -> dict[str, type[Node]]:
    from millrace.plans import nodes  # noqa: F401  the classes register themselves

    return dict(_REGISTRY)


def create_node(identifier: str, *args: Any, **kwargs: Any) -> Node:
    found = node_dictionary()
    if identifier not in found:
        raise KeyError(f"no node {identifier!r}")
    return found[identifier](*args, **kwargs)


def node_catalogue() -> dict[str, dict]:
    """What there is to know about each node: type, label, description, attributes and protected ones."""
    return {
        name: {"name": name, "type": cls.kind, "label": cls.label or name.replace("_", " ").capitalize(), "description": (cls.__doc__ or "").strip(), "attributes": dict(cls.attributes), "protected": list(cls.protected)}
        for name, cls in sorted(node_dictionary().items())
    }
