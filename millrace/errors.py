"""Errors of schemas, graphs and runs."""

from __future__ import annotations


class FieldError(Exception):
    """A field that is missing, unknown or used against its type."""


class StreamError(Exception):
    """A graph that can't be built or started."""


class StreamRuntimeError(StreamError):
    """A node that failed; carries the node's name, identifier, attributes and input schemas."""

    def __init__(self, message: str, node: str | None = None, identifier: str | None = None, attributes: dict | None = None, inputs: list | None = None):
        super().__init__(message)
        self.node, self.identifier, self.attributes, self.inputs = node, identifier, attributes or {}, inputs or []

    def describe(self) -> str:
        lines = [f"stream failed: {self}", f"node: {self.node} ({self.identifier})"]
        lines += [f"  {k} = {v!r}" for k, v in self.attributes.items()]
        lines += [f"input {i}: {s}" for i, s in enumerate(self.inputs)]
        return "\n".join(lines)

    def print_exception(self, output=None) -> None:
        print(self.describe(), file=output)


class ConnectorUnavailable(StreamError):
    """A connector whose package or service isn't there."""
