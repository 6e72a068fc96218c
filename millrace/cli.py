"""Command line: run, graph, pipe, nodes and audit.

    python -m millrace pipe csv_source resource=data.csv audit pretty_printer
"""

from __future__ import annotations

import argparse
import importlib
import json
import re
import sys

from millrace.operators.quality import field_statistics
from millrace.plans import Stream, create_node, node_catalogue
from millrace.plans.stream import stream_from_json


def _session():
    from millrace.session import local_session

    return local_session()


def _value(text: str):
    """JSON if it is, else the text itself."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def pipe(tokens: list[str]) -> Stream:
    """Nodes in a row; name=value sets an attribute of the node before. Text from stdin and to stdout unless told otherwise."""
    nodes: list = []
    for token in tokens:
        if m := re.fullmatch(r"(\w+)=(.*)", token, re.S):
            if not nodes:
                raise SystemExit(f"{token}: there is no node before it")
            if m[1] not in nodes[-1].attributes:
                raise SystemExit(f"{nodes[-1].identifier()} has no attribute {m[1]}")
            nodes[-1].configure({m[1]: _value(m[2])})
        else:
            try:
                nodes.append(create_node(token))
            except KeyError:
                raise SystemExit(f"no node {token!r}") from None
    if not nodes or nodes[0].kind != "source":
        nodes.insert(0, create_node("csv_source", sys.stdin.buffer))
    if nodes[-1].kind != "target":
        nodes.append(create_node("csv_target", sys.stdout))
    stream = Stream()
    names = [stream.add(n) for n in nodes]
    for a, b in zip(names, names[1:]):
        stream.connect(a, b)
    return stream


def reference(catalogue: dict[str, dict]) -> str:
    """Nodes by type, with their attributes, in Markdown."""
    out = []
    for kind in ("source", "processing", "target"):
        out.append(f"# {kind.capitalize()} nodes\n")
        for name, info in catalogue.items():
            if info["type"] == kind:
                out.append(f"## {name}\n\n{info['description']}\n")
                out.append("".join(f"- `{k}`: {v}\n" for k, v in info["attributes"].items()))
    return "\n".join(out)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--extension", action="append", default=[], help="module whose nodes are to be registered")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("run", "run a stream described in JSON"), ("graph", "print it for Graphviz")):
        commands.add_parser(name, help=text).add_argument("path")
    commands.add_parser("pipe", help="run nodes in a row").add_argument("tokens", nargs=argparse.REMAINDER)
    listed = commands.add_parser("nodes", help="list nodes, or describe one")
    listed.add_argument("name", nargs="?")
    listed.add_argument("--markdown", action="store_true", help="as a reference for reading")
    audited = commands.add_parser("audit", help="field statistics of a table")
    audited.add_argument("path")
    audited.add_argument("--source", default="parquet", choices=("parquet", "csv", "json", "orc"))
    audited.add_argument("--format", default="text", choices=("text", "json"))
    audited.add_argument("--threshold", type=int, default=10)
    given = parser.parse_args(arguments)
    for module in given.extension:
        importlib.import_module(module)
    if given.command == "run":
        stream_from_json(given.path, _session()).run()
    elif given.command == "graph":
        print(stream_from_json(given.path).dot())
    elif given.command == "pipe":
        pipe(given.tokens).run(_session())
    elif given.command == "nodes":
        known = node_catalogue()
        if given.name and given.name not in known:
            raise SystemExit(f"no node {given.name!r}")
        chosen = known if not given.name else {given.name: known[given.name]}
        if given.markdown:
            print(reference(chosen))
            return 0
        for name, info in chosen.items():
            print(f"{name} ({info['type']}): {info['description'].splitlines()[0] if info['description'] else ''}")
            if given.name:
                print("".join(f"    {k}: {v}\n" for k, v in info["attributes"].items()), end="")
    else:
        _audit(given)
    return 0


def _audit(given) -> None:
    spark = _session()
    df = spark.read.format(given.source).options(**({"header": "true"} if given.source == "csv" else {})).load(given.path)
    rows = [r.asDict() for r in field_statistics(df, given.threshold).collect()]
    if given.format == "json":
        print(json.dumps(rows, indent=2, default=str))
        return
    for r in rows:
        print(f"{r['field']}: {r['storage_type']}, {r['record_count']} records, {r['null_count']} null ({r['null_record_ratio']:.2%}), {r['empty_string_count']} empty, ", end="")
        print(f"more than {given.threshold - 1} values" if r["distinct_overflow"] else f"{r['distinct_count']} values")


if __name__ == "__main__":
    sys.exit(main())
