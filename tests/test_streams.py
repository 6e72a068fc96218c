import io
import json

import pytest

import millrace
from millrace.cli import main, pipe
from millrace.errors import FieldError, StreamError, StreamRuntimeError
from millrace.plans import Graph, Node, Stream, create_builder, create_node, node_catalogue, node_dictionary, register, stream_from_dict
from millrace.schema import FieldList

ROWS = [[1, 2, 3, "a"], [4, 5, 6, "b"], [7, 8, 9, "a"]]
FIELDS = [("a", "integer"), ("b", "integer"), ("c", "integer"), ("str", "string")]


def test_graph():
    g = Graph()
    a, b, c = (create_node(n) for n in ("row_list_source", "audit", "row_list_target"))
    assert g.add(a) == "node1" and g.add(b, "b") == "b" and g.add(c) == "node3"
    with pytest.raises(KeyError):
        g.add(create_node("audit"), "b")
    g.connect("b", c)
    g.connect(a, "b")
    assert g.sorted_nodes() == [a, b, c] and g.node_targets(a) == [b] and g.node_sources("node3") == [b]
    g.rename_node("b", "middle")
    assert g.node_name(b) == "middle" and list(g.nodes) == ["node1", "middle", "node3"]
    assert '"node1" -> "middle"' in g.dot()
    g.connect(b, a)
    with pytest.raises(StreamError):
        g.sorted_nodes()
    g.remove_connection(b, a)
    g.remove("middle")
    assert not g.connections and len(g.nodes) == 2
    with pytest.raises(KeyError):
        g.node("middle")


def test_registry():
    assert {"csv_source", "sample", "append", "merge", "distinct", "aggregate", "select", "function_select", "set_select", "audit"} <= node_dictionary().keys()
    info = node_catalogue()["aggregate"]
    assert info["type"] == "processing" and "keys" in info["attributes"] and info["description"]
    assert node_catalogue()["function_select"]["protected"] == ["function"]
    with pytest.raises(KeyError):
        create_node("nothing")
    node = create_node("sample", 5, method="random")
    node.configure({"size": 7, "unknown": 1})
    assert node.size == 7 and node.identifier() == "sample"
    with pytest.raises(StreamError):
        create_node("function_select").configure({"function": print}, protected=True)
    with pytest.raises(TypeError):
        create_node("sample", nothing=1)


def described():
    nodes = {
        "source": {"type": "row_list_source"},
        "map": {"type": "field_map", "drop_fields": ["c"]},
        "aggregate": {"type": "aggregate", "keys": ["str"]},
        "one": {"type": "row_list_target"},
        "two": {"type": "record_list_target"},
    }
    return {"nodes": nodes, "connections": [["source", "map"], ["map", "one"], ["source", "aggregate"], ["aggregate", "two"]]}


def test_described_stream_runs(spark):
    stream = stream_from_dict(described(), spark)
    assert stream.node("aggregate").keys == ["str"]
    stream.configure([{"node": "source", "attribute": "list", "value": ROWS}, {"node": "source", "config": {"fields": FIELDS}}])
    stream.run()
    assert stream.node("one").rows == [(1, 2, "a"), (4, 5, "b"), (7, 8, "a")]
    assert sorted((r["str"], r["record_count"]) for r in stream.node("two").records) == [("a", 2), ("b", 1)]
    with pytest.raises(StreamError):
        stream.configure([{"node": "source", "attribute": "nothing"}])
    with pytest.raises(StreamError):
        Stream({"x": {"label": "no type"}})


def test_failures_name_the_node(spark):
    main = create_builder(spark)
    main.row_list_source(ROWS, FIELDS)
    main.select("nothing > 1")
    main.set_name("choice")
    main.row_list_target()
    with pytest.raises(StreamRuntimeError) as caught:
        main.stream.run()
    assert caught.value.node == "choice" and caught.value.identifier == "select" and isinstance(caught.value.__cause__, FieldError)
    out = io.StringIO()
    caught.value.print_exception(out)
    assert "choice" in out.getvalue() and "condition" in out.getvalue()
    two = Stream({"a": create_node("audit")}, [], spark)
    with pytest.raises(StreamError):
        two.run()

    @register
    class Failing(Node):
        """Fails."""

        name = "failing_for_tests"

        def transform(self, df):
            raise RuntimeError("no")

    main = create_builder(spark)
    main.row_list_source(ROWS, FIELDS).failing_for_tests().row_list_target()
    with pytest.raises(StreamRuntimeError, match="no"):
        main.stream.run()


def test_builder(spark):
    main = create_builder(spark)
    main.csv_source("foo")
    assert len(main.stream.nodes) == 1 and main.node.identifier() == "csv_source"
    with pytest.raises(KeyError):
        main.nothing()
    main = create_builder(spark)
    main.row_list_source(ROWS, FIELDS)
    other = main.fork()
    other.aggregate(keys=["str"], measures=["a"])
    other.node.add_measure("b", ["sum"])
    main += create_node("derive", "a + b", "ab")
    main.merge(other, joins=[(1, "str")], maps={1: {"drop": ["str"]}})
    out = main.dataframe(spark)
    assert out.columns == ["a", "b", "c", "str", "ab", "a_sum", "a_min", "a_max", "a_average", "b_sum", "record_count"]
    assert sorted((r.ab, r.a_sum) for r in out.collect()) == [(3, 8), (9, 4), (15, 8)]
    third = create_builder(spark)
    third.row_list_source(ROWS, FIELDS)
    copy = third.fork()
    copy.select("a > 1")
    assert third.append(copy).dataframe(spark).count() == 5
    with pytest.raises(ValueError):
        third.append(main)
    third.node.retype({"a": {"storage_type": "string"}})
    assert third.dataframe(spark).schema["a"].dataType.simpleString() == "string"
    third.node.reset_type("a")
    assert FieldList.of_schema(third.dataframe(spark).schema).field("a").storage_type == "integer"


def test_shared_input_is_read_once_and_let_go(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(a, b, c, str):
        calls.add(1)
        return int(a) > 0

    stream = stream_from_dict(described(), spark)
    stream.node("source").list, stream.node("source").fields = ROWS, FIELDS
    stream.add(create_node("select", counted), "counted")
    stream.remove_connection("source", "map")
    stream.remove_connection("source", "aggregate")
    for a, b in (("source", "counted"), ("counted", "map"), ("counted", "aggregate")):
        stream.connect(a, b)
    stream.run()
    assert calls.value == 3 + 1  # and once with columns, to see if it is native


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "in.csv"
    path.write_text("k,v\na,1\na,2\nb,3\n")
    stream = pipe(["csv_source", f"resource={path}", "aggregate", 'keys=["k"]', "record_list_target"])
    stream.run(spark)
    assert sorted((r["k"], r["record_count"]) for r in stream.node("node3").records) == [("a", 2), ("b", 1)]
    with pytest.raises(SystemExit):
        pipe(["csv_source", "nothing=1"])
    with pytest.raises(SystemExit):
        pipe(["nothing"])
    assert [n.identifier() for n in pipe(["audit"]).nodes.values()] == ["csv_source", "audit", "csv_target"]
    description = {
        "nodes": {"s": {"type": "csv_source", "resource": str(path)}, "t": {"type": "csv_target", "resource": str(tmp_path / "out.csv")}},
        "connections": [["s", "t"]],
    }
    (tmp_path / "s.json").write_text(json.dumps(description))
    assert main(["run", str(tmp_path / "s.json")]) == 0 and (tmp_path / "out.csv").read_text().splitlines()[1] == "a,1"
    main(["graph", str(tmp_path / "s.json")])
    main(["nodes"])
    main(["nodes", "sample"])
    main(["nodes", "--markdown"])
    main(["audit", str(path), "--source", "csv", "--format", "json"])
    main(["audit", str(path), "--source", "csv", "--threshold", "2"])
    out = capsys.readouterr().out
    assert '"s" -> "t"' in out and "value_threshold" in out and "## value_threshold" in out and "- `discard_sample`:" in out and "discard_sample" in out and '"null_count": 0' in out and "more than 1 values" in out


def test_names(spark):
    from millrace.plans import CoalesceValueToTypeNode, CSVSourceNode, SQLTableTargetNode

    assert CSVSourceNode("x").identifier() == "csv_source" and SQLTableTargetNode("u", "t", True).truncate and CoalesceValueToTypeNode().types is None
    with pytest.raises(ImportError):
        from millrace.plans import NothingNode  # noqa: F401
    with pytest.raises(TypeError):
        create_node("audit", 1, 2, 3)
    numbers = create_node("generator_function_source", lambda a, b, step: ([i] for i in range(a, b, step)), ["i"], 0, 10, step=3)
    assert [r.i for r in numbers.output(spark, []).collect()] == [0, 3, 6, 9]
    assert millrace.create_builder and millrace.fieldlist is millrace.FieldList
