import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.errors import FieldError
from millrace.schema import Field, FieldList, FieldMap, apply_fields, coalesce_value, collapse, collapse_record, expand, expand_record, retype, with_field

NESTED = {"name": "a", "entity": {"name": "b", "number": 1, "address": {"country": "c"}}}


def test_fields_from_names_tuples_and_dicts():
    fields = FieldList(["a", ("b", "integer"), ["c", "string", "set"], {"name": "d", "storage_type": "float", "label": "D"}, Field("e")])
    assert fields.names() == ["a", "b", "c", "d", "e"]
    assert [f.analytical_type for f in fields] == ["typeless", "discrete", "set", "range", "typeless"]
    assert fields.field("d").label == "D" and str(fields[0]) == "a"
    assert Field("x") == Field("x") and Field("x") != Field("x", label="y")
    for bad in (5, ("a", "b", "c", "d"), {"label": "x"}, ("a", "nothing")):
        with pytest.raises(FieldError):
            Field.of(bad)


def test_field_list_lookup_and_changes():
    fields = FieldList(["a", "b", "c"])
    assert fields.index("b") == 1 and fields.indexes(["c", "a"]) == (2, 0)
    assert fields.selectors(["b"]) == [False, True, False] and fields.selectors() == [True] * 3
    assert "b" in fields and Field("b") in fields and "z" not in fields
    with pytest.raises(KeyError):
        fields.index("z")
    with pytest.raises(KeyError):
        fields.field("z")
    copy = fields.copy(["c"])
    fields += ["d"]
    assert len(fields) == 4 and copy.names() == ["c"] and (copy + ["e"]).names() == ["c", "e"]
    del fields[0]
    fields[0] = ("x", "float")
    assert fields.names() == ["x", "c", "d"]


def test_retype_allows_only_types():
    fields = FieldList(["a"])
    fields.retype({"a": {"storage_type": "integer"}})
    assert fields[0].storage_type == "integer" and fields[0].analytical_type == "discrete"
    for bad in ({"name": "b"}, {"label": "b"}):
        with pytest.raises(FieldError):
            fields.retype({"a": bad})


def test_field_map():
    fields = FieldList(["a", "b", "c"])
    assert FieldMap({"a": "x", "zz": "y"}, drop=["b", "q"]).map(fields).names() == ["x", "c"]
    assert FieldMap(keep=["b"]).map(fields).names() == ["b"]
    assert FieldMap(keep=["b", "c"]).row_filter(fields)([1, 2, 3]) == [2, 3]
    with pytest.raises(FieldError):
        FieldMap(drop=["a"], keep=["b"])


def test_metadata_goes_with_columns(spark):
    df = apply_fields(spark.createDataFrame([("1", "x"), ("z", "-")], "a string, b string"), FieldList([{"name": "a", "storage_type": "integer", "label": "A"}, {"name": "b", "storage_type": "string", "missing_values": ["-"]}]))
    assert [tuple(r) for r in df.collect()] == [(1, "x"), (None, None)]
    kept = FieldList.of_schema(df.filter("a = 1").schema)
    assert kept.field("a").label == "A" and kept.field("a").storage_type == "integer" and kept.field("b").missing_values == ["-"]
    computed = with_field(df, "a", F.col("a") + 1, df.schema["a"])
    assert FieldList.of_schema(computed.schema).field("a").label == "A"
    assert retype(df, {"a": {"storage_type": "string"}}).schema["a"].dataType.simpleString() == "string"


names = st.sampled_from(["a", "b", "ab", "abc"])
leaves = st.sampled_from([0, -7, "", "x", None]) | st.lists(st.integers(0, 9), max_size=2)
trees = leaves | st.dictionaries(names, leaves | st.dictionaries(names, leaves, min_size=1, max_size=2), min_size=1, max_size=3)


@given(st.dictionaries(names, trees, max_size=4))
def test_expand_undoes_collapse(record):
    assert expand_record(collapse_record(record)) == record


def test_collapse_and_expand_tables(spark):
    df = spark.createDataFrame([NESTED], "name string, entity struct<name:string,number:int,address:struct<country:string>>")
    flat = collapse(df)
    assert flat.columns == ["name", "entity.name", "entity.number", "entity.address.country"]
    assert collapse_record(NESTED) == flat.first().asDict()
    assert expand(flat).schema.simpleString() == df.schema.simpleString()
    assert expand(flat).first().asDict(recursive=True) == NESTED


def test_coalesce_value():
    assert coalesce_value("1", "integer") == 1 and coalesce_value(1, "string") == "1" and coalesce_value("1.5", "float") == 1.5
    assert coalesce_value("1 000", "integer") == 1000 and coalesce_value("1,2,3", "list") == ["1", "2", "3"]
    assert coalesce_value("x", "integer") is None and coalesce_value("", "string", {"string": "-"}) == "-"
    assert coalesce_value(" x ", "string", strip=True) == "x"
