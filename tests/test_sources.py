import io
import uuid

import pytest

from millrace.errors import ConnectorUnavailable, FieldError, StreamError
from millrace.schema import FieldList
from millrace.sources import (
    CSVSource,
    CSVTarget,
    FileSource,
    FormattedPrinter,
    GeneratorSource,
    HTMLTarget,
    MongoSource,
    PrettyPrinter,
    RecordListSource,
    ScraperWikiSource,
    SQLSource,
    SQLTarget,
    StreamAuditor,
    YamlDirectorySource,
    YamlDirectoryTarget,
    infer_fields,
)

TEXT = 'id,name,type,location.name,location.code,amount\n1,"one, two",a,here,h,10\n2,,b,there,t,x\n3,"say ""so""",c,,,30\n'


@pytest.fixture
def path(tmp_path):
    file = tmp_path / "test.csv"
    file.write_text(TEXT)
    return str(file)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_csv_header_types_and_nulls(spark, path):
    source = CSVSource(path)
    df = source.read(spark)
    assert df.columns == ["id", "name", "type", "location.name", "location.code", "amount"] and source.fields.names() == df.columns
    assert rows(df)[0] == ("1", "one, two", "a", "here", "h", "10") and rows(df)[1][1] is None and rows(df)[2][1] == 'say "so"'
    typed = CSVSource(path, fields=["id", "name", "type", "ln", "lc", ("amount", "integer")]).read(spark)
    assert [r.amount for r in typed.collect()] == [10, None, 30]
    assert rows(CSVSource(path, empty_as_null=False).read(spark))[1][1] == ""
    assert rows(CSVSource(io.StringIO(TEXT)).read(spark)) == rows(df) and rows(CSVSource(io.BytesIO(TEXT.encode())).read(spark)) == rows(df)
    assert len(list(CSVSource(path).records(spark))) == 3 and next(CSVSource(path).rows(spark))[0] == "1"


def test_csv_dialects_skipping_and_sniffing(spark, tmp_path):
    tabs = tmp_path / "tabs.csv"
    tabs.write_text("name\ttype\tamount\nx\ty\t1\nz\tw\t2\n")
    assert rows(CSVSource(str(tabs), dialect="excel-tab").read(spark)) == [("x", "y", "1"), ("z", "w", "2")]
    assert rows(CSVSource(str(tabs), delimiter="\t").read(spark))[0] == ("x", "y", "1")
    with pytest.raises(ValueError):
        CSVSource(str(tabs), dialect="none").read(spark)
    skipped = tmp_path / "skip.csv"
    skipped.write_text("a note\nanother\nid,amount\n1,5\n2,6\n")
    assert rows(CSVSource(str(skipped), skip_rows=2).read(spark)) == [("1", "5"), ("2", "6")]
    assert rows(CSVSource(str(skipped), skip_rows=3, read_header=False, fields=[("a", "integer"), ("b", "integer")]).read(spark)) == [(1, 5), (2, 6)]
    sniffed = tmp_path / "sniff.csv"
    sniffed.write_text("id,amount\n" + "".join(f"{i},{i * 10}\n" for i in range(20)))
    assert CSVSource(str(sniffed), detect_header=True).read(spark).count() == 20
    with pytest.raises(FieldError):
        CSVSource(str(sniffed), read_header=False).read(spark)
    latin = tmp_path / "latin.csv"
    latin.write_bytes("n\nä\n".encode("latin-1"))
    assert rows(CSVSource(str(latin), encoding="latin-1").read(spark)) == [("ä",)]


def test_csv_targets(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "i int, s string")
    out = tmp_path / "out.csv"
    CSVTarget(str(out), single=True).write(df)
    CSVTarget(str(out), single=True, truncate=False).write(df)
    assert out.read_text().splitlines() == ["i,s", '1,"a,b"', "2,", '1,"a,b"', "2,"]
    CSVTarget(str(tmp_path / "many")).write(df)
    assert sorted(rows(CSVSource(str(tmp_path / "many"), fields=[("i", "integer"), "s"]).read(spark))) == [(1, "a,b"), (2, None)]
    handle = io.StringIO()
    CSVTarget(handle, write_headers=False, fields=["s", "none"]).write(df)
    assert handle.getvalue().splitlines() == ['"a,b",', ","]


def test_memory(spark):
    assert rows(RecordListSource([{"a": 1}, {"b": "x", "a": 2}]).read(spark)) == [(1, None), (2, "x")]
    assert rows(GeneratorSource(lambda start, end: ([i] for i in range(start, end)), ["i"], 0, 5).read(spark)) == [(i,) for i in range(5)]
    with pytest.raises(FieldError):
        GeneratorSource(lambda: [], None).read(spark)


def test_yaml(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None), (2, "ä: y", 2.5)], "`a.i` int, s string, f double")
    YamlDirectoryTarget(str(tmp_path / "y"), expand=True, filename_template="r${__index}_${s}.yml", filename_start_index=3).write(df.limit(1))
    YamlDirectoryTarget(str(tmp_path / "y"), expand=True).write(df.filter("s != 'x'"))
    (tmp_path / "y" / "other.txt").write_text("a: 1")
    source = YamlDirectorySource(str(tmp_path / "y"), expand=True, filename_field="file", fields=[("a.i", "integer"), ("s", "string"), ("f", "float"), "file", "none"])
    assert sorted(rows(source.read(spark))) == [(1, "x", None, "r3_x.yml", None), (2, "ä: y", 2.5, "record_0.yml", None)]
    (tmp_path / "file").write_text("")
    with pytest.raises(OSError):
        YamlDirectoryTarget(str(tmp_path / "file")).write(df)


def test_tables(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "s string, i int")
    spark.sql("drop table if exists t_sources")
    with pytest.raises(StreamError):
        SQLTarget(table="t_sources").write(df)
    SQLTarget(table="t_sources", create=True).write(df)
    with pytest.raises(ValueError):
        SQLTarget(table="t_sources", create=True).write(df)
    SQLTarget(table="t_sources").write(df)
    assert SQLSource(table="t_sources").read(spark).count() == 4
    SQLTarget(table="t_sources", truncate=True).write(df)
    SQLTarget(table="t_sources", create=True, replace=True, add_id_key=True).write(df)
    assert sorted(rows(SQLSource(statement="select * from t_sources").read(spark))) == [(1, "a", 1), (2, "b", 2)]
    assert SQLSource(table="t_sources", fields=[("i", "float")]).read(spark).dtypes == [("i", "double")]
    with pytest.raises(StreamError):
        SQLSource().read(spark)
    target = SQLTarget(table="t", concrete_type_map={"string": "VARCHAR(10)"})
    assert target.column_types(FieldList([("s", "string"), {"name": "t", "storage_type": "text", "concrete_storage_type": "CLOB"}, ("i", "integer")])) == "`s` VARCHAR(10), `t` CLOB"


def test_printers(spark):
    df = spark.createDataFrame([(1, "a"), (22, None)], "i int, s string")
    out = io.StringIO()
    FormattedPrinter("{i:03d} {s}", out, header="head", footer="foot").write(df)
    FormattedPrinter(target=out).write(df)
    assert out.getvalue().splitlines() == ["head", "001 a", "022 None", "foot", "i\ts", "1\ta", "22\tNone"]
    out = io.StringIO()
    PrettyPrinter(out, min_column_width=3).write(df)
    assert out.getvalue().splitlines() == ["+---+---+", "|i  |s  |", "+---+---+", "|  1|a  |", "| 22|   |", "+---+---+"]
    out = io.StringIO()
    HTMLTarget(out, html_header=None, table_attributes={"class": "x"}).write(spark.createDataFrame([("<b>", None)], "s string, t string"))
    assert out.getvalue() == '<table class="x">\n<tr><th>s</th><th>t</th></tr>\n<tr><td>&lt;b&gt;</td><td></td></tr>\n</table>\n'
    out = io.StringIO()
    HTMLTarget(out, html_footer="end", escape=False).write(spark.createDataFrame([("<b>",)], "s string"))
    assert out.getvalue().startswith("<!DOCTYPE html>") and "<td><b></td>" in out.getvalue() and out.getvalue().endswith("end")


def test_inference_files_and_auditor(spark, tmp_path):
    df = spark.createDataFrame([("1", "1.5", "x", "2020-01-01"), (None, "2", "y", "2021-01-01")], "i string, f string, s string, d string")
    assert [f.storage_type for f in infer_fields(df)] == ["integer", "float", "string", "date"]
    df.write.parquet(str(tmp_path / "p"))
    assert FileSource(str(tmp_path / "p"), fields=[("i", "integer")]).read(spark).dtypes == [("i", "bigint")]
    auditor = StreamAuditor()
    auditor.write(df)
    assert auditor.field_statistics["i"]["null_count"] == 1


def test_missing_services(spark):
    with pytest.raises(ConnectorUnavailable):
        ScraperWikiSource("x").read(spark)
    with pytest.raises(ConnectorUnavailable):
        MongoSource("c", "d").read(spark)


def test_jdbc_tables(spark):
    """Over the database that comes with Spark, in this process' memory."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, 1.5), (3, "c", None)], "k int, name string, x double")
    with pytest.raises(StreamError):
        SQLTarget(url, "things").write(df)
    SQLTarget(url, "things", create=True).write(df)
    with pytest.raises(ValueError):
        SQLTarget(url, "things", create=True).write(df)
    SQLTarget(url, "things").write(df.filter("k = 1"))
    rows = lambda **given: sorted((r[0], r[1]) for r in SQLSource(url, **given).read(spark).select("K", "NAME").collect())
    assert rows(table="things") == [(1, "a"), (1, "a"), (2, None), (3, "c")]
    assert rows(statement='select "k" as k, "name" as name from things where "k" > 2') == [(3, "c")]
    assert rows(table="things", partitioning=("k", 1, 3, 2)) == [(1, "a"), (1, "a"), (2, None), (3, "c")]
    SQLTarget(url, "things", truncate=True, add_id_key=False).write(df.filter("k = 2"))
    assert rows(table="things") == [(2, None)]
