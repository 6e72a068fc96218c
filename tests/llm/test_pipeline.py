import inspect
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c
from millrace.llm import decontaminate, lines, minhash, packing
from tests.llm.data import clashing, edited, frame, prose


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "\n".join(prose(rng, 30) for _ in range(4)), "en", f"src{i % 3}") for i in range(80)]
    rows += [(100, rows[0][1], "en", "a"), (101, edited(rng, rows[1][1].replace("\n", " "), 1), "en", "a")]
    rows += [(200 + i, " ".join(w + "###" for w in prose(rng, 60).split()), "en", "b") for i in range(40)]
    items = [(0, prose(rng, 40, 5000)), (1, prose(rng, 5, 6000))]
    rows += [(300, "\n".join([prose(rng, 30), prose(rng, 30), items[0][1], prose(rng, 30)]), "en", "c"), (301, None, None, None), (302, "", "en", "c")]
    df = frame(spark, rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(i, 1, 0) for i in range(80)] + [(200 + i, 0, 0) for i in range(40)]
    frame(spark, labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages(spark, tables):
    assert [n for n, _ in c.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "packing"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    seen = []
    for name, stage in c.STAGES:
        out = stage(spark, docs, tables)
        if name != "packing":
            assert out.columns == docs.columns
            out = out.checkpoint() if spark.sparkContext.getCheckpointDir() else out.cache()
            seen.append({r.doc_id: r.text for r in out.collect()})
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
            docs = out
    quality, by_line, near, clean = seen
    assert {i for i in quality if i is not None and 200 <= i < 300} == set() and set(range(80)) <= set(quality)
    assert 100 not in by_line and by_line[0] == quality[0] and by_line.keys() >= set(range(80))
    assert 300 in near and 300 not in clean and set(range(80)) - {1} <= set(clean)
    brute = minhash.brute_force(list(by_line.items()), c.SHINGLE, c.PERCENT)
    assert set(near) == {i for i, (_, top) in brute.items() if i == top}
    hits = decontaminate.brute_force(list(near.items()), [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()])
    assert set(clean) == {i for i in near if not hits[i][3]}
    first = lines.brute_force(list(quality.items()), c.LINE_THRESHOLD)
    for i, text in by_line.items():
        kept = [x for n, x in enumerate((quality[i] or "").split("\n")) if first.get((i, n), (i, n))[:2] == (i, n)]
        assert (text or "") == "\n".join(kept)
    packed = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in packed} == set(clean) and all(r.n == r.t for r in packed)


def test_run_is_all_stages(spark, tables):
    out = c.run(spark, tables)
    assert {"doc_id", "start", "length", "sequence_id"} <= set(out.columns) and out.count() > 70


def test_stages_keep_columns_and_take_empty_tables(spark, tables):
    docs = clashing(spark.read.parquet(f"{tables}/documents.parquet")).filter("doc_id < 20")
    for _, stage in c.STAGES[:-1]:
        assert stage(spark, docs, tables).columns == docs.columns
        assert stage(spark, docs.limit(0), tables).count() == 0


def test_very_long_texts_repeated_rows_and_null_ids(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").filter("doc_id < 30")
    long = "\n".join(f"line {i} of a long text with words enough {i * i}" for i in range(30_000))
    more = frame(spark, [(900, long, "en", "a", len(long)), (900, long, "en", "a", len(long)), (None, "no id", "en", "a", 5), (None, "no id", "en", "a", 5)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.unionByName(more)
    for name, stage in c.STAGES[1:4]:
        docs = stage(spark, docs, tables)
    out = docs.collect()
    assert [len(r.text) for r in out if r.doc_id == 900] == [len(long)] and sum(r.doc_id is None for r in out) == 2
    packed = packing.pack(docs).filter("doc_id = 900").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).first()
    assert packed.n == packed.t > 100_000


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(inspect.getsourcefile(c))
    for folder, _, names in os.walk(os.path.join(root, "millrace")):
        if "llm" not in folder.split(os.sep):
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name), encoding="utf-8") as f:
                        assert "millrace.llm" not in f.read(), name
