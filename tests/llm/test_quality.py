import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import quality as q
from tests.llm.data import clashing, frame, prose


def made(n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, rng.randrange(20, 120)) if good else rng.choice([lambda: " ".join(prose(rng, 40).split()[k] + "###" for k in range(40)), lambda: prose(rng, 60).upper() + "!!", lambda: "spam spam " * 60])()
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_rows_are_told_apart(spark):
    rows, labels = made()
    df, known = clashing(frame(spark, rows)), frame(spark, labels, "doc_id bigint, quality int, toxic int")
    model = q.train(df, known)
    assert 0 < len(model.weighted) < 80
    out = q.score(df, model).collect()
    truth = {i: y for i, y, _ in labels}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_the_compiled_column_is_the_model(spark):
    rows, labels = made(200)
    rows += [(1000, None), (1001, ""), (1002, "x" * 100_000)]
    df = frame(spark, rows)
    model = q.train(df, frame(spark, labels, "doc_id bigint, quality int, toxic int"))
    plain = model.predict(q.statistics(pa.array([t for _, t in rows], pa.string())))
    assert np.allclose([r.score for r in q.score(df, model).sort("doc_id").collect()], plain)


def test_held_out_labels_teach_nothing(spark):
    rows, labels = made(200)
    df = frame(spark, rows)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y, t) for i, y, t in labels]
    kind = "doc_id bigint, quality int, toxic int"
    assert q.train(df, frame(spark, labels, kind)) == q.train(df.repartition(7), frame(spark, turned, kind))


def test_without_labels(spark):
    df = frame(spark, [(1, "a"), (None, "b"), (1, "a"), (2, None)])
    none = frame(spark, [], "doc_id bigint, quality int, toxic int")
    model = q.train(df, none)
    assert [(r.score, r.predicted, r.held_out) for r in q.score(df, model).filter("doc_id is null").collect()] == [(0.5, 0, False)]
    assert q.keep(df, model).count() == 4
    one = q.train(df, frame(spark, [(1, 1, 0), (2, None, 0), (9, 0, 0)], "doc_id bigint, quality int, toxic int"))
    assert not one.weighted and q.score(frame(spark, []), one).count() == 0


def test_statistics():
    x = q.statistics(pa.array(["Aa b!\nAa 1", None, "aa aa aa"]))
    row = dict(zip(q.FEATURES, x[0]))
    assert row["size"] == 10 and row["n_words"] == 4 and row["upper"] == 0.2 and row["symbols"] == 0.1 and row["lines"] == 0.1 and row["distinct"] == 0.75 and row["digits"] == 0.1
    assert not x[1].any() and dict(zip(q.FEATURES, x[2]))["repeated"] == 2 / 3


def test_keep(spark):
    rows, labels = made(300)
    df = clashing(frame(spark, rows))
    kept = q.keep(df, q.train(df, frame(spark, labels, "doc_id bigint, quality int, toxic int")))
    assert kept.columns == df.columns
    good = {i for i, y, _ in labels if y}
    left = {r.doc_id for r in kept.select(F.col("doc_id")).collect()}
    assert len(left ^ good) <= 6
