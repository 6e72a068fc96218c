import random

from millrace.llm import topk
from tests.llm.data import clashing, frame

KIND = "vec_id bigint, embedding array<double>"


def rows_of(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1), 0.5]) for _ in range(12)]) for i in range(-60, 260)]
    rows += [(300, None), (350, [None] * 12), (400, [float("nan")] * 12), (450, [float("inf")] + [0.0] * 11), (500, []), (550, [1.0] * 3), (None, [1.0] * 12)]
    rows += [(600 + i, rows[5][1]) for i in range(20)]
    df = clashing(frame(spark, rows, KIND))
    wanted = sorted(topk.brute_force(rows))
    assert rows_of(topk.search(df)) == wanted
    assert rows_of(topk.search(df, block=7, block_bytes=12 * 8 * 3)) == wanted


def test_few_rows_and_large_values(spark):
    assert rows_of(topk.search(frame(spark, [], KIND))) == []
    assert rows_of(topk.search(frame(spark, [(0, [1.0])], KIND))) == []
    rows = [(0, [2.0, -1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-0.001, 3.0])]
    assert rows_of(topk.search(frame(spark, rows, KIND))) == sorted(topk.brute_force(rows))
    huge = [(0, [1e12]), (1, [3e10]), (2, [-1e12])]
    assert rows_of(topk.search(frame(spark, huge, KIND))) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]
