import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import minhash as m
from millrace.llm.components import components
from tests.llm.data import clashing, corpus, edited, frame, prose


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("shingle,percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, shingle, percent):
    rows = corpus(shingle)
    out = m.near_duplicates(frame(spark, rows), shingle=shingle, percent=percent)
    assert found(out) == m.brute_force(rows, shingle, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_a_large_group_of_near_copies_keeps_every_link(spark, monkeypatch):
    """Copies of one text at all distances: links that only the second step finds, in one block and in many."""
    rng = random.Random(5)
    base = prose(rng, 120)
    rows = [(i, edited(rng, base, rng.randrange(0, 14))) for i in range(220)]
    wanted = m.brute_force(rows, 3, 85)
    assert found(m.near_duplicates(frame(spark, rows), shingle=3, percent=85)) == wanted
    monkeypatch.setattr(m, "BLOCK", 16)
    assert found(m.near_duplicates(frame(spark, rows), shingle=3, percent=85)) == wanted


def test_nulls_repeats_and_nothing(spark):
    text = "a b c d e f g h"
    rows = [(1, text), (1, text), (None, text), (2, text.upper()), (3, None), (4, "")]
    out = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in m.near_duplicates(clashing(frame(spark, rows)), shingle=3, percent=85).collect()), key=str)
    assert out == sorted([(1, 6, 1, True), (1, 6, 1, True), (None, 6, None, True), (2, 6, 1, False), (3, 0, 3, True), (4, 0, 4, True)], key=str)
    assert m.near_duplicates(frame(spark, [])).count() == 0
    kept = m.deduplicate(clashing(frame(spark, rows)), shingle=3, percent=85)
    assert kept.columns == clashing(frame(spark, rows)).columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, None]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    minima = m.Minima(24)
    for share in (0.5, 0.85, 0.95):
        n = 2000
        common = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
        sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n - len(common), dtype=np.uint64)])) for _ in range(2)]
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        packed = m.pack(minima.of(sets))
        assert abs(m.agreement(packed[0], packed[1:], minima.k)[0] - true) < 0.16
        assert m.agreement(packed[0], packed[:1], minima.k)[0] == 1
    assert m.bands_for(0.85) == 24


def test_linked_is_exact():
    a = np.arange(100, dtype=np.uint64)
    assert m.linked(a, a[:85], 85) and not m.linked(a, a[:84], 85) and not m.linked(a[:0], a[:0], 85)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (7, 7)]
    top = {x: x for pair in links for x in pair}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        top[high] = low
    got = {r.node: r.component for r in components(frame(spark, links, "a bigint, b bigint")).collect()}
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}
    assert components(frame(spark, [], "a bigint, b bigint")).count() == 0
    assert components(frame(spark, [(None, 1)], "a bigint, b bigint")).agg(F.count("*")).first()[0] == 0


def _over_sets_of_ids(rows, n, percent):
    """Component of each id where an id may have several texts: two ids are linked if any of their sets are."""
    distinct = sorted({(i, t) for i, t in rows if i is not None})
    numbered = m.brute_force(list(enumerate(t for _, t in distinct)), n, percent)
    top = {i: i for i, _ in distinct}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, (i, _) in enumerate(distinct):
        j = distinct[numbered[a][1]][0]
        low, high = sorted((find(i), find(j)))
        top[high] = low
    return {i: find(i) for i, _ in distinct}


def test_texts_of_one_id_are_one_node_in_any_order_of_rows(spark):
    """Two texts of equal set size under one id: links of both hold."""
    rng = random.Random(9)
    a, b = prose(rng, 60), prose(rng, 60, 500)
    rows = [(1, a), (2, edited(rng, b, 1)), (5, a + " more"), (5, b + " more"), (7, edited(rng, a, 1)), (8, prose(rng, 60, 900))]
    rows += [(20 + i, edited(rng, rng.choice([a, b]), rng.randrange(3))) for i in range(6)] + [(21, b)]
    wanted = _over_sets_of_ids(rows, 3, 85)
    assert wanted[5] == wanted[1] == wanted[2] == 1
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r[1])):
        out = m.near_duplicates(frame(spark, order).coalesce(1), shingle=3, percent=85)
        assert {r.doc_id: r.component_id for r in out.collect()} == wanted
