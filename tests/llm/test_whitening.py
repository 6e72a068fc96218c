"""Whitening against a plain eigendecomposition in exact sums, with spectra that fall fast and slowly."""

import math
from fractions import Fraction

import numpy as np
import pytest

from millrace.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>"


def vectors(seed, n, spectrum):
    rng = np.random.default_rng(seed)
    d = len(spectrum)
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    return (rng.standard_normal((n, d)) * np.array(spectrum)) @ turn + rng.standard_normal(d)


def plain(rows):
    """(x vectors of rows that take part, distinct ones, values, vectors) by numpy, from the exact covariance."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in kept)
    grid = [(i, tuple([math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (d - len(v)))) for i, v in kept]
    fit = np.array(sorted({x for _, x in grid}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = n * fit - sums
    exact = centred.T @ centred
    covariance = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in exact])
    values, turn = np.linalg.eigh(covariance)
    return grid, n, sums, values[::-1], turn[:, ::-1]


def check(spark, rows, sketched=None):
    df = spark.createDataFrame(rows, SCHEMA)
    model = whitening.fit_whitening(df)
    if sketched is not None:
        assert model.expanded is not sketched
    out = whitening.whiten(df, model).collect()
    grid, n, sums, values, turn = plain(rows)
    count = min(16, len(sums))
    assert len(out) == count * len(grid)
    found = {}
    for r in out:
        assert r.n == n and r.identity_error <= 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        found.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, set()).add(r.whitened)
    signs = np.sign((turn[:, :count] * model.components.T).sum(axis=0))
    for i, x in grid:
        centred = [n * a - s for a, s in zip(x, sums)]
        own = found[i, sum(int(c) ** 2 for c in centred)]
        wanted = (np.array([c / n for c in centred]) @ turn[:, :count]) / np.sqrt(values[:count]) * signs
        for k, w in enumerate(wanted, 1):
            assert any(v == pytest.approx(w, abs=1e-6) for v in own[k])
    return model


def rows_of(made):
    return [(i, [float(c) for c in v]) for i, v in enumerate(made)]


def test_values_that_fall_fast_are_sketched(spark):
    check(spark, rows_of(vectors(1, 400, [30 * 0.55**i for i in range(24)] + [0.02] * 24)), sketched=False)
    check(spark, rows_of(vectors(1, 400, [200 * 0.8**i for i in range(18)] + [0.0] * 40)), sketched=True)


def test_values_that_fall_slowly_take_the_full_dimension(spark):
    model = check(spark, rows_of(vectors(2, 300, [1 + 0.02 * i for i in range(48)])), sketched=False)
    assert model.components.shape == (16, 48)


def test_blocks_of_columns(spark, monkeypatch):
    rows = rows_of(vectors(3, 200, [1 + 0.05 * i for i in range(40)]))
    whole = check(spark, rows)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 40 * 7)
    parts = check(spark, rows)
    assert np.allclose(np.abs(whole.components @ parts.components.T), np.eye(16), atol=1e-9)


def test_odd_vectors(spark):
    rows = rows_of(vectors(4, 60, [1.0, 2.0, 3.0, 4.0]))
    odd = [(None, [1.0, 2.0, 3.0, 4.0]), (7, None), (7, [1.0, None, 2.0, 3.0]), (7, [float("nan"), 1.0, 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0, 1.0]), (8, [-float("inf")] * 4), (9, [0.5, 0.25]), (9, [])]
    copies = [(100 + i, rows[0][1]) for i in range(50)] + [rows[1]] * 3 + [(5, [9.0, 9.0, 9.0, 9.0])]
    check(spark, rows + odd + copies)


def test_no_components(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])]):
        assert whitening.report(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_components_without_variance_are_left_out(spark):
    out = whitening.report(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(20)], SCHEMA)).collect()
    assert {r.component for r in out} == {1} and out[0].explained == pytest.approx(1.0) and out[0].identity_error < 1e-9


def test_other_columns_and_doubles(spark):
    rows = rows_of(vectors(5, 50, [1.0, 2.0, 3.0]))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS x", "2 AS n", "3 AS slot", "4 AS component")
    assert whitening.report(df).count() == 150


def test_numbers_that_overflow_are_an_error(spark):
    with pytest.raises(Exception, match="64 bits|overflow"):
        whitening.report(spark.createDataFrame([(i, [1e17 * i, 1.0]) for i in range(9)], "vec_id bigint, embedding array<double>")).collect()
