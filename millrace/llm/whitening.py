"""Whitening of embeddings by a randomised range finder over all rows.

Entries are put on a grid, x = floor(64 c) + 1000000, so that counts, sums and squared deviations are whole numbers and exact. The
fit list is each different x vector once: a stored table that each pass reads. A pass multiplies the centred rows into a block
of directions and back, Z'(ZQ) / n, inside the tasks, a batch at a time; what a task hands on is one such block, and blocks are
summed up by a few tasks before they reach the driver. Rows are centred before they are multiplied: n x - S is exact, and
divided by n once.

Directions begin at random, some more than are wanted (``OVERSAMPLE``), and are made orthonormal after each pass. The
Rayleigh-Ritz values and vectors of a pass come with their residuals, from the same block. They are taken if each residual is
below ``TOLERANCE`` of the distance to the next value, which bounds the error of the vector; if that does not happen in
``PASSES`` passes, as where the values fall slowly, directions are expanded to the full dimension: blocks of columns of the
covariance, of ``BLOCK_BYTES`` each, whose own vectors are the components.

Defined cases: vectors that are null, or hold null or entries that are not finite, are left out; vectors shorter than the
longest are filled up with zeros; repeated rows and clashing ids are rows of their own in the result, and one vector in the fit
list; a null id is an id; no vectors, or only one different one, have no components and so no rows; components without
variance are left out; entries so large that a whole number overflows are an error; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._work import bounded_batches, discard, stored, task

#: The grid of entries.
SCALE, SHIFT = 64, 1_000_000
#: Components, further directions of the sketch, and passes before it is expanded.
COMPONENTS, OVERSAMPLE, PASSES, SEED = 16, 16, 4, 20
#: Residual of a component, as a share of the distance to the next value.
TOLERANCE = 1e-11
#: Bytes of a block that a task sums up, and tasks that sum up those of others.
BLOCK_BYTES, FAN = 4 << 20, 8
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """Components (rows) of the fit list by falling variance. Means are (base + rest / n), in whole numbers."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float
    #: Whether the sketch had to be expanded to the full dimension.
    expanded: bool

    @property
    def dimension(self) -> int:
        return len(self.base)


def _grid(embeddings: DataFrame, vector_col: str, *more: str) -> DataFrame:
    """``more`` and x, the grid vectors of the rows that take part."""
    v = F.col(vector_col)
    whole = v.isNotNull() & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    return embeddings.filter(whole).select(*more, F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT).alias("x"))


def _filled(grid: DataFrame, dimension: int) -> DataFrame:
    missing = F.array_repeat(F.lit(SHIFT).cast("bigint"), F.lit(dimension) - F.size("x"))
    return grid.withColumn("x", F.when(F.size("x") < dimension, F.concat("x", missing)).otherwise(F.col("x")))


def _rows(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _summed(fit: DataFrame, dimension: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``make`` of all batches of rows: in each task, then in a few, then on the driver."""
    kind, shape = (made := make(np.zeros((1, dimension), np.int64))).dtype, made.shape

    def total(blocks):
        out = np.zeros(shape, kind)
        for block in blocks:
            out += block
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["block"])

    def first(batches):
        yield from total(make(_rows(b.column(0), dimension)) for b in batches if b.num_rows)

    def then(batches):
        yield from total(np.frombuffer(x.as_py(), kind).reshape(shape) for b in batches for x in b.column(0))

    parts = fit.select("x").mapInArrow(task("whitening", first), "block binary").withColumn("slot", F.spark_partition_id() % FAN)
    out = np.zeros(shape, kind)
    for row in parts.repartition(FAN, "slot").select("block").mapInArrow(task("whitening", then), "block binary").collect():
        out += np.frombuffer(row.block, kind).reshape(shape)
    return out


def _centred(n: int, base: np.ndarray, rest: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: (n * (x - base) - rest) / n


def _moments(fit: DataFrame, n: int, base: np.ndarray, rest: np.ndarray, q: np.ndarray | slice) -> np.ndarray:
    """The covariance times ``q`` or, for a slice, its columns."""
    centred = _centred(n, base, rest)

    def make(x: np.ndarray) -> np.ndarray:
        z = centred(x)
        return z.T @ (z[:, q] if isinstance(q, slice) else z @ q)

    return _summed(fit, len(base), make) / n


def _ordered(values: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _sketched(fit: DataFrame, n: int, base: np.ndarray, rest: np.ndarray, count: int, size: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(values, vectors) from ``size`` directions, or None if residuals stay too large."""
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((len(base), size)))[0]
    last = np.inf
    for left in reversed(range(PASSES)):
        y = _moments(fit, n, base, rest, q)
        small = q.T @ y
        values, turn = _ordered(*np.linalg.eigh((small + small.T) / 2))
        vectors = q @ turn
        residuals = np.linalg.norm(y @ turn - vectors * values, axis=0)[:count]
        apart = np.abs(values[:count, None] - values[None, :])
        apart[np.arange(count), np.arange(count)] = np.inf
        real = values[:count] > _floor(values, len(base))
        worst = float((residuals / apart.min(axis=1))[real].max(initial=0.0))
        if worst <= TOLERANCE:
            return values[:count], vectors[:, :count]
        # A pass lowers residuals by about the same share as the one before.
        if worst * min(1.0, worst / last) ** left > TOLERANCE and np.isfinite(last):
            return None
        q, last = np.linalg.qr(y)[0], worst
    return None


def _floor(values: np.ndarray, dimension: int) -> float:
    """What is not above this is no variance but rounding."""
    return max(values[0], 0.0) * dimension * 2.0**-50


def fit_whitening(embeddings: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, oversample: int = OVERSAMPLE) -> Whitening | None:
    """Components of the different vectors; None if there are none."""
    bounded_batches(embeddings.sparkSession)
    grid = _grid(embeddings, vector_col)
    dimension = grid.agg(F.max(F.size("x"))).first()[0]
    if not dimension:
        return None
    fit = stored(_filled(grid, dimension).distinct(), "fit")
    try:
        n, largest = fit.agg(F.count("*"), F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()
        if n * (largest + 1) > _LONG // 4:
            raise OverflowError(f"sums of {n} vectors with entries of {largest} are no whole numbers of 64 bits")
        sums = _summed(fit, dimension, lambda x: x.sum(axis=0))
        base, rest = sums // n, sums % n
        count = min(components, dimension)
        found = _sketched(fit, n, base, rest, count, count + oversample) if count + oversample < dimension else None
        expanded = found is None
        if expanded:
            step = max(1, BLOCK_BYTES // (8 * dimension))
            whole = np.concatenate([_moments(fit, n, base, rest, slice(i, i + step)) for i in range(0, dimension, step)], axis=1)
            values, vectors = _ordered(*np.linalg.eigh((whole + whole.T) / 2))
        else:
            values, vectors = found
        count = min(count, int((values > _floor(values, dimension)).sum()))
        values, vectors = values[:count], vectors[:, :count]
        centred = _centred(n, base, rest)
        p = vectors / np.sqrt(values)

        def make(x: np.ndarray) -> np.ndarray:
            z = centred(x)
            w = z @ p
            return np.concatenate([np.square(z).sum(keepdims=True).ravel(), w.sum(axis=0), (w.T @ w).ravel()])

        both = _summed(fit, dimension, make) / n
        trace, mean, moments = float(both[0]), both[1 : count + 1], both[count + 1 :].reshape(count, count)
        error = float(np.abs(moments - np.outer(mean, mean) - np.eye(count)).max(initial=0.0))
        return Whitening(n, base, rest, vectors.T.copy(), values, trace, error, expanded)
    finally:
        discard(fit)


def _deviations(y: np.ndarray) -> np.ndarray:
    """Sums of squares of whole numbers, exact; an error if one is no whole number of 64 bits."""
    if not len(y) or float(np.abs(y).max()) ** 2 * y.shape[1] < float(1 << 62):
        return np.square(y).sum(axis=1)
    sums = [sum(int(v) * int(v) for v in row) for row in y]
    if max(sums) > _LONG:
        raise OverflowError("a deviation is no whole number of 64 bits")
    return np.array(sums, np.int64)


_OUT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per vector that takes part and component: vec_id, component, n, deviation (sum of squares of n x - S), whitened,
    explained (share of the variance) and identity_error (how far the covariance of the whitened fit list is from one)."""
    bounded_batches(embeddings.sparkSession)
    grid = _grid(embeddings, vector_col, F.col(id_col).alias("vec_id"))
    schema = f"vec_id {grid.schema['vec_id'].dataType.simpleString()}, {_OUT}"
    if model is None or not len(model.variances):
        return embeddings.sparkSession.createDataFrame([], schema)
    dimension, count, n, base, rest, error = model.dimension, len(model.variances), model.n, model.base, model.rest, model.identity_error
    p, explained = (model.components / np.sqrt(model.variances)[:, None]).T, model.variances / model.trace

    def run(batches):
        for batch in batches:
            x = _rows(batch.column(1), dimension)
            y = n * (x - base) - rest
            each = np.repeat(np.arange(len(x)), count)
            columns = (
                batch.column(0).take(pa.array(each)),
                np.tile(np.arange(1, count + 1, dtype=np.int32), len(x)),
                np.full(len(each), n, np.int64),
                _deviations(y)[each],
                ((y / n) @ p).reshape(-1),
                np.tile(explained, len(x)),
                np.full(len(each), error),
            )
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["vec_id", *(f.split()[0] for f in _OUT.split(", "))])

    return _filled(grid, dimension).mapInArrow(task("whitening", run), schema)


def report(embeddings: DataFrame) -> DataFrame:
    """All vectors, whitened by the components of the different ones."""
    return whiten(embeddings, fit_whitening(embeddings))
