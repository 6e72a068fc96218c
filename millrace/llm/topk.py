"""Exact top-k search: exhaustive term-at-a-time accumulation over blocks of candidates.

A vector's component is a posting: its term is the place in the vector, its weight floor(``SCALE`` * x). Each task turns
its rows into blocks of ``BLOCK`` candidates and inverts each block into postings by term. For a query row, each
non-zero weight is multiplied into the postings of its term and scattered into a dense array of the block's scores; a
partition selection keeps the block's best k. The k of all blocks then meet by query, are merged by partial selections
that tasks make of what they have read, and the best k of these remain. Nothing is skipped, so that scores are exact.

Queries are a stated share of the rows and grow with them. They are counted first and sent in blocks of about
``BLOCK_BYTES`` of weights, one after the other, as many scans as there are blocks. The answers of each block are written
before the next one is read, so that neither the driver nor the executors nor the plan hold more than one.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, as query or as candidate; the
empty vector scores 0 against any; vectors of other lengths score over their common places; a row with a null id takes
no part; of rows with one id each is a candidate of the others' queries, and none of a query with that id ("every row but
the query's own"); ties go to the smaller id; scores beyond a long are held at its bounds; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._work import bounded_batches, task
from millrace.session import shared_dir

SCALE = 256
K = 5
EVERY = 50
#: Candidates in a block, at most, and bytes of weights in a block of candidates or of queries.
BLOCK = 8192
BLOCK_BYTES = 8 << 20
_TOP = (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, weights as doubles) of the rows that take part."""
    weights = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), weights.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(~F.coalesce(bad, F.lit(True)))


def matrix(column: pa.Array, scale: float) -> np.ndarray:
    """Weights of the vectors, short ones filled with zeros; integers, or Python integers where these could overflow."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale)
    width = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


class Postings:
    """Candidates of one block, inverted."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids, kind="stable")  # a stable order by id makes ties fall to the smaller one
        self.ids, weights = ids[order], weights[order]
        self.high = float(np.abs(weights).max(initial=0))
        self.terms = []
        for t in range(weights.shape[1]):
            column = weights[:, t]
            held = np.flatnonzero(column)
            self.terms.append((held if len(held) < len(column) else slice(None), column[held]))

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[list[int], list[int]]:
        """Ids and scores of the k best, in any order; the query's own id is none of them."""
        high = float(np.abs(query).max(initial=0)) * self.high * max(1, len(query))
        # Sums of products of whole numbers below 2^53 are exact as doubles.
        kind = float if high < 2**53 else object
        scores = np.zeros(len(self.ids), dtype=kind)
        for t in np.flatnonzero(query[: len(self.terms)]).tolist():
            places, weights = self.terms[t]
            if kind is object:
                scores[places] += int(query[t]) * np.array([int(w) for w in weights], dtype=object)
            else:
                scores[places] += query[t] * weights
        a, b = np.searchsorted(self.ids, own, side="left"), np.searchsorted(self.ids, own, side="right")
        at = np.concatenate([np.arange(a), np.arange(b, len(self.ids))])
        scores = scores[at]
        if len(scores) > k:
            if kind is object:
                floor = sorted(scores, reverse=True)[k - 1]
            else:
                floor = np.partition(scores, len(scores) - k)[len(scores) - k]
            above, level = np.flatnonzero(scores > floor), np.flatnonzero(scores == floor)
            chosen = np.concatenate([above, level[: k - len(above)]])
        else:
            chosen = np.arange(len(scores))
        return self.ids[at[chosen]].tolist(), [max(-_TOP - 1, min(_TOP, int(s))) for s in scores[chosen]]


def search(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    every: int = EVERY,
    scale: float = SCALE,
    block: int = BLOCK,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` its k best of all other rows."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = usable(vectors, id_col, vector_col)
    asked = rows.filter(F.col("id") % every == 0)
    count, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    in_bytes = max(1, block_bytes // (8 * max(1, width or 1)))
    block, blocks = min(block, in_bytes), max(1, -(-count // in_bytes))
    schema = "query_id bigint, vec_id bigint, score bigint"
    # A partial selection over what each task has found comes before the exchange, for a few rows of each query.
    near = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def best(number: int) -> tuple[DataFrame, Broadcast]:
        part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number) if blocks > 1 else asked
        table = part.toArrow()
        sent = spark.sparkContext.broadcast((table["id"].to_numpy(), matrix(table["v"], scale)))
        found = rows.mapInArrow(_scanner(sent, k, scale, block), schema).withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)
        return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), sent

    if blocks == 1:
        return best(0)[0]
    # The driver holds one block at a time: its answers are written, then it is let go.
    path = f"{shared_dir(spark)}/nearest-{uuid.uuid4().hex}"
    for number in range(blocks):
        found, sent = best(number)
        found.write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(found.schema).parquet(path)


def _scanner(sent, k: int, scale: float, block: int):
    def run(batches):
        query_ids, queries = sent.value
        ids: list[np.ndarray] = []
        held: list[np.ndarray] = []
        best: list[tuple[list[int], list[int]]] = [([], []) for _ in range(len(query_ids))]

        def scan() -> None:
            width = max(m.shape[1] for m in held)
            whole = np.zeros((sum(len(m) for m in held), width))
            at = 0
            for m in held:
                whole[at : at + len(m), : m.shape[1]] = m
                at += len(m)
            postings = Postings(np.concatenate(ids), whole)
            for q, own in enumerate(query_ids.tolist()):
                new_ids, new_scores = postings.best(queries[q], own, k)
                old = best[q]
                pairs = sorted(zip([-s for s in old[1] + new_scores], old[0] + new_ids))[:k]
                best[q] = ([i for _, i in pairs], [-s for s, _ in pairs])
            ids.clear()
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                ids.append(part.column(0).to_numpy())
                held.append(matrix(part.column(1), scale))
                if sum(len(m) for m in held) >= block:
                    scan()
        if held:
            scan()
        for at in range(0, len(query_ids), 4096):
            rows = [(q, i, s) for q, b in zip(query_ids[at : at + 4096].tolist(), best[at : at + 4096]) for i, s in zip(*b)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["query_id", "vec_id", "score"])

    return task("topk", run)


def brute_force(rows: list[tuple[int, list | None]], k: int = K, every: int = EVERY, scale: float = SCALE) -> list[tuple]:
    """The contract by plain loops over whole numbers, for tests."""
    import math

    held = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in held:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in held if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return out
