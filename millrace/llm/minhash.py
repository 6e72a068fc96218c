"""MinHash near-dedup: b-bit signatures, bands for candidates, exact sets for links, components for groups.

Each text becomes the set of hashes of its shingles. From the minima of ``rows`` * ``bands`` hash functions, each band of
``rows`` minima is hashed for the buckets in which candidates meet, and the low ``BITS`` bits of all minima are packed into
a signature. Texts with equal sets are one class from then on. Candidates are made and confirmed in two steps that never
emit all pairs of a bucket.

1. Star: each bucket's members are paired with its smallest one. Pairs are made distinct over all buckets, dropped if
   their sets' sizes exclude the threshold or if the signatures' agreement, corrected for chance collisions and read
   with a margin of ``SIGMAS`` deviations, does; the rest is confirmed on full sets. Components follow.
2. Rest: buckets that still hold several components are gathered with their members' sets, in blocks of bounded bytes
   (pairs of blocks for large ones). Inside a task a pair is looked at only if its members' components differ, in the
   first bucket that they share; signatures exclude most, sets decide, and what is linked is merged at once. Only links
   that join components are emitted.

Bands are chosen so that a pair at the threshold is missed with a chance of about ``MISS``.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a text of fewer
words than a shingle is one shingle; equal ids are one node, and of rows with equal ids and texts ``deduplicate`` keeps one;
a row with a null id is linked with nothing and kept; an empty table gives no rows; other columns are kept by
``deduplicate``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _text as text
from millrace.llm._work import among, aside, bounded_batches, discard, serve, stored, task
from millrace.llm.components import components

BITS = 4
ROWS = 5
MISS = 1e-6
SIGMAS = 5.0
#: A task of the second step holds two blocks of so many members, or bytes of sets, at most.
BLOCK, BLOCK_BYTES = 2048, 16 << 20


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """The fewest bands, in steps of eight, that miss a pair at ``threshold`` with a chance below ``miss``."""
    return 8 * math.ceil(math.log(miss) / math.log1p(-(threshold**rows)) / 8)


def shingles(column: pa.Array, n: int, table: np.ndarray = text.NONSPACE):
    """(row, sorted distinct hashes of its shingles of ``n`` words) for each row, chunk by chunk."""
    for a, b, data, offsets in text.chunks(column):
        low = text.LOWER[data]
        starts, ends, first = text.words(low, offsets, table)
        h = text.hashes(low, starts, ends)
        g = text.grams(h, n)
        bounds = first.tolist()
        for d in range(b - a):
            i, j = bounds[d], bounds[d + 1]
            if j - i >= n:
                yield a + d, np.unique(g[i : j - n + 1])
            elif j > i:
                yield a + d, text.grams(h[i:j], j - i)
            else:
                yield a + d, g[:0]


class Minima:
    """Signatures of sets under fixed hash functions."""

    def __init__(self, bands: int, rows: int = ROWS, seed: int = 20_240_601):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.k = bands, rows, bands * rows
        self.factors = rng.integers(0, 1 << 31, self.k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.masks = rng.integers(0, 1 << 32, self.k, dtype=np.uint32)

    def of(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of 32-bit minima for each set; none is empty."""
        flat = np.concatenate(sets)
        starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
        x = (flat >> np.uint64(32)).astype(np.uint32)
        out = np.empty((len(sets), self.k), dtype=np.uint32)
        for j in range(self.k):
            out[:, j] = np.minimum.reduceat((x ^ self.masks[j]) * self.factors[j], starts)
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """64-bit keys of the bands; a key stands for its band and the minima in it."""
        out = np.zeros((len(minima), self.bands), dtype=np.uint64)
        for r in range(self.rows):
            out = out * np.uint64(0x9E3779B97F4A7C15) + text.mix(minima[:, r :: self.rows].astype(np.uint64) + np.uint64(r + 1))
        return text.mix(out + text.mix(np.arange(1, self.bands + 1, dtype=np.uint64))[None, :])


def pack(minima: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, packed into 64-bit words."""
    per = 64 // BITS
    low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64)
    low = np.pad(low, ((0, 0), (0, -low.shape[1] % per)))
    words = low.reshape(len(low), low.shape[1] // per, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(words, axis=2)


def agreement(one: np.ndarray, many: np.ndarray, k: int) -> np.ndarray:
    """Estimated similarity of packed signatures: bit counts of places that agree, less what chance makes agree."""
    x = one ^ many
    for shift in range(1, BITS):
        x = x | ((one ^ many) >> np.uint64(shift))
    ones = np.uint64(sum(1 << (BITS * i) for i in range(64 // BITS)))
    differ = np.bitwise_count(x & ones).sum(axis=-1, dtype=np.int64)
    chance = 2.0**-BITS
    return ((k - differ) / k - chance) / (1 - chance)


def least_agreement(threshold: float, k: int) -> float:
    """What estimates of pairs at the threshold or above stay over, but for a chance of SIGMAS deviations."""
    chance = 2.0**-BITS
    p = threshold + (1 - threshold) * chance
    return threshold - SIGMAS * math.sqrt(p * (1 - p) / k) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct hashes."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


_SIGNED = "id bigint, n bigint, fp1 bigint, fp2 bigint, bands array<bigint>, signature binary"
_SETS = "id bigint, n bigint, bands array<bigint>, signature binary, hashes binary"


def _signed(documents: DataFrame, minima: Minima, n: int, table: np.ndarray, with_sets: bool) -> DataFrame:
    """Signatures of (id, text) rows; with their sets, only those that are not empty."""

    def made(batch, rows, sets):
        full = [i for i, s in enumerate(sets) if len(s)]
        m = minima.of([sets[i] for i in full]) if full else np.zeros((0, minima.k), np.uint32)
        keys, packed = minima.band_keys(m).view(np.int64), pack(m)
        ids = batch.column(0).take(pa.array(rows)).cast(pa.int64())
        if with_sets:
            hashes = pa.array([sets[i].tobytes() for i in full], pa.binary())
            return pa.RecordBatch.from_arrays(
                [ids.take(pa.array(full, pa.int64())), pa.array([len(sets[i]) for i in full], pa.int64()), pa.array(list(keys), pa.list_(pa.int64())), pa.array([p.tobytes() for p in packed], pa.binary()), hashes],
                names=["id", "n", "bands", "signature", "hashes"],
            )
        place = {i: r for r, i in enumerate(full)}
        with np.errstate(over="ignore"):
            fp = [(int(text.mix(s).sum(dtype=np.uint64).view(np.int64)), int(text.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))) for s in sets]
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([f[0] for f in fp], pa.int64()),
                pa.array([f[1] for f in fp], pa.int64()),
                pa.array([keys[place[i]] if i in place else [] for i in range(len(sets))], pa.list_(pa.int64())),
                pa.array([packed[place[i]].tobytes() if i in place else b"" for i in range(len(sets))], pa.binary()),
            ],
            names=["id", "n", "fp1", "fp2", "bands", "signature"],
        )

    def run(batches):
        for batch in batches:
            rows, sets, held = [], [], 0
            for row, s in shingles(batch.column(1), n, table):
                rows.append(row)
                sets.append(s)
                held += len(s)
                if held > 200_000:
                    yield made(batch, rows, sets)
                    rows, sets, held = [], [], 0
            if rows:
                yield made(batch, rows, sets)

    return documents.mapInArrow(task("minhash", run), _SETS if with_sets else _SIGNED)


def _confirmed(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) of the pairs whose sets are linked; rows have both signatures and sets."""
    least = least_agreement(percent / 100, k)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            s, t, x, y = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            one = np.frombuffer(b"".join(s), dtype=np.uint64).reshape(len(s), -1)
            two = np.frombuffer(b"".join(t), dtype=np.uint64).reshape(len(t), -1)
            maybe = np.flatnonzero(agreement(one, two, k) >= least)
            yes = [i for i in maybe.tolist() if linked(np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64), percent)]
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(yes, pa.int64())) for i in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "s", "t", "x", "y").mapInArrow(task("minhash", run), "a bigint, b bigint")


def _joins(k: int, percent: int):
    """A function over the members of one bucket, or of two of its blocks, that returns links between components."""
    least = least_agreement(percent / 100, k)

    def run(key, table):
        serve("minhash")
        band, p, q = (x.as_py() for x in key)
        table = table.sort_by([("id", "ascending")])
        n = table["n"].to_numpy()
        block = table["block"].to_numpy()
        signatures = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=np.uint64).reshape(len(n), -1)
        bands = np.array(table["bands"].to_pylist(), dtype=np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        names = table["component"].to_pylist()
        labels = {c: i for i, c in enumerate(dict.fromkeys(names))}
        group = np.array([labels[c] for c in names])
        own = list(labels)
        here = int(np.flatnonzero(bands[0] == band)[0])
        out = []
        for i in range(len(n) - 1):
            rest = slice(i + 1, None)
            ok = (group[rest] != group[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))
            if p != q:
                ok &= block[rest] != block[i]
            js = np.flatnonzero(ok) + i + 1
            if len(js):
                js = js[~(bands[js, :here] == bands[i, :here]).any(axis=1)]
            if len(js):
                js = js[agreement(signatures[i], signatures[js], k) >= least]
            for j in js.tolist():
                if group[i] != group[j] and linked(sets[i], sets[j], percent):
                    out.append((own[group[i]], own[group[j]]))
                    group[group == group[j]] = group[i]
        return pa.Table.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return run


def near_duplicates(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    rows: int = ROWS,
    table: np.ndarray = text.NONSPACE,
) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the smallest id reachable over links), kept."""
    bounded_batches(documents.sparkSession)
    minima = Minima(bands_for(percent / 100, rows), rows)
    slim = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = stored(_signed(slim, minima, shingle, table, False), "signed")

    # Classes of equal sets, by the set's size and a 128-bit fingerprint.
    some = signed.filter("n > 0 and id is not null")
    # A table, a row per class, so that the join of a large class can be split.
    leads = stored(some.groupBy("fp1", "fp2", "n").agg(F.min("id").alias("rep")), "leads")
    members = stored(some.select("id", "fp1", "fp2", "n").join(leads, ["fp1", "fp2", "n"]).select("id", "rep").distinct(), "members")
    reps = some.join(leads, ["fp1", "fp2", "n"]).filter("id = rep").select("id", "n", F.explode("bands").alias("band"))

    # Buckets with more than one class.
    each = reps.distinct()
    sizes = each.groupBy("band").agg(F.min("id").alias("lead"), F.count("*").alias("members")).filter("members > 1")
    buckets = stored(each.join(sizes, "band").select("band", "id", "n", "lead", "members"), "buckets")
    # A table, so that its size is known before the texts move.
    stored_needed = stored(buckets.select("id").distinct(), "needed")
    some_texts = among(slim, "id", stored_needed).filter("_maybe").drop("_maybe")
    sets = stored(_signed(some_texts.join(stored_needed, "id", "left_semi"), minima, shingle, table, True).dropDuplicates(["id", "n", "hashes"]), "sets")

    # Step 1: stars.
    size = sets.groupBy("id").agg(F.min("n").alias("lead_n"))
    stars = buckets.filter("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b"), "n").distinct()
    stars = stars.join(size.withColumnRenamed("id", "a"), "a").filter(100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n")).select("a", "b")
    left = sets.select(F.col("id").alias("a"), F.col("signature").alias("s"), F.col("hashes").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("signature").alias("t"), F.col("hashes").alias("y"))
    first = components(_confirmed(stars.join(left, "a").join(right, "b"), minima.k, percent).unionAll(members.select(F.col("id").alias("a"), F.col("rep").alias("b"))))

    # Step 2: buckets that still hold several components.
    placed = buckets.filter("members > 2").select("band", "id").join(first.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    weights = placed.join(sets.select("id", F.octet_length("hashes").alias("bytes")), "id")
    open_ = weights.groupBy("band").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("m"), F.sum("bytes").alias("bytes")).filter("c1 != c2 and m > 2")
    # A table, a row per bucket, so that the join of a large one can be split.
    open_ = stored(open_.select("band", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")), "open")
    dealt = placed.join(open_, "band").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "component")
    joins = dealt.join(sets, "id").groupBy("band", "p", "q").applyInArrow(_joins(minima.k, percent), "a bigint, b bigint")
    second = components(joins)

    final = first.join(second.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select(F.col("node").alias("id"), F.coalesce("top", "component").alias("component"))
    late = second.select(F.col("node").alias("id"), "component").join(first.select(F.col("node").alias("id")), "id", "left_anti")
    result = signed.select("id", "n").join(final.unionAll(late), "id", "left")
    component = F.coalesce("component", "id")
    result = result.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
    result = stored(result, "classes")
    discard(signed, leads, members, buckets, stored_needed, sets, first, open_, second)
    return result


def deduplicate(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``documents`` less those that are linked with one of a smaller id, directly or over others; of rows with equal ids and
    texts one stays."""
    found = near_duplicates(documents, id_col, text_col, **options)
    dropped = stored(found.filter("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    repeated = stored(found.filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_twice")).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "repeated")
    discard(found)
    placed, (id_at, text_at), _ = aside(documents, id_col, text_col)
    marked = among(placed, id_at, dropped)
    left = marked.filter("_maybe").drop("_maybe").join(dropped, F.col(id_at) == F.col("_gone"), "left_anti")
    left = marked.filter("not _maybe").drop("_maybe").unionAll(left)
    if not repeated.isEmpty():
        again = F.col(id_at) == F.col("_twice")
        left = left.join(repeated, again, "left_anti").unionAll(left.join(repeated, again, "left_semi").dropDuplicates([id_at, text_at]))
    return left.toDF(*documents.columns)


def brute_force(rows: list[tuple[int, str | None]], n: int, percent: int) -> dict[int, tuple[int, int]]:
    """(set size, component) of each id by comparing all pairs of plain sets, for tests."""
    sets = {}
    for i, value in rows:
        own = (value or "").encode().lower().split()
        sets[i] = {tuple(own[j : j + n]) for j in range(len(own) - n + 1)} if len(own) >= n else ({tuple(own)} if own else set())
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and find(i) != find(j):
                low, high = sorted((find(i), find(j)))
                top[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}
