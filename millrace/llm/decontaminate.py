"""Benchmark decontamination: broadcast windows of normalised test words, scan, verify, remove spans or documents.

Both sides lower-case A-Z and take runs of ASCII digits, letters and non-ASCII characters as words. A window is
``window`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window of its own
length. Documents are scanned in one pass, in batches of arrays: the hash of each run of words is looked up in the
windows' hashes, and each match is confirmed on the words themselves. A word inside any occurrence is hit.

The benchmark is sent to the executors in blocks of at most ``BLOCK_BYTES`` of text. Its size is measured first; a
benchmark of several blocks is as many scans in a row, each of which adds to the hits that the one before it wrote, so that
the driver, the executors and the plan never hold more than one block.

Defined cases: a null or empty text has no words, no hits and is not contaminated; a null benchmark text has no
windows; a null item id marks words but is not named; repeated rows of either table each stand for themselves, an item
id counts once; an empty benchmark hits nothing; other columns, whatever their names, are kept by ``remove``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import _text as text
from millrace.llm._work import arrow_schema, aside, bounded_batches, discard, keeps, stored, task, widen

WINDOW = 13
#: A document is contaminated if one word in so many is hit.
ONE_IN = 20
#: Bytes of benchmark text that are broadcast at once; windows and their tables take about fifty times as much.
BLOCK_BYTES = 4 << 20
_BITS = 22

SCANNED = "_hit_words bigint, _hit_spans array<bigint>, _hit_items array<string>"


class Windows:
    """Windows of one block of the benchmark, by length."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        found: dict[int, dict[bytes, set]] = defaultdict(lambda: defaultdict(set))
        for item, value in items:
            low = text.LOWER[np.frombuffer(value.encode("utf-8", "replace"), dtype=np.uint8)]
            starts, ends, _ = text.words(low, np.array([0, len(low)]), text.ALNUM)
            own = [low[a:b].tobytes() for a, b in zip(starts, ends)]
            n = min(window, len(own))
            for i in range(len(own) - n + 1 if n else 0):
                found[n][b" ".join(own[i : i + n])].add(item)
        self.by_length = {}
        for n, windows in sorted(found.items()):
            keys = list(windows)
            joined = np.frombuffer(b" ".join(keys), dtype=np.uint8)
            starts, ends, _ = text.words(joined, np.array([0, len(joined)]), text.ALNUM)
            h = text.grams(text.hashes(joined, starts, ends), n)[::n]
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << _BITS, dtype=bool)
            seen[h >> np.uint64(64 - _BITS)] = True
            self.by_length[n] = h[order], [keys[k] for k in order], [windows[keys[k]] for k in order], seen

    def scan(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        """(document, first word, word after the last, item ids) of each occurrence; words count from the chunk's start."""
        if not len(starts):
            return
        h = text.hashes(low, starts, ends)
        for n, (sorted_h, keys, items, seen) in self.by_length.items():
            g = text.grams(h, n)
            if not len(g):
                continue
            maybe = np.flatnonzero(seen[g >> np.uint64(64 - _BITS)])
            if not len(maybe):
                continue
            left = np.searchsorted(sorted_h, g[maybe], side="left")
            right = np.searchsorted(sorted_h, g[maybe], side="right")
            kept = right > left
            at, left, right = maybe[kept], left[kept], right[kept]
            document = np.searchsorted(first, at, side="right") - 1
            whole = at + n <= first[document + 1]
            for i, d, a, b in zip(at[whole].tolist(), document[whole].tolist(), left[whole].tolist(), right[whole].tolist()):
                words = b" ".join([low[s:e].tobytes() for s, e in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist())])
                for k in range(a, b):
                    if keys[k] == words:
                        yield d, i, i + n, items[k]


def _union(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted, disjoint spans, flat."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def benchmark_blocks(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int = BLOCK_BYTES):
    """Lists of (item id as text, text) of at most about ``block_bytes`` each, one at a time on the driver."""
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).filter("t is not null and t != ''")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        block = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else items
        yield [(r.i, r.t) for r in block.collect()]


def scan(
    documents: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    removing: bool = False,
) -> DataFrame:
    """``documents`` with ``_hit_words`` (words in all), ``_hit_spans`` (flat pairs: first word, word after the last;
    disjoint and sorted) and ``_hit_items`` (ids with an occurring window, as text). With ``removing`` contaminated ones
    are left out and hit spans cut, in the pass that scans the last block."""
    spark = documents.sparkSession
    bounded_batches(spark)
    schema = widen(documents.schema, SCANNED)
    out, read, again, ahead = documents, documents, False, None
    blocks = benchmark_blocks(benchmark, item_id, item_text, block_bytes)
    block = next(blocks, [])
    while block is not None:
        ahead = next(blocks, None)
        sent = spark.sparkContext.broadcast((block, window))
        out = out.mapInArrow(_scanner(sent, text_col, again, removing and ahead is None, schema), schema)
        if ahead is not None:
            # One block at a time: its hits are written with the documents, then it and the table before are let go.
            last, out = read, stored(out, "scanned")
            discard(last)
            read = out
            sent.destroy()
        block, again = ahead, True
    return out


#: The windows that this worker process made last, by block.
_made: dict[str, Windows] = {}


keeps("decontaminate", _made.clear)


def _windows(block: str, sent) -> Windows:
    """The windows of a block, made once in a worker process for as long as it works on that block."""
    if block not in _made:
        _made.clear()
        _made[block] = Windows(*sent.value)
    return _made[block]


def _scanner(sent, text_col: str, again: bool, removing: bool, schema):
    arrow = arrow_schema(schema)
    block = uuid.uuid4().hex

    def run(batches):
        windows = _windows(block, sent)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index(text_col))
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            spans: dict[int, list] = defaultdict(list)
            items: dict[int, set] = defaultdict(set)
            if again:
                old = [batch.column(batch.schema.get_field_index(c)) for c in ("_hit_spans", "_hit_items")]
                for d, (s, named) in enumerate(zip(old[0].to_pylist(), old[1].to_pylist())):
                    if s:
                        spans[d], items[d] = list(zip(s[::2], s[1::2])), set(named)
            for a, b, data, offsets in text.chunks(column):
                low = text.LOWER[data]
                starts, ends, first = text.words(low, offsets, text.ALNUM)
                counts[a:b] = np.diff(first)
                base = first.tolist()
                for d, i, j, named in windows.scan(low, starts, ends, first):
                    spans[a + d].append((i - base[d], j - base[d]))
                    items[a + d].update(x for x in named if x is not None)
            rows = range(batch.num_rows)
            made = {
                "_hit_words": pa.array(counts),
                "_hit_spans": pa.array([_union(spans[d]) if d in spans else [] for d in rows], pa.list_(pa.int64())),
                "_hit_items": pa.array([sorted(items[d]) if d in items else [] for d in rows], pa.list_(pa.string())),
            }
            scanned = pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in arrow], schema=arrow)
            yield _removed(scanned, text_col) if removing else scanned

    return task("decontaminate", run)


def n_hit() -> Column:
    return F.expr("aggregate(_hit_spans, struct(0L as total, 1L as sign), (a, x) -> struct(a.total - a.sign * x as total, -a.sign as sign)).total")


def contaminated(hit: Column, words: Column, one_in: int = ONE_IN) -> Column:
    return (hit > 0) & (hit * one_in >= words)


def report(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row per document: its id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    slim = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = scan(slim, benchmark, "text", **options).select("doc_id", "_hit_words", "_hit_items", n_hit().alias("n_hit"))
    return found.select(
        "doc_id",
        F.col("_hit_words").alias("n_words"),
        "n_hit",
        F.size("_hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_hit_items"), ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("_hit_words")).alias("contaminated"),
    )


def remove(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``documents`` without contaminated ones, and without the hit spans of the others."""
    placed, (text_at,), columns = aside(documents, text_col)
    return scan(placed, benchmark, text_at, removing=True, **options).select(*columns).toDF(*documents.columns)


def _removed(batch: pa.RecordBatch, text_col: str) -> pa.RecordBatch:
    """The rows of a scanned batch that aren't contaminated, with their hit spans cut out."""
    at = batch.schema.get_field_index(text_col)
    spans = batch.column(batch.schema.get_field_index("_hit_spans")).to_pylist()
    words = batch.column(batch.schema.get_field_index("_hit_words")).to_pylist()
    if not any(spans):
        return batch
    values, kept = batch.column(at).to_pylist(), []
    for d, s in enumerate(spans):
        hit = sum(s[1::2]) - sum(s[::2])
        if not hit or hit * ONE_IN < words[d]:
            kept.append(d)
            if s:
                values[d] = cut(values[d], s)
    columns = list(batch.columns)
    columns[at] = pa.array(values, columns[at].type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema).take(pa.array(kept, pa.int64()))


def cut(value: str, spans: list[int]) -> str:
    """``value`` without the characters from the first to the last word of each span."""
    data = np.frombuffer(value.encode("utf-8", "replace"), dtype=np.uint8)
    starts, ends, _ = text.words(text.LOWER[data], np.array([0, len(data)]), text.ALNUM)
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(data[at : starts[a]].tobytes())
        at = ends[b - 1]
    return b"".join([*out, data[at:].tobytes()]).decode("utf-8", "replace")


def brute_force(documents: list[tuple[int, str | None]], benchmark: list[tuple[object, str | None]], window: int = WINDOW) -> dict:
    """The contract on small lists by plain loops, for tests: doc id to (n_words, n_hit, items sha256, contaminated)."""
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for doc, value in documents:
        own, hit, named = words(value), set(), set()
        for item, other in benchmark:
            theirs = words(other)
            n = min(window, len(theirs))
            for k in range(len(theirs) - n + 1 if n else 0):
                for i in range(len(own) - n + 1):
                    if own[i : i + n] == theirs[k : k + n]:
                        hit.update(range(i, i + n))
                        named.add(str(item))
        out[doc] = (len(own), len(hit), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own))
    return out
