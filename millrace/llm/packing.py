"""Packing: documents into windows of tokens, filled with neighbours that a sharded BM25 index retrieves.

1. Texts are tokenised once into a table of ids. Document frequencies of all tokens and the mean length are counted over
   the whole corpus; a row per token of the vocabulary, which bounds what is sent to the executors.
2. Documents are dealt by content: by their strongest token (the highest log frequency times idf under those counts), so that a
   document's neighbours are where it is. Tokens that lead few documents share a shard; one that leads more than a shard
   holds is split by the documents' second strongest token, and what is still too large, such as a group of copies, by
   number. So shards hold about ``SHARD_TOKENS`` each, whatever the corpus' size or skew, and what meets in one does not
   thin out as the corpus grows.
3. Each shard is one Arrow group: its tokens are indexed (postings with BM25 weights), and windows are filled greedily. A
   window starts with a seed document: the one that the window before cut, or else the first unused one in the order of
   ids. The index gives its unused neighbours by score, and these are placed until the window is full; the last is cut
   there, and its rest seeds the next window. If no neighbour is left, the next unused document is a further seed. What is
   left at a shard's end, less than a window, is cut into sequences whose lengths are powers of two, so that no sequence
   needs padding.

Tokens of a text are those of its runs between ASCII white space, in order: the tokenizer's normaliser and its splitting
never look across white space, so that a bounded table of runs saves most calls.

Defined cases: a null or empty text is one token, the end mark; each row is packed, repeated rows too; an empty table gives
no rows; a text longer than a shard makes its shard larger; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import _text as text
from millrace.llm._work import arrow_schema, bounded_batches, keeps, serve, stored, task

LENGTH = 4096
END = 2
SHARD_TOKENS = 2 << 20
#: Strongest terms of a seed that are looked up in one query of the index; None: all of them.
TERMS = 64
#: Neighbours that are put in order at once; the others are when these are used up.
AT_ONCE = 64
K1, B = 1.2, 0.75
#: A worker process keeps the ids of at most half as many runs as this table has places.
TABLE_BITS = 21
#: ASCII punctuation; an apostrophe may begin a piece of its own and is left out.
TAILS = ".,!?;:%&$#*+-/<=>@\\^_`|~\"()[]{}"


class Table:
    """Token ids of runs of bytes by a 64-bit hash: open addressing over arrays, so that a lookup is a few gathers."""

    def __init__(self, bits: int = TABLE_BITS):
        self.bits = bits
        self.clear()

    def clear(self, entries: int = 0) -> None:
        """Forget all; leave room for so many entries at least."""
        self.bits = max(self.bits, (2 * entries).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.entry = np.zeros(1 << self.bits, dtype=np.int32)
        self.begin, self.size = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype="<u4")

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, 0 if there is none."""
        out = np.zeros(len(h), dtype=np.int32)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        left = None
        while True:
            held = self.keys[at]
            same = held == h
            if left is None:
                out = np.where(same, self.entry[at], 0).astype(np.int32)
                left = np.flatnonzero(~same & (held != 0))
                h, at = h[left], at[left]
            else:
                out[left[same]] = self.entry[at[same]]
                more = ~same & (held != 0)
                left, h, at = left[more], h[more], at[more]
            if not len(left):
                return out
            at = (at + 1) & ((1 << self.bits) - 1)

    def add(self, h: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Entries of hashes that are new and differ; ``ids`` has those of each, one after the other."""
        first = len(self.begin)
        ends = np.cumsum(sizes)
        self.begin = np.concatenate([self.begin, len(self.flat) + ends - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, ids])
        entry = np.arange(first, first + len(h), dtype=np.int32)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]
            won = free & (self.keys[at] == h)
            self.entry[at[won]] = entry[won]
            h, at, entry = h[~won], (at[~won] + 1) & ((1 << self.bits) - 1), entry[~won]

    def __len__(self) -> int:
        return len(self.begin) - 1

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids one after the other) of entries."""
        sizes = self.size[entries]
        ends = np.cumsum(sizes)
        return sizes, self.flat[np.repeat(self.begin[entries] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit integers.

    Texts are cut at ASCII white space. Runs whose characters are all Latin-1 have A-Z lower-cased first, which the
    tokenizer does anyway. Runs of Latin-1 letters, once lower-cased, are one piece for its splitting and pass its
    normaliser unchanged; they go to its model directly, many in one call, and are told apart by the tokens that end a
    word. All others, and whatever doesn't come apart, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        mark = model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.letters = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=mark, cache_capacity=0))
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(max(model["vocab"].values()) + 1, dtype=bool)
        self.ends[[i for token, i in model["vocab"].items() if token.endswith(mark)]] = True
        self.known = Table()
        self.tails: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spell(self, runs: list[str]) -> list[bytes]:
        """Ids of runs of lower-cased Latin-1 letters."""
        joined = self.letters.encode_batch_fast([" ".join(runs[i : i + 100]) for i in range(0, len(runs), 100)], add_special_tokens=False)
        ids = np.array([x for e in joined for x in e.ids], dtype="<u4")
        stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(stops) != len(runs):
            return self._encode(runs)
        data, stops = ids.tobytes(), stops.tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops)]

    def learn(self, runs: list[str], plain: list[bool]) -> list[bytes]:
        """Ids of runs; ``plain`` ones are of Latin-1. Punctuation after letters is a piece of its own."""
        out: list = [b""] * len(runs)
        letters, at, whole, rest = [], [], [], []
        for i, (run, latin) in enumerate(zip(runs, plain)):
            if latin:
                run = run.lower()
                head = run.rstrip(TAILS)
                if head.isalpha() and (head == run or (tail := run[len(head) :]) in self.tails or len(self.tails) < 10_000):
                    if head != run:
                        if tail not in self.tails:
                            self.tails[tail] = self._encode([tail])[0]
                        out[i] = self.tails[tail]
                    letters.append(head)
                    at.append(i)
                    continue
            whole.append(run)
            rest.append(i)
        for i, b in zip(at, self._spell(letters)):
            out[i] = b + out[i]
        for i, b in zip(rest, self._encode(whole)):
            out[i] = b
        return out

    def batch(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text's runs and the end mark, one text after the other; offsets of the texts)."""
        parts, counts = [], []
        for _, _, data, offsets in text.chunks(column):
            low = text.LOWER[data]
            starts, ends, first = text.words(data, offsets, text.NONSPACE)
            beyond = np.flatnonzero(data >= 0xC4)
            odd = np.unique(np.searchsorted(starts, beyond, side="right") - 1)
            for i in odd.tolist():
                low[starts[i] : ends[i]] = data[starts[i] : ends[i]]
            h = text.hashes(low, starts, ends)
            h[h == 0] = 1
            entries = self.known.find(h)
            if len(new := np.flatnonzero(entries == 0)):
                unknown, one = np.unique(h[new], return_index=True)
                one = new[one]
                if len(self.known) + len(unknown) > 1 << (self.known.bits - 1):
                    unknown, one = np.unique(h, return_index=True)
                    self.known.clear(len(unknown))
                strange = set(odd.tolist())
                runs = [low[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[one].tolist(), ends[one].tolist())]
                made = self.learn(runs, [i not in strange for i in one.tolist()])
                self.known.add(unknown, np.array([len(b) // 4 for b in made]), np.frombuffer(b"".join(made), dtype="<u4"))
                entries = self.known.find(h)
            sizes, ids = self.known.ids(entries)
            where = np.concatenate([[0], np.cumsum(sizes)])[first]
            parts.append(np.insert(ids, where[1:], END))
            counts.append(np.diff(where) + 1)
        ids = np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
        return ids, np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, dtype=np.int64)


_encoders: dict[str, Encoder] = {}


keeps("tokens", _encoders.clear)


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def counted(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, terms, how often), by term and then document, of the distinct terms of each document."""
    n = max(1, len(offsets) - 1)
    keys = ids.astype(np.uint64) * np.uint64(n) + np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    if len(keys) and int(ids.max()) < ((1 << 32) - 1) // n:
        keys = keys.astype(np.uint32)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    keys, tf = keys[first].astype(np.int64), np.diff(np.append(first, len(keys)))
    return keys % n, keys // n, tf


class Corpus:
    """What BM25 takes from all documents: how many hold a token, and their mean length."""

    def __init__(self, n: int, tokens: int, df: np.ndarray):
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.mean = max(1.0, tokens / max(n, 1))

    @classmethod
    def of(cls, ids: np.ndarray, offsets: np.ndarray) -> Corpus:
        _, terms, _ = counted(ids, offsets)
        return cls(len(offsets) - 1, len(ids), np.bincount(terms, minlength=1))

    def strongest(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two terms of each document of the highest logarithm of the frequency times idf, the smaller first in a tie; one
        twice if it is the only one. What a document repeats says more of its neighbours than its rarest word."""
        documents, terms, tf = counted(ids, offsets)
        order = np.lexsort((terms, -self.idf[terms] * np.log1p(tf), documents))
        documents, terms = documents[order], terms[order]
        at = np.searchsorted(documents, np.arange(len(offsets) - 1))
        last = np.searchsorted(documents, np.arange(len(offsets) - 1), side="right") - 1
        return terms[at], terms[np.minimum(at + 1, last)]


class Index:
    """BM25 postings of the documents of one shard; terms are token ids."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, corpus: Corpus):
        self.size, self.idf = len(offsets) - 1, corpus.idf
        self.documents, terms, tf = counted(ids, offsets)
        self.begin = np.searchsorted(terms, np.arange(len(corpus.idf) + 1))
        norm = (K1 * (1 - B + B * np.diff(offsets) / corpus.mean)).astype(np.float32)
        tf = tf.astype(np.float32)
        self.weights = corpus.idf[terms] * tf * np.float32(K1 + 1) / (tf + norm[self.documents])

    def scores(self, ids: np.ndarray, terms: int | None = TERMS) -> np.ndarray:
        """Of all documents against the ``terms`` strongest of the tokens of a seed."""
        asked, tf = np.unique(ids, return_counts=True)
        if terms is not None and len(asked) > terms:
            asked = asked[np.argpartition(-self.idf[asked] * (tf / (tf + K1)), terms)[:terms]]
        first = self.begin[asked]
        sizes = self.begin[asked + 1] - first
        ends = np.cumsum(sizes)
        at = np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.documents[at], self.weights[at], minlength=self.size)

    def neighbours(self, ids: np.ndarray, unused: np.ndarray, terms: int | None = TERMS) -> Iterator[int]:
        """Unused documents by falling score against the tokens of a seed, ties in order; only positive scores."""
        scores = self.scores(ids, terms)
        left = np.flatnonzero(unused & (scores > 0))
        while len(left):
            own = scores[left]
            ready = np.ones(len(left), dtype=bool) if len(left) <= AT_ONCE else own >= np.partition(own, len(own) - AT_ONCE)[len(own) - AT_ONCE]
            top = left[ready]
            yield from top[np.lexsort((top, -scores[top]))].tolist()
            left = left[~ready]


def fill(ids: np.ndarray, offsets: np.ndarray, length: int = LENGTH, corpus: Corpus | None = None, terms: int | None = TERMS) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold each token once; all but the last few are full."""
    n = len(offsets) - 1
    sizes = np.diff(offsets).tolist()
    unused = np.ones(n, dtype=bool)
    index = Index(ids, offsets, corpus or Corpus.of(ids, offsets))
    sequences: list[list[tuple[int, int, int]]] = []
    window: list[tuple[int, int, int]] = []
    room, following = length, 0
    rest: tuple[int, int] | None = None

    def place(d: int, start: int) -> None:
        nonlocal window, room, rest
        unused[d] = False
        take = min(room, sizes[d] - start)
        window.append((d, start, take))
        room -= take
        rest = (d, start + take) if start + take < sizes[d] else None
        if not room:
            sequences.append(window)
            window, room = [], length

    while True:
        if rest:
            seed = rest[0]
            place(*rest)
        else:
            while following < n and not unused[following]:
                following += 1
            if following == n:
                break
            seed = following
            place(seed, 0)
        if room < length and not rest:
            for d in index.neighbours(ids[offsets[seed] : offsets[seed + 1]], unused, terms):
                place(d, 0)
                if room == length or rest:
                    break
    return sequences + powers(window)


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Pieces cut into sequences whose lengths are powers of two, the longest first."""
    left, out, queue = sum(p[2] for p in pieces), [], list(reversed(pieces))
    while left:
        want = 1 << (left.bit_length() - 1)
        left -= want
        out.append([])
        while want:
            d, start, size = queue.pop()
            take = min(size, want)
            out[-1].append((d, start, take))
            want -= take
            if take < size:
                queue.append((d, start + take, size - take))
    return out


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _binary(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Ids of each text as little-endian bytes."""
    data = np.ascontiguousarray(ids, dtype="<u4")
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets * 4, dtype=np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _unpacked(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(ids one text after the other, offsets) of what ``_binary`` made."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = (pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, "<u4"), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]].view("<u4"), (offsets - offsets[0]) // 4


def _tokens(slim: DataFrame, path: str | None) -> DataFrame:
    """doc_id and ids, with the end mark, of each row."""
    schema = T.StructType([slim.schema["doc_id"], *T.StructType.fromDDL("ids binary")])
    arrow = arrow_schema(schema)

    def run(batches):
        encode = encoder(path or tokenizer_path())
        for batch in batches:
            for a, b, _, _ in text.chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), _binary(*encode.batch(part.column(1)))], schema=arrow)

    return slim.mapInArrow(task("tokens", run), schema)


def _corpus(tokens: DataFrame) -> Corpus:
    """Counts over all documents: at most a row per token of the vocabulary comes to the driver."""

    def run(batches):
        df, documents, length = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            ids, offsets = _unpacked(batch.column(0))
            _, terms, _ = counted(ids, offsets)
            found = np.bincount(terms, minlength=len(df))
            found[: len(df)] += df
            df, documents, length = found, documents + len(offsets) - 1, length + len(ids)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, [-2, -1])), pa.array(np.append(df[held], [documents, length]))], names=["term", "n"])

    rows = tokens.select("ids").mapInArrow(task("packing", run), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(rows["term"].to_pylist(), rows["n"].to_pylist()))
    df = np.zeros(max([0, *found]) + 1, np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    return Corpus(found.get(-2, 0), found.get(-1, 0), df)


#: Numbers of shards that share tokens begin here; vocabularies must be smaller.
_SHARED = 1 << 17
#: Bits of a sequence's number inside its shard, and of the number of a part of one token.
_SEQUENCE_BITS, _PART_BITS = 20, 24


def _dealt(tokens: DataFrame, corpus: Corpus, shard_tokens: int) -> tuple[DataFrame, int]:
    """(doc_id, ids, shard) and about how many shards there are."""
    if len(corpus.idf) > _SHARED:
        raise ValueError(f"token ids must be below {_SHARED}")
    sent = tokens.sparkSession.sparkContext.broadcast(corpus)
    schema = T.StructType([tokens.schema["doc_id"], *T.StructType.fromDDL("ids binary, number bigint, t1 bigint, t2 bigint")])
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                t1, t2 = sent.value.strongest(*_unpacked(batch.column(1)))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, pa.array(t1), pa.array(t2)], arrow)], schema=arrow)

    # Rows of one token pair are dealt by number. Tokens are a stored table, so that a row keeps its number.
    led = tokens.withColumn("number", F.monotonically_increasing_id()).mapInArrow(task("packing", run), schema)
    size = F.octet_length("ids") / 4 + 16
    pairs = stored(led.groupBy("t1", "t2").agg(F.sum(size).alias("size")), "pairs")
    # A row per token at most: large ones get parts of their own, the others share shards in their order.
    by_first = pairs.groupBy("t1").agg(F.sum("size").alias("size")).withColumn("parts", F.ceil(F.col("size") / shard_tokens).cast("bigint"))
    small = F.sum(F.when(F.col("parts") == 1, F.col("size")).otherwise(0)).over(Window.orderBy("t1").rowsBetween(Window.unboundedPreceding, -1))
    place = F.when(F.col("parts") > 1, F.col("t1")).otherwise(_SHARED + F.floor(F.coalesce(small, F.lit(0)) / shard_tokens))
    firsts = stored(by_first.select("t1", "parts", place.cast("bigint").alias("place")), "firsts")
    part = F.pmod(F.xxhash64("t2"), F.col("parts"))
    heavy = pairs.join(F.broadcast(firsts.filter("parts > 1")), "t1").groupBy("t1", part.alias("part"), "parts").agg(F.ceil(F.sum("size") / shard_tokens).cast("bigint").alias("pieces"))
    # Further pieces of a part are numbered after the parts of its token.
    more = F.coalesce(F.sum(F.col("pieces") - 1).over(Window.partitionBy("t1").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heavy = stored(heavy.filter("pieces > 1").select("t1", "part", "pieces", (F.col("parts") + more).alias("after")), "heavy")
    count = firsts.agg(F.sum(F.when(F.col("parts") > 1, F.col("parts")).otherwise(0)), F.count_distinct("place")).first()
    extra = heavy.agg(F.sum("pieces")).first()[0] or 0
    placed = led.join(F.broadcast(firsts), "t1").withColumn("part", part).join(heavy, ["t1", "part"], "left")
    piece = F.coalesce(F.pmod(F.xxhash64("number"), F.col("pieces")), F.lit(0))
    number = F.when(piece > 0, F.col("after") + piece - 1).otherwise(F.col("part"))
    number = F.when(number >= 1 << _PART_BITS, F.raise_error(F.lit(f"parts of one token have no numbers of {_PART_BITS} bits")).cast("bigint")).otherwise(number)
    shard = F.shiftleft("place", _PART_BITS) + number
    return placed.select("doc_id", "ids", shard.alias("shard")), int((count[0] or 0) + (count[1] or 0) + extra)


def pack(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    length: int = LENGTH,
    shard_tokens: int = SHARD_TOKENS,
    terms: int | None = TERMS,
    keep_ids: bool = False,
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if ``keep_ids``.

    ``path`` is the tokenizer's file as executors see it; by default each takes its own installed copy. ``terms`` bounds the
    terms of a seed that are looked up; None looks up all.
    """
    bounded_batches(documents.sparkSession)
    slim = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tokens = stored(_tokens(slim, path), "tokens")
    corpus = _corpus(tokens)
    dealt, shards = _dealt(tokens, corpus, shard_tokens)
    sent = documents.sparkSession.sparkContext.broadcast(corpus)
    more = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * keep_ids
    schema = T.StructType([slim.schema["doc_id"], *T.StructType.fromDDL(more)])
    arrow = arrow_schema(schema)

    def run(key, table):  # annotations would be strings here, which applyInArrow does not read
        serve("packing")
        table = table.select(["doc_id", "ids"]).sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        ids, offsets = _unpacked(table["ids"])
        data = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
        begin, sizes = offsets.tolist(), np.diff(offsets).tolist()
        sequences = fill(ids, offsets, length, sent.value, terms)
        if len(sequences) >= 1 << _SEQUENCE_BITS:
            raise OverflowError(f"{len(sequences)} sequences of one shard have no numbers of {_SEQUENCE_BITS} bits")
        flat = []
        for number, pieces in enumerate(sequences):
            at = 0
            for d, start, take in pieces:
                flat.append((d, start, take, number, at))
                at += take
        base = key[0].as_py() << _SEQUENCE_BITS
        columns = list(zip(*flat))
        raw = [data[4 * (begin[d] + start) : 4 * (begin[d] + start + take)] for d, start, take, _, _ in flat]
        long = lambda x: pa.array(x, pa.int64())
        out = [
            table["doc_id"].combine_chunks().take(long(columns[0])).cast(arrow.field(0).type),
            long(columns[1]),
            long(columns[2]),
            long([zlib.crc32(b) for b in raw]),
            long([sizes[d] for d in columns[0]]),
            long([base + s for s in columns[3]]),
            long(columns[4]),
            *([pa.array([b.tobytes() for b in raw], pa.binary())] if keep_ids else []),
        ]
        return pa.Table.from_arrays(out, schema=arrow)

    # As many partitions as shards, so that a task's share doesn't grow with the corpus.
    return dealt.repartition(max(1, min(shards, 1 << 16)), "shard").groupBy("shard").applyInArrow(run, schema)
