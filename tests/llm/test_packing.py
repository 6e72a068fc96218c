import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import packing as p
from tests.llm.data import clashing, corpus, frame, prose

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

ODD = ["", None, "  ", "İstanbul ΣΑΣ word's it'ś a.. b., don't I'LL <|endoftext|> x\x1cy z\x85w q　e 12345 ab12.", "naïve. É., é. ﬁ. H̱ É " + "x" * 300 + " " + "y" * 300, "he's. we'll, s' 's 't. ll.", "aͅ. ªb. \x00 a\x00b É É", "ÉCOLE ǅ 😀😀 …"]


def whole(texts):
    t = tokenizers.Tokenizer.from_file(p.tokenizer_path())
    t.encode_special_tokens = True
    return [e.ids + [p.END] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_those_of_whole_texts():
    texts = ODD + [t for _, t in corpus(3, 30)]
    wanted = whole(texts)
    encoder = p.Encoder(p.tokenizer_path())
    for _ in range(2):
        ids, offsets = encoder.batch(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == wanted
    encoder.known = p.Table(4)  # overflows again and again
    ids, offsets = encoder.batch(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == wanted


def test_encoding_holds_little_beside_its_results():
    encoder = p.Encoder(p.tokenizer_path())
    column = pa.array(["some words of a text " * 50] * 6000)
    encoder.batch(column.slice(0, 1))
    tracemalloc.start()
    ids, _ = encoder.batch(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * ids.nbytes


def test_every_id_is_in_one_piece_and_nothing_is_padded(spark):
    rows = corpus(5, 120) + [(900, None), (900, None), (None, "x")]
    out = p.pack(clashing(frame(spark, rows)), shard_tokens=6_000, keep_ids=True).collect()
    wanted = sorted((i, ids) for (i, _), ids in zip(rows, whole([t for _, t in rows])) if i is not None and i != 900)
    pieces, sequences = {}, {}
    for r in out:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.length > 0
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, ids in wanted:
        own = sorted(pieces[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == np.array(ids, "<u4").tobytes() and [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
        assert all(r.doc_tokens == len(ids) for r in own)
    assert sum(r.length for r in pieces[900]) == 2 and sum(r.length for r in pieces[None]) == 2
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        total = sum(r.length for r in s)
        assert [r.offset for r in s] == list(np.cumsum([0] + [r.length for r in s])[:-1]) and total <= 4096 and (total == 4096 or total & (total - 1) == 0)
    assert len({r.sequence_id >> p._SEQUENCE_BITS for r in out}) > 1


def test_neighbours_are_the_most_alike():
    rng = random.Random(1)
    topics = [[rng.randrange(k * 500, k * 500 + 60) for _ in range(4000)] for k in range(6)]
    documents = [topics[i % 6][rng.randrange(3000) :][:150] for i in range(60)]
    ids, offsets = np.array([t for d in documents for t in d], "<u4"), np.arange(0, 60 * 150 + 1, 150)
    unused = np.ones(60, bool)
    unused[[0, 6]] = False
    near = list(p.Index(ids, offsets, p.Corpus.of(ids, offsets)).neighbours(ids[:150], unused))
    assert near[:8] and all(d % 6 == 0 and unused[d] for d in near[:8])
    for window in p.fill(ids, offsets, 600)[:10]:
        assert len({d % 6 for d, _, _ in window}) <= 2
    scores = p.Index(ids, offsets, p.Corpus.of(ids, offsets))
    term, n = int(ids[0]), 60
    held = [documents[d].count(term) for d in range(60)]
    df = sum(x > 0 for x in held)
    wanted = [np.log1p((n - df + 0.5) / (df + 0.5)) * x * (p.K1 + 1) / (x + p.K1) for x in held]
    got = np.zeros(60)
    a, b = scores.begin[term], scores.begin[term + 1]
    got[scores.documents[a:b]] = scores.weights[a:b]
    assert np.allclose(got, wanted, rtol=1e-4)


def test_empty(spark):
    assert p.pack(frame(spark, [])).count() == 0
    assert [(r.length, r.doc_tokens, r.offset) for r in p.pack(frame(spark, [(1, None)])).collect()] == [(1, 1, 0)]
    assert p.powers([(0, 0, 13)]) == [[(0, 0, 8)], [(0, 8, 4)], [(0, 12, 1)]]
    assert len(p.pack(frame(spark, [(1, prose(random.Random(1), 9000))])).collect()) > 5


def test_many_empty_texts_take_linear_time(spark):
    import time

    df = spark.range(60_000).selectExpr("id AS doc_id", "'' AS text")
    began = time.perf_counter()
    out = p.pack(df).groupBy("sequence_id").agg({"length": "sum", "offset": "max"}).collect()
    assert sum(r["sum(length)"] for r in out) == 60_000 and time.perf_counter() - began < 60
