import random

from millrace.llm import _work
from millrace.llm import decontaminate as d
from tests.llm.data import clashing, corpus, frame, prose


def made(seed=4):
    rng = random.Random(seed)
    items = [(i, prose(rng, n)) for i, n in enumerate([3, 1, 12, 13, 14, 40, 60])] + [(7, None), (8, "..."), (9, "Tiny")]
    items += [(10, items[5][1]), (5, items[5][1])]
    rows = corpus(seed, 20)
    for k, (_, text) in enumerate(items):
        words = (text or "").split()
        rows.append((1000 + k, prose(rng, 30) + " " + " ".join(words[2:30]).upper() + ", " + prose(rng, 50)))
        rows.append((2000 + k, text))
    rows.append((3000, "tiny, " * 3 + prose(rng, 200)))
    return rows, items


def test_equals_brute_force_in_one_block_and_many(spark):
    rows, items = made()
    wanted = d.brute_force(rows, items)
    assert any(w[3] for w in wanted.values()) and any(w[1] and not w[3] for w in wanted.values())
    benchmark = frame(spark, items, "item_id bigint, text string")
    for size in (d.BLOCK_BYTES, 200):
        out = d.report(clashing(frame(spark, rows)), benchmark, block_bytes=size)
        assert {r.doc_id: (r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in out.collect()} == wanted


def test_removal_takes_documents_or_spans(spark):
    rng = random.Random(1)
    passage = prose(rng, 13, 1000)
    rows = [(1, prose(rng, 400) + "! " + passage + "? " + prose(rng, 400)), (2, passage), (3, "clean text"), (4, None)]
    df = clashing(frame(spark, rows))
    out = {r.doc_id: r.text for r in d.remove(df, frame(spark, [(1, passage)], "item_id bigint, text string")).collect()}
    assert out == {1: rows[0][1].replace(passage, ""), 3: "clean text", 4: None}
    assert d.remove(df, frame(spark, [(1, passage)], "item_id bigint, text string")).columns == df.columns


def test_nothing(spark):
    none = frame(spark, [], "item_id bigint, text string")
    out = d.report(frame(spark, [(1, "a b"), (1, "a b"), (None, "c")]), none).collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in out] == [(1, 2, 0, 0, False)] * 2 + [(None, 1, 0, 0, False)]
    assert d.report(frame(spark, []), frame(spark, [(1, "a")], "item_id bigint, text string")).count() == 0
    anonymous = d.report(frame(spark, [(1, "a b")]), frame(spark, [(None, "a b")], "item_id bigint, text string")).first()
    assert anonymous.n_hit == 2 and anonymous.n_items == 0 and anonymous.contaminated


def test_blocks_leave_one_table(spark, tmp_path, monkeypatch):
    """However many blocks a benchmark has, the tables of earlier ones are gone."""
    monkeypatch.setattr(_work, "shared_dir", lambda spark: str(tmp_path))
    rows, items = made()
    out = d.report(frame(spark, rows), frame(spark, items, "item_id bigint, text string"), block_bytes=100)
    assert out.count() == len(rows)
    assert len([f for f in tmp_path.iterdir() if f.name.startswith("scanned")]) == 1
