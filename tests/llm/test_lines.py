import random

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import _work
from millrace.llm import lines as m
from tests.llm.data import clashing, frame

ROWS = [
    (1, "The quick brown fox jumps over\nThe quick brown fox jumps ovr\nshort"),
    (2, "The quick brown fox jumps over!\nThe quick brown fox jumps ov er!\n"),
    (3, None),
    (None, "The quick brown fox jumps over"),
    (4, ""),
    (5, "  The quick brown fox jumps over\nThe quick brown fox jumps over\t"),
    (6, "A quite different line of text\nshort"),
]


def found(df):
    return {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_copies, r.n_links) for r in df.collect()}


@given(st.text("ab", max_size=40), st.text("ab", max_size=40), st.integers(0, 9))
def test_banded_distance(s, t, k):
    assert m.distance_within(s, t, k) == (m.distance(s, t) <= k)


@given(st.text("abcd", min_size=5, max_size=70), st.integers(0, 9), st.integers(0, 10**9))
def test_banded_distance_of_near_lines(s, n, seed):
    t = edits(random.Random(seed), s, n)
    for k in (1, 2, 4, 8, 40):
        assert m.distance_within(s, t, k) == (m.distance(s, t) <= k)


def keys(line, threshold, probes):
    parts, probe = m.plan(len(line), threshold)
    return {m.key_of(line[a:b], seed) for (seed, a, b), p in zip(parts, probe) if probes or not p}


@given(st.text("abcé", min_size=16, max_size=90), st.integers(1, 5), st.integers(0, 10**9))
def test_edits_leave_a_segment(line, n, seed):
    threshold = m.Threshold(edits=n)
    other = edits(random.Random(seed), line, n)
    short, long = sorted((line, other), key=len)
    if len(long) >= 16:
        assert keys(short, threshold, False) & keys(long, threshold, True)


def test_thresholds():
    grown = m.Threshold(edits=1, percent=2, most=4)
    assert [grown.of(n) for n in (1, 15, 16, 149, 150, 199, 200, 1000)] == [0, 0, 1, 2, 3, 3, 4, 4]
    for n in range(1, 400):
        assert grown.of_probes(n) == sorted({grown.of(x) for x in range(n, n + 50) if x - grown.of(x) <= n} - {0})


def test_plans_go_when_a_worker_serves_another_operator():
    _work.serve("lines")
    m.plan(300, m.Threshold(edits=3))
    assert m.plan.cache_info().currsize and m.moves.cache_info().currsize
    _work.serve("tokens")
    assert not m.plan.cache_info().currsize and not m.moves.cache_info().currsize


def test_equals_brute_force(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(10, 60))) for _ in range(25)]
    rows = list(ROWS)
    for i in range(10, 60):
        own = []
        for _ in range(4):
            line, at = rng.choice(base), rng.randrange(10)
            own.append(rng.choice([line, line, line[:at] + "z" + line[at + 1 :], line[:at] + line[at + 1 :], line[:at] + "yz" + line[at:]]))
        rows.append((i, "\n".join(own)))
    out = m.near_lines(clashing(frame(spark, rows)))
    assert found(out) == m.brute_force(rows)
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.class_doc_id, r.class_line_no)) for r in out.collect())


def edits(rng, line, n):
    for _ in range(n):
        i = rng.randrange(len(line) or 1)
        line = rng.choice([line[:i] + line[i + 1 :], line[:i] + "z" + line[i:], line[:i] + "z" + line[i + 1 :]])
    return line


def test_thresholds_that_grow_equal_brute_force(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([1, 5, 14, 16, 20, 40, 95, 100, 160, 220]))) for _ in range(16)]
    rows = [(i, "\n".join(edits(rng, rng.choice(base), rng.randrange(7)) for _ in range(2))) for i in range(40)]
    for threshold in (m.Threshold(percent=6, most=5), m.Threshold(edits=1, exact_below=1)):
        assert found(m.near_lines(frame(spark, rows), threshold=threshold)) == m.brute_force(rows, threshold), threshold


def test_groups_are_cut_until_they_are_small(spark):
    """Many lines that share all but one stretch, one edit from few others, and some that are one edit apart."""
    rng = random.Random(5)
    lines = {"the same beginning of lines " + f"{rng.randrange(10**9):09d}" + " and the same end of all" for _ in range(150)}
    lines |= {edits(rng, rng.choice(sorted(lines)), 1) for _ in range(30)} | {f"x{'ab'[k % 2]}" * 9 + c for k, c in enumerate("abcdefgh")}
    rows = [(i, line) for i, line in enumerate(sorted(lines))]
    threshold = m.Threshold(edits=2)
    assert found(m.near_lines(frame(spark, rows), threshold=threshold, group=16)) == m.brute_force(rows, threshold)


def reworded(rng, line, n):
    """``line`` after ``n`` edits of whole words."""
    words = line.split()
    for _ in range(n):
        i = rng.randrange(len(words))
        words[i : i + 1] = rng.choice([[], [words[i], "more"], ["other"], ["other"]])
    return " ".join(words)


def test_a_replaced_word_is_linked(spark):
    """One word of forty, of several characters, is beyond one edit of a character."""
    line = " ".join(f"word{i}" for i in range(40))
    rows = [(1, line), (2, line.replace("word17", "something")), (3, line.replace("word1", "else"))]
    assert found(m.near_lines(frame(spark, rows), threshold=m.Threshold(words=10))) == {(1, 0): (1, 0, 1, 1), (2, 0): (1, 0, 1, 1), (3, 0): (3, 0, 1, 0)}


def test_words_that_may_differ_equal_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(n)) for n in (3, 8, 9, 10, 11, 19, 20, 21, 45, 60, 130) for _ in range(3)]
    rows = [(i, "\n".join(reworded(rng, line, rng.randrange(1 + len(line) // 30)) for line in rng.sample(base, 4))) for i in range(70)]
    rows += [(200, "  ".join(base[20].split())), (201, "\t".join(base[30].split())), (202, None), (None, base[30]), (203, "\u00e9 " * 30), (204, "\u00e9 " * 32)]
    # Lines that repeat one run have as many equal segments.
    rows += [(300 + i, reworded(rng, "one two three four " * 9, i % 5)) for i in range(12)]
    for percent in (10, 5, 25):
        threshold = m.Threshold(words=percent)
        out = found(m.near_lines(clashing(frame(spark, rows)), threshold=threshold, group=8))
        assert out == m.brute_force(rows, threshold), percent
        assert sum(n for *_, n in out.values()) > sum(n for *_, n in m.brute_force(rows).values())


def test_segments_of_words_are_more_than_edits():
    for percent in (1, 2, 5, 10, 15, 20, 33, 49):
        threshold = m.Threshold(words=percent).of_words()
        size = m.run_words(threshold)
        assert size >= 1 and all(n // size > of[-1] for n in range(1, 3000) if (of := threshold.of_probes(n)))
    assert m.run_words(m.Threshold(words=10).of_words()) == 4


def grams_of(documents, threshold, common):
    found = {}
    for r in m._gram_rows(documents, threshold, 2, common).collect():
        found.setdefault((r.h1, r.h2), {}).setdefault(r.key, set()).add(r.probe)
    return found


def test_lines_have_a_small_part_of_their_grams_as_keys(spark):
    """Fewer than a fifth of the words, where each run of words was a key."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"{rng.randrange(10**6):x}" for _ in range(60))) for i in range(200)]
    found = grams_of(frame(spark, rows), m.Threshold(words=10).of_words(), [])
    assert len(found) == 200 and all(7 <= len(keys) for keys in found.values())
    assert sum(map(len, found.values())) < 200 * 60 // 5


def test_reworded_lines_share_a_key_whatever_is_common(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    threshold = m.Threshold(words=10).of_words()
    pairs = [(line, reworded(rng, line, len(line.split()) // 10)) for line in (" ".join(rng.choices(words, k=rng.randrange(10, 90))) for _ in range(150))]
    documents = frame(spark, [(i, "\n".join(pair)) for i, pair in enumerate(pairs)])
    for common in ([], m._common_of(documents, 1.0, 2)):
        found = grams_of(documents, threshold, common)
        for s, t in pairs:
            most = threshold.of(max(len(s.split()), len(t.split())))
            if s != t and m.distance(s.split(), t.split()) <= most:
                x, y = found[m.identity(s)], found[m.identity(t)]
                assert any(False in x[key] | y[key] for key in x.keys() & y.keys()), (s, t)


def test_a_hot_run_of_words_makes_few_candidates(spark):
    """Thousands of long lines that share a passage, and else nothing, but for one replaced word in two of them."""
    rng = random.Random(7)
    word = lambda: f"{rng.randrange(16**6):06x}"
    lines = [" ".join([*(word() for _ in range(20)), "this passage is in all of these lines here", *(word() for _ in range(20))]) for _ in range(5_000)]
    rows = [*enumerate(lines), (9_000, lines[17].replace(lines[17].split()[3], "new"))]
    out = m.near_lines(frame(spark, rows), threshold=m.Threshold(words=10)).filter("n_links > 0").collect()
    assert sorted((r.doc_id, r.class_doc_id, r.n_links) for r in out) == [(17, 17, 1), (9_000, 17, 1)]


def test_a_hot_part_makes_few_candidates(spark):
    rng = random.Random(6)
    lines = [f"{'all of them share this, ' * 3}{rng.randrange(16**12):012x}{' and also this; ' * 2}" for _ in range(20_000)]
    out = m.near_lines(frame(spark, list(enumerate(lines))))
    assert out.filter("n_links > 0 or not kept").count() == 0 and out.count() == 20_000


def test_removal(spark):
    df = clashing(frame(spark, ROWS))
    out = m.deduplicate(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "The quick brown fox jumps over\nshort", 3: None, None: "The quick brown fox jumps over", 4: "", 6: "A quite different line of text"}


def test_repeated_rows_and_nothing(spark):
    line = "a line that is long enough"
    assert m.near_lines(frame(spark, [])).count() == 0 and m.deduplicate(frame(spark, [])).count() == 0
    twice = m.deduplicate(frame(spark, [(1, line), (1, line), (2, line + "\nx")])).collect()
    assert [(r.doc_id, r.text) for r in sorted(twice)] == [(1, line), (1, line), (2, "x")]
    long = "z" * 200_000
    assert found(m.near_lines(frame(spark, [(1, long), (2, long[:-1])]))) == {(1, 0): (1, 0, 1, 1), (2, 0): (1, 0, 1, 1)}


def test_an_edit_of_a_character_is_two_of_words_at_most():
    rng = random.Random(4)
    for _ in range(20_000):
        s = "".join(rng.choice("ab c\t") for _ in range(rng.randrange(1, 30))).strip()
        i, c = rng.randrange(len(s) + 1), rng.choice("ab \t ")
        t = rng.choice([s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :]]).strip()
        assert m.distance(m.words_of(s), m.words_of(t)) <= 2


@pytest.mark.parametrize("words", [10, 25])
def test_lines_whose_partners_are_found_by_words(spark, words):
    """Lines on both sides of the length from which words imply characters: nothing is lost, no pair is counted twice."""
    rng, rows = random.Random(words), []
    for i in range(16):
        base = [f"w{rng.randrange(50)}" for _ in range(rng.choice([3, 7, 8, 9, 10, 18, 19, 20, 21, 40]))]
        for _ in range(4):
            line = " ".join(base)
            if rng.random() < 0.6:
                at, c = rng.randrange(len(line)), rng.choice(" xy")
                line = rng.choice([line[:at] + c + line[at:], line[:at] + line[at + 1 :]])
            if rng.random() < 0.4:
                parts = line.split()
                parts[rng.randrange(len(parts))] = "new"
                line = " ".join(parts)
            rows.append((len(rows), line))
    for threshold in (m.Threshold(words=words), m.Threshold(edits=2, words=words), m.Threshold(percent=4, most=3, words=words)):
        assert found(m.near_lines(frame(spark, rows), threshold=threshold, group=3 if threshold.edits == 2 else 512)) == m.brute_force(rows, threshold)


@pytest.mark.parametrize("apart", [False, True])
def test_arrays_and_plain_loops_agree(apart):
    rng = random.Random(6)
    for words in (False, True):
        threshold = m.Threshold(edits=1, exact_below=4) if not words else m.Threshold(edits=0, percent=20, exact_below=1)
        beside = m.Threshold(edits=1, words=20) if words else None
        group = []
        for i in range(120):
            base = [rng.choice("abcdefgh") * 3 for _ in range(rng.choice([6, 7, 11]))] if i % 3 == 0 else list(group[-1].line.split(" "))
            base[rng.randrange(len(base))] = rng.choice(["x", "yy", "abc"])
            keys = [5, *rng.sample(range(9), 3)]
            group.append(m._Member(rng.randrange(2), rng.random() < 0.3, (i, 0), " ".join(base), keys, [k for k in keys if rng.random() < 0.7 or k == 5], words))
        for member in group:
            member._indexed = member.indexed - {5} if member.probe else member.indexed | {5}
        groups = m._Groups(threshold, words, beside)
        plain, arrays = groups._plain(5, apart, group), groups._arrays(5, apart, group)
        assert plain[0] == arrays[0] and sum(plain[0]) > 0
        assert _classes(plain[1], 120) == _classes(arrays[1], 120) and len(arrays[1]) < 120


def _classes(edges, n):
    top = list(range(n))
    for i, j in edges:
        old, new = top[j], top[i]
        top = [new if t == old else t for t in top]
    return {frozenset(i for i in range(n) if top[i] == t) for t in set(top)}


def test_rows_of_a_large_class_are_not_its_pairs(spark):
    """3,000 lines that are all within one word of each other: a few rows a line are stored, and all pairs are counted."""
    base = " ".join(f"word{i}" for i in range(12))
    lines = spark.range(3000).selectExpr("id AS doc_id", f"concat('{base} last', id) AS text")
    places = lines.selectExpr("doc_id", "text")
    each = m._each_line(places)
    firsts = each.select("h1", "h2", "doc_id", "line_no")
    found_ = m._word_links(places, firsts, m.Threshold(words=10).of_words(), m.Threshold(words=10))
    assert found_.count() <= 12 * 3000 and found_.agg({"n": "sum"}).first()[0] + _by_characters(m, places, firsts) == 3000 * 2999


def _by_characters(m, places, firsts):
    return m._links(places, firsts, m.Threshold(words=10), 512).agg({"n": "sum"}).first()[0] or 0


def test_sketches_of_either_sign():
    """Sketches come as signed numbers; links don't hang on the sign."""
    threshold = m.Threshold(edits=0, percent=50 - 1, exact_below=1)
    a = m._Member(0, False, (1, 0), "a b c d", [5], [5], True, 4, -(1 << 63))
    b = m._Member(0, False, (2, 0), "a b c e", [5], [5], True, 4, 0)
    assert m._Groups(threshold, True, None)._plain(5, False, [a, b])[0] == [1, 1]
    assert m._Groups(threshold, True, None)._arrays(5, False, [a, b])[0] == [1, 1]


def _near_copies(rng, n):
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([9, 10, 14, 25, 40]))] for _ in range(n)]
    return [(i, "\n".join(reworded(rng, " ".join(rng.choice(base)), rng.randrange(4)) for _ in range(6))) for i in range(n)]


def test_lines_that_meet_often_are_compared_in_one_group(spark):
    """Two lines that have most of their keys in common are rows of one group, not of each key."""
    rng = random.Random(2)
    lines = [" ".join(f"{rng.randrange(10**6):x}" for _ in range(60)) for _ in range(50)]
    documents = frame(spark, [*enumerate(lines), *((100 + i, f"first {line}") for i, line in enumerate(lines))])
    threshold = m.Threshold(words=10)
    met = m._met(m._packed_rows(documents, threshold.of_words(), threshold, 2, [], 3), threshold.of_words())
    assert met.select("key", "h1", "h2").distinct().count() == met.select("h1", "h2").distinct().count() == 100


@pytest.mark.parametrize("block, most", [(2, 30), (5, 200), (m.BLOCK, 1)])
def test_small_and_large_groups_find_the_same(spark, block, most):
    """Large groups, and buckets that are too full to be held, lose no link and count none twice."""
    rows = _near_copies(random.Random(block), 60)
    documents, threshold = frame(spark, rows), m.Threshold(words=10)
    firsts = m._each_line(documents).groupBy("h1", "h2").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "doc_id").join(m._each_line(documents), ["h1", "h2", "doc_id"]).dropDuplicates(["h1", "h2"])
    packed = m._packed_rows(documents, threshold.of_words(), threshold, 2, [], 2)
    met = m.stored(m._met(packed, threshold.of_words(), block, most), "met")
    assert (m._LARGE in {r.kind for r in met.collect()}) == (block < m.BLOCK)
    counts = {}
    for links in (m._links(documents, firsts, threshold, 512, met), m._word_links(documents, firsts, threshold.of_words(), threshold, met)):
        for r in links.filter("n > 0").collect():
            counts[r.a1, r.a2] = counts.get((r.a1, r.a2), 0) + r.n
    expected = m.brute_force(rows, threshold)
    by_place = {(i, n): m.identity(line) for i, value in rows for n, line in m._lines(value)}
    assert counts == {by_place[place]: n for place, (*_, n) in expected.items() if n} and len(counts) > 50


def test_packed_keys_are_those_of_rows(spark):
    documents, threshold = frame(spark, _near_copies(random.Random(1), 30) + [(99, None), (98, " \n")]), m.Threshold(words=10)
    grams, characters = set(), set()
    for r in m._packed_rows(documents, threshold.of_words(), threshold, 2, [], 5).collect():
        (grams if r.bucket >= 0 else characters).update((x["key"].item(), x["h1"].item(), x["h2"].item(), x["probe"].item()) for x in m.np.frombuffer(r.records, m._RECORD))
    assert characters == {(r.key, r.h1, r.h2, r.probe) for r in m._key_rows(documents, threshold).collect()} and characters
    assert grams == {(r.key, r.h1, r.h2, r.probe) for r in m._gram_rows(documents, threshold.of_words(), 2, []).collect()}


def test_classes_where_halves_of_hashes_clash(spark, monkeypatch):
    """Names of nodes by half a hash and by whole ones give the same classes."""
    rows = _near_copies(random.Random(4), 20)
    whole = found(m.near_lines(frame(spark, rows), threshold=m.Threshold(words=10)))
    monkeypatch.setattr(m.F, "count_distinct", lambda c: m.F.lit(-1))
    assert found(m.near_lines(frame(spark, rows), threshold=m.Threshold(words=10))) == whole == m.brute_force(rows, m.Threshold(words=10))


@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14), st.integers(0, 9)), min_size=1, max_size=20), st.sampled_from([1, 60, 1 << 20]))
@settings(deadline=None)
def test_distances_of_many_pairs_at_once(pairs, cells):
    """Pairs of any lengths and thresholds, in chunks or one by one, agree with the textbook table."""
    pairs = [(s, t, max(k, abs(len(s) - len(t)))) for s, t, k in pairs]
    lines = [" ".join(x) for s, t, _ in pairs for x in (s, t)]
    a, most = m.np.arange(0, 2 * len(pairs), 2), m.np.array([k for *_, k in pairs])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(m, "CELLS", cells)
        found = m.words_within(*m.coded(m.pa.array(lines)), a, a + 1, most)
    assert found.tolist() == [m.distance(s, t) <= k for s, t, k in pairs]


def test_numbers_of_words():
    words, begin = m.coded(m.pa.chunked_array([["a\tb  a\x0b\u00a0", "", "b\u2003a é"], ["é \x00 b"]]))
    assert begin.tolist() == [0, 4, 4, 6, 9]
    a, b, c = words[0], words[1], words[5]
    assert words[2] == a and words[8] == b and words[6] == c and len(set(words.tolist())) == 6


@pytest.mark.parametrize("pairs", [1, 1 << 15])
def test_groups_of_words_are_compared_by_arrays(monkeypatch, pairs):
    """Several groups, of two blocks or one, give what each gives by plain loops; no pair of words is compared by itself."""
    rng = random.Random(8)
    threshold, beside = m.Threshold(edits=0, percent=20, exact_below=1), m.Threshold(edits=1, words=20)
    rows, expected, classes = [], {}, {}
    places = m._Groups(threshold, True, beside)
    for key, q in ((4, 0), (5, 1), (6, 0), (7, 0)):
        group = []
        for i in range(60 if key < 7 else 1):
            base = [rng.choice("abcdefgh") * 3 for _ in range(rng.choice([6, 7, 11, 21]))] if i % 3 == 0 else list(group[-1].line.split(" "))
            at = rng.randrange(len(base))
            base[at : at + rng.randrange(2)] = [rng.choice(["x", "yy", "abc"])]
            probe = rng.random() < 0.3
            keys = sorted({key, *rng.sample(range(9), 3)})
            indexed = [k for k in keys if k != key and rng.random() < 0.7] + [key] * (not probe)
            group.append(m._Member(rng.randrange(2) if q else 0, probe, (key, i), " ".join(base), keys, indexed, True))
            x = group[-1]
            sketch = x.sketch - (1 << 64) if x.sketch >> 63 else x.sketch
            rows.append((key, 0, q, x.block, probe, key, i, x.line, keys, indexed, x.size, sketch))
        counts, edges = places._plain(key, q > 0, group)
        expected |= {(key, i): n for i, n in enumerate(counts) if n}
        classes[key] = _classes(edges, len(group))
    integers, lists = m.pa.int64(), m.pa.list_(m.pa.int64())
    kinds = [integers, m.pa.int32(), m.pa.int32(), m.pa.int32(), m.pa.bool_(), integers, integers, m.pa.string(), lists, lists, m.pa.int32(), integers]
    members = m.pa.Table.from_arrays([m.pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f"c{i}" for i in range(12)])
    monkeypatch.setattr(m, "PAIRS", pairs)
    monkeypatch.setattr(m, "distance_within", lambda s, t, k, whole=m.distance_within: isinstance(s, str) and whole(s, t, k))
    made = m._Compared(threshold, beside).rows(members).to_pylist()
    assert {(r["a1"], r["a2"]): r["n"] for r in made if r["n"]} == expected and len(expected) > 60
    for key, of in classes.items():
        edges = [(r["a2"], r["b2"]) for r in made if r["a1"] == key and r["b1"] is not None]
        assert _classes(edges, 60 if key < 7 else 1) == of
