import hashlib
import random
import secrets as generator

from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import secrets as s
from tests.llm.data import clashing, corpus, frame, prose

PIECES = ["password", "Token", "API_KEY", "secret", "passwd", "=", ":", " ", '"', "'", "AKIA", "abcdef", "0123456789", "AB12", "ſecret", "é", "K", "\n", "f" * 31, "x.y-z"]


@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_patterns_equal_plain_expressions(value):
    import pyarrow as pa

    found = s.find(pa.array([value, None, ""]))
    base = [x for x in found.get(0, []) if x[1] < 3]
    assert (*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(s.digest(base).encode()).hexdigest()) == s.brute_force(value)
    assert 1 not in found and 2 not in found


def test_report(spark):
    rng = random.Random(9)
    key = "AKIA" + "Q7" * 8
    rows = corpus(2, 20) + [(500, f'é token = "{generator.token_hex(20)}" {key} pass'), (501, prose(rng, 40) + " k3ZfQ9vLm0TzXw7RbYd2HsUe " + prose(rng, 40)), (502, None)]
    out = {r.doc_id: r for r in s.report(clashing(frame(spark, rows))).collect()}
    assert len(out) == len(rows)
    for i, value in rows:
        r = out[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == s.brute_force(value)
    assert (out[500].n_assign, out[500].n_access, out[500].n_hex) == (1, 1, 1) and out[502].spans == ""
    a, b = out[501].spans.removeprefix("random:").split(":")
    assert dict(rows)[501][int(a) : int(b)] == "k3ZfQ9vLm0TzXw7RbYd2HsUe"
    assert s.report(frame(spark, [])).count() == 0


def test_battery_separates_keys_from_text():
    keys = [generator.token_urlsafe(32) for _ in range(100)] + [generator.token_hex(16).upper() for _ in range(100)]
    assert sum(bool(s.discoveries([k])) for k in keys) >= 190
    plain = ["internationalization-of-things", "some_long_variable_name_22", "images/2020/03/thumbnail-0123456", "ThisIsACamelCaseClassName", "aaaaaaaaaa1111111111aaaa", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef0123456789abcdef"]
    assert s.discoveries(plain) == []


def test_more_candidates_need_more_evidence():
    rng = random.Random(1)
    weak = next(t for t in ("".join(rng.choice(s.ENCODINGS["hex"]) for _ in range(20)) for _ in range(10_000)) if s.battery(t, "hex") > s.ALPHA and 8 < s.log_evidence(t, "hex") < 9)
    assert s.discoveries([weak]) == [0] and s.discoveries([weak] + ["plain_text_of_no_use_at_all"] * 200) == []


def test_keys_inside_runs_that_no_alphabet_holds():
    import pyarrow as pa

    key, other = "k3ZfQ9vLm0TzXw7RbYd2HsUe", "wJ4lrXUtnFEMI7K2bPxRfiCYq8EzLm3T"
    runs = [f"AWS_ACCESS_KEY_NAME={key}", f"export DB_PASS={key}== x", f"https://x.org/a?sig={key}&b=1", f"é /v1/hook-name/{key}", f"/v1/hook-{key}/name", f"A_KEY={key}=B_KEY={other}", f"A-B={key[:12]}/{key[12:]}"]
    found = s.find(pa.array(runs))
    for i, run in enumerate(runs):
        text = [run[a:e] for a, k, e in found[i] if k == 3]
        assert all(any(x in t for t in text) for x in (key, other) if x in run) and text
        assert all(len(t) < len(run) for t in text)
    assert [runs[0][a:e] for a, _, e in found[0]] == [key] and [runs[1][a:e] for a, _, e in found[1]] == [key + "=="] and [runs[5][a:e] for a, _, e in found[5]] == [key, other]
    assert s.candidates("images/2020/03/thumbnail-0123456") == [(0, 24)]
    assert s.find(pa.array(["/some/long-path/of_plain/words-and_names=2020/thumbnails/internationalization-of-things"])) == {}


def test_redaction(spark):
    key = generator.token_hex(20)
    rows = [(1, f"é token = {key} end"), (2, None), (3, "nothing")]
    out = {r.doc_id: r.text for r in s.redact(frame(spark, rows)).collect()}
    assert out == {1: "é [SECRET] end", 2: None, 3: "nothing"}


def test_very_long_texts_repeated_rows_and_null_ids(spark):
    rng = random.Random(3)
    long = "é " + " ".join(f"{rng.getrandbits(128):032x} token={rng.getrandbits(60):015x} plain" for _ in range(20_000))
    rows = [(1, long), (1, long), (None, "secret: abcdefgh1"), (None, "secret: abcdefgh1"), (2, "a" * 2_000_000), (None, None)]
    out = s.report(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in out) == sorted((i or 0, *s.brute_force(t)) for i, t in rows)


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=12), st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=12))
def test_random_spans_keep_apart_from_base_ones(random_, base_):
    random_, base = [(a, a + n) for a, n in random_], [(a, 0, a + n) for a, n in base_]
    wanted, last = [], 0
    for a, b in sorted(random_, key=lambda x: (x[0], -x[1])):
        if b > last and not any(a < y and x < b for x, _, y in base):
            wanted.append((a, b))
            last = b
    assert s.apart(random_, base) == wanted
