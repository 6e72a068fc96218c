"""Secret scans: pattern spans, and tokens that a battery of randomness tests takes for generated keys.

Pattern spans (kinds assign, access, hex) are leftmost and non-overlapping per kind. The battery looks at every run of
``MIN_TOKEN`` or more characters of [A-Za-z0-9+/_=-] that mixes kinds of characters. It infers the narrowest encoding
that holds the run (hex, base32, lower or mixed alphanumerics, base64) and then asks two things. A run that no alphabet
holds, such as NAME=value or a path, is cut at ``=`` (but for padding at its end) and, for each alphabet in turn, at what
is foreign to it; each part of ``MIN_TOKEN`` or more characters is a candidate of its own.

* Does anything speak against uniform draws from that alphabet? Chi-squared over the symbols, a runs test about the
  median and the lag-one serial correlation, each at ``ALPHA`` / 3.
* Does enough speak for them? The likelihood ratio of uniform draws against prose (class changes and letter
  frequencies) is an e-value, as its mean over prose is at most one. It grows with the length, so that a short run needs
  cleaner evidence. Over all candidates of a document the e-values go through the step-up rule of e-BH, which keeps the
  expected share of false discoveries below ``RATE`` under any dependence.

What passes both and lies in no pattern span is a span of kind ``random``; one inside another is left out.

Defined cases: a null or empty text has no spans, and the digest of the empty string; equal rows get equal results; whole
texts are read, however long; offsets count code points, the end is exclusive; other columns are ignored by ``report``
and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import _text as text
from millrace.llm._work import arrow_schema, bounded_batches, task

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_TOKEN = 8, 16, 32, 20
ALPHA, RATE = 0.003, 0.001

_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True
_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
#: Lower case, upper case, digit, other.
_CLASS = np.full(256, 3, dtype=np.int8)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2

_UPPER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Narrowest first.
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "lower36": _DIGITS + _UPPER.lower(),
    "upper36": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _UPPER.lower(),
    "base64": _UPPER + _UPPER.lower() + _DIGITS + "+/",
    "base64url": _UPPER + _UPPER.lower() + _DIGITS + "-_",
}
_SYMBOLS = {k: {c: i for i, c in enumerate(v)} for k, v in ENCODINGS.items()}
_PARTS = [re.compile(f"[{re.escape(v)}]{{{MIN_TOKEN},}}") for v in ENCODINGS.values()]

#: Log chances of prose: from class to class (lower, upper, digit, other), and of letters by rank in use.
_STEP = np.log(np.array([[0.95, 0.02, 0.01, 0.02], [0.50, 0.40, 0.05, 0.05], [0.06, 0.04, 0.85, 0.05], [0.55, 0.15, 0.20, 0.10]]))
_WITHIN = np.full(256, -math.log(5))
_RANKED = "etaoinshrdlucmfwygpbvkxjqz"
_share = 1 / (np.arange(26) + 3.0)
for _i, _c in enumerate(_RANKED):
    _WITHIN[ord(_c)] = _WITHIN[ord(_c.upper())] = math.log(_share[_i] / _share.sum())
_WITHIN[0x30:0x3A] = -math.log(10)


def encoding(token: str) -> str | None:
    """The narrowest encoding whose alphabet holds ``token``."""
    used = set(token)
    return next((k for k, v in _SYMBOLS.items() if used <= v.keys()), None)


def candidates(token: str) -> list[tuple[int, int]]:
    """Places in a run of what is tested: all of it, or its parts if no alphabet holds it."""
    bare = token.rstrip("=")
    if encoding(bare):
        return [(0, len(token))]
    found = {m.span() for parts in _PARTS for m in parts.finditer(bare)}
    return sorted((a, len(token) if b == len(bare) else b) for a, b in found)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str, kind: str) -> float:
    """The smallest p-value, times three, of the tests against uniform draws from the encoding."""
    symbols = np.array([_SYMBOLS[kind][c] for c in token], dtype=float)
    n, k = len(symbols), len(_SYMBOLS[kind])
    counts = np.bincount(symbols.astype(int), minlength=k)
    chi = float((counts * counts).sum()) * k / n - n
    least = [_normal_tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))]
    above = symbols > (k - 1) / 2
    ups = int(above.sum())
    if 0 < ups < n:
        runs = 1 + int((above[1:] != above[:-1]).sum())
        mean = 1 + 2 * ups * (n - ups) / n
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        least.append(2 * _normal_tail(abs(runs - mean) / spread))
    else:
        least.append(2.0 ** (1 - n))
    d = symbols - symbols.mean()
    if (v := float((d * d).sum())) > 0:
        r = float((d[1:] * d[:-1]).sum()) / v
        least.append(2 * _normal_tail(abs(r + 1 / n) * math.sqrt(n)))
    else:
        least.append(0.0)
    return 3 * min(least)


def log_evidence(token: str, kind: str) -> float:
    """Log likelihood of uniform draws less that of prose."""
    data = np.frombuffer(token.encode(), dtype=np.uint8)
    classes = _CLASS[data]
    prose = float(_WITHIN[data].sum() + _STEP[classes[:-1], classes[1:]].sum()) - math.log(4)
    return -len(data) * math.log(len(_SYMBOLS[kind])) - prose


def discoveries(tokens: list[str]) -> list[int]:
    """Positions of the tokens that the battery and e-BH take for random."""
    scored = []
    for i, token in enumerate(tokens):
        if kind := encoding(token.rstrip("=")):
            bare = token.rstrip("=")
            if len(bare) >= MIN_TOKEN and battery(bare, kind) >= ALPHA:
                scored.append((log_evidence(bare, kind), i))
    scored.sort(reverse=True)
    m, last = len(tokens), 0
    for j, (e, _) in enumerate(scored, 1):
        if e >= math.log(m / (RATE * j)):
            last = j
    return sorted(i for _, i in scored[:last])


def pattern_spans(value: str, assign: bool = True, access: bool = True) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of the pattern spans of one text, hex apart."""
    out = []
    if assign:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(value) if len(m[2]) >= MIN_ASSIGN]
    if access:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(value) if len(m[0]) >= MIN_ACCESS]
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def apart(random: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Those of ``random`` that overlap no span of ``base`` and don't end inside one chosen before; both lists are walked once."""
    # Spans of several kinds may overlap: their union, in order.
    union: list[list[int]] = []
    for x, _, y in sorted(base):
        if union and x <= union[-1][1]:
            union[-1][1] = max(union[-1][1], y)
        else:
            union.append([x, y])
    out, last, at = [], 0, 0
    for s, e in sorted(random, key=lambda place: (place[0], -place[1])):
        while at < len(union) and union[at][1] <= s:
            at += 1
        if e > last and not (at < len(union) and union[at][0] < e):
            out.append((s, e))
            last = e
    return out


def _found(data: bytes, word: bytes):
    at = data.find(word)
    while at >= 0:
        yield at
        at = data.find(word, at + len(word))


def find(column) -> dict[int, list[tuple[int, int, int]]]:
    """Spans, sorted, of each row that has any; a row's spans are (start, place in KINDS, end) in code points."""
    out: dict[int, list] = {}
    for a, _, data, offsets in text.chunks(column):
        low = text.LOWER[data].tobytes()
        raw = data.tobytes()
        row = lambda at: int(np.searchsorted(offsets, at, side="right")) - 1
        assigns = {row(at) for w in KEYWORDS for at in _found(low, w)}
        accesses = {row(at) for at in _found(raw, b"AKIA")}
        long = {}
        for name, table, least in (("hex", _HEX, MIN_HEX), ("token", _TOKEN, MIN_TOKEN)):
            starts, ends, _ = text.words(data, offsets, table)
            kept = np.flatnonzero(ends - starts >= least)
            for s, e in zip(starts[kept].tolist(), ends[kept].tolist()):
                if name == "hex" or len(np.unique(_CLASS[data[s:e]])) > 1:
                    long.setdefault(row(s), {}).setdefault(name, []).append((s, e))
        for d in assigns | accesses | long.keys():
            begin = int(offsets[d])
            value = raw[begin : offsets[d + 1]].decode("utf-8", "replace")
            if len(value) == offsets[d + 1] - begin:
                place = lambda at: at - begin
            else:
                # Code points that begin before each byte: all bytes but those that go on a character.
                before = np.concatenate([[0], np.cumsum((data[begin : offsets[d + 1]] & 0xC0) != 0x80)])
                place = lambda at: int(before[at - begin])
            spans = pattern_spans(value, d in assigns, d in accesses)
            mine = long.get(d, {})
            spans += [(place(s), 2, place(e)) for s, e in mine.get("hex", ())]
            if tokens := [(place(s), place(e)) for s, e in mine.get("token", ())]:
                tokens = [(s + x, s + y) for s, e in tokens for x, y in candidates(value[s:e])]
                random = [tokens[i] for i in discoveries([value[s:e] for s, e in tokens])]
                spans += [(s, 3, e) for s, e in apart(random, spans)]
            if spans:
                out[a + d] = sorted(spans)
    return out


def report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, counts of pattern spans, base_sha256 and spans."""
    bounded_batches(documents.sparkSession)
    slim = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    schema = T.StructType([slim.schema["doc_id"], *T.StructType.fromDDL("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")])
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            found = find(batch.column(1))
            counts, hashed, listed = [[], [], []], [], []
            for d in range(batch.num_rows):
                spans = found.get(d, [])
                base = [s for s in spans if s[1] < 3]
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                hashed.append(hashlib.sha256(digest(base).encode()).hexdigest())
                listed.append(digest(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashed, pa.string()), pa.array(listed, pa.string())], schema=arrow)

    return slim.mapInArrow(task("secrets", run), schema)


def redact(documents: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with ``mark`` in place of each span; overlapping spans are one."""
    bounded_batches(documents.sparkSession)
    schema = documents.schema
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            found = find(batch.column(at))
            columns = list(batch.columns)
            if found:
                values = columns[at].to_pylist()
                for d, spans in found.items():
                    parts, end = [], 0
                    for s, _, e in spans:
                        if s >= end:
                            parts += [values[d][end:s], mark]
                        end = max(end, e)
                    values[d] = "".join([*parts, values[d][end:]])
                columns[at] = pa.array(values, columns[at].type)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return documents.mapInArrow(task("secrets", run), schema)


def brute_force(value: str | None) -> tuple[int, int, int, str]:
    """The pattern spans of one text by plain regular expressions, for tests."""
    value = value or ""
    spans = pattern_spans(value) + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", value) if len(m[0]) >= MIN_HEX]
    return (*(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(digest(spans).encode()).hexdigest())
