"""Line dedup: a segment-partition edit join over the distinct lines of a corpus.

Lines (parts between line feeds, without white space at the ends, that are not empty) are linked if no more edits of one
character than a ``Threshold`` allows turn one into the other. What it allows depends on the longer line's length: none
for short lines, so that these are linked with equal ones only, then a number that may grow with the length. It may also
allow a share of the longer line's words to be replaced, left out or put in; lines within either are linked.

A line of n characters is cut into t + 1 segments of nearly equal length, t being the threshold; t edits leave one of
them intact. Each segment, with its place, the length n and the threshold, is a key in an index of substrings. A line of
m characters probes the index for each length n from m - t to m, by those of its substrings that can be the intact
segment: for segment j, the part before it has j edits at most and the part after it t - j, which bounds how far it has
moved on either side.

Keys that belong to one line only, nearly all, end in the first aggregation. A key that many lines share is cut again:
what lies before or after the shared segment is a line of its own, with the edits that are left for it, and falls into
segments by the same rule. So a group of lines that share any part, however large, comes apart into groups whose members
share ever more; where nothing is left to cut, its members are within the threshold but for a few. Groups are verified
one by one in sorted partitions, large ones in pairs of blocks, by a banded bit-parallel edit distance. No plan node
emits pairs that are not links.

Words are joined by their rarest grams of two words. Each line's grams are put in one order that holds for all lines, about
from rare to common by a sample, which is of no weight for what is found, and the first stand for it, until more of them are
apart than words may be edited: one of these is left in any partner, and the line whose last comes first has it in common
with the other. Of the lines that share a key only those go on whose sketches (words of 64 classes, odd or even) are as near
as edits allow, and their texts are fetched for that. Lines of so many words that an edit of a character, two edits of words at
most, is always within the word edits have no keys of characters.

A pair is compared in the first group that it shares, by arrays of lengths, sketches and numbered words first. What leaves a
task is, for each group, the number of links of each line and the edges that join classes, no more rows than lines: sums of
the numbers are exact, as each pair is counted once. Links give classes of lines. A line is kept where it is the first of its class by
(id, line number).

Defined cases: null and empty texts have no lines; a row with a null id takes no part; rows with one id share their line
numbers, and a line that is first in several of them is kept in each; an empty table gives no rows; very long lines are
lines like others; other columns are kept by ``deduplicate``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import ne

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _text as text
from millrace.llm._work import among, arrow_schema, aside, bounded_batches, discard, keeps, stored, task
from millrace.llm.components import components

#: Lines whose keys a task holds before it hands them on, and their characters.
LINES, CHARS = 4096, 1 << 19
#: A group of more lines is cut again; one that can't be cut, or has more bytes, is verified in pairs of blocks of so many.
GROUP, BYTES = 512, 16 << 20
#: Words of a gram, at most; lines of the sample that tells which are common, about, and how many words and grams of it are held.
GRAM, SAMPLE, COMMON, COMMON_BITS = 2, 20_000, 1 << 16, 20
#: Lines of a group whose sketches are compared at once.
BLOCK = 2048
#: Pairs of lines of words that are compared at once, about, and cells of their bands.
PAIRS, CELLS = 1 << 15, 1 << 20
#: Records of keys of a bucket, about, and those that a task packs at once.
BUCKET, PACK = 1 << 17, 1 << 18
_RECORD = np.dtype([("key", "<i8"), ("h1", "<i8"), ("h2", "<i8"), ("sketch", "<i8"), ("n", "<i4"), ("probe", "?")])
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Threshold:
    """Edits allowed between two lines by the length of the longer one: none below ``exact_below`` characters; else
    ``edits``, or ``percent`` of the length if that is more, but ``most`` at most. Beside that, edits of whole words up to
    the percentage ``words`` of the longer one's."""

    edits: int = 1
    percent: int = 0
    most: int | None = None
    exact_below: int = 16
    words: int = 0

    def __post_init__(self):
        if self.edits < 0 or not 0 <= self.percent < 50 or not 0 <= self.words < 50 or (self.most is not None and self.most < self.edits):
            raise ValueError("edits must be 0 or more, percent and words between 0 and 49, and most no less than edits")

    def of_words(self) -> Threshold:
        """The same over sequences of words."""
        return _over_words(self.words)

    def of(self, n: int) -> int:
        if n < self.exact_below:
            return 0
        grown = max(self.edits, n * self.percent // 100)
        return grown if self.most is None else min(grown, self.most)

    def by_words(self, line: str) -> bool:
        """Whether every line within the character edits of ``line`` is within its word edits as well: an edit of a character is
        two of words at most, where it parts or joins them."""
        if not self.words or not (t := max((self.of(len(line)), *self.of_probes(len(line))))):
            return False
        return self.of_words().of(len(line.encode("utf-8", "surrogatepass").split())) >= 2 * t

    def of_probes(self, n: int) -> list[int]:
        """Thresholds with which lines of ``n`` characters or more may probe for lines of ``n``."""
        found, m = set(), max(n, self.exact_below)
        while m - self.of(m) <= n:
            found.add(self.of(m))
            m += 1
        return sorted(found - {0})


@lru_cache(maxsize=1 << 16)
def implied(n: int, threshold: Threshold) -> int:
    """Words from which a line of ``n`` characters is one of those that ``Threshold.by_words`` tells."""
    t = max((threshold.of(n), *threshold.of_probes(n)))
    return -(-200 * t // threshold.words) if t and threshold.words else 1 << 62


@lru_cache
def _over_words(percent: int) -> Threshold:
    return Threshold(edits=0, percent=percent, exact_below=1)


def cuts(r: int, t: int) -> list[int]:
    """Where ``r`` characters are cut into ``t`` + 1 segments, the longer ones last."""
    size, more = divmod(r, t + 1)
    return [i * size + max(0, i - (t + 1 - more)) for i in range(t + 2)]


@lru_cache(maxsize=1 << 12)
def moves(r: int, t: int, delta: int) -> tuple[tuple[int, int, int, int], ...]:
    """(segment, its begin and length among ``r`` characters, its begin among ``r`` + ``delta``) of all that may match."""
    at, out = cuts(r, t), []
    for j in range(t + 1):
        a, size = at[j], at[j + 1] - at[j]
        for shift in range(max(-j, delta - (t - j)), min(j, delta + (t - j)) + 1):
            if 0 <= a + shift and a + shift + size <= r + delta:
                out.append((j, a, size, a + shift))
    return tuple(out)


def first_cuts(n: int, threshold: Threshold) -> Iterator[tuple[int, int, int, bool, tuple]]:
    """(seed, begin, end, probe, stretches left) of the keys of a line of ``n`` characters. A stretch is (begin, end, edits
    left for it, its length in the indexed line)."""

    def made(t: int, r: int, j: int, a: int, size: int, b: int, probe: bool) -> tuple:
        left = ((0, b, j, a), (b + size, n, t - j, r - a - size))
        return ((r << 20 | t) << 12 | j) & _MASK, b, b + size, probe, tuple(x for x in left if x[3])

    for t in threshold.of_probes(n):
        for j, a, size, b in moves(n, t, 0):
            if a == b:
                yield made(t, n, j, a, size, b, False)
    own = threshold.of(n)
    for r in range(max(n - own, 1), n + 1) if own else ():
        for j, a, size, b in moves(r, own, n - r):
            if r < n or a != b:
                yield made(own, r, j, a, size, b, True)


@lru_cache(maxsize=1 << 12)
def plan(n: int, threshold: Threshold) -> tuple[tuple[tuple[int, int, int], ...], tuple[bool, ...]]:
    """((seed, begin, end) of each key, whether it is a probe only) of a line of ``n`` characters."""
    found = list(first_cuts(n, threshold))
    return tuple(x[:3] for x in found), tuple(x[3] for x in found)


def _forget() -> None:
    plan.cache_clear()
    moves.cache_clear()
    implied.cache_clear()


keeps("lines", _forget)


def run_words(threshold: Threshold) -> int:
    """Words of a gram, at most: so many that every line that has partners holds more of them, apart, than may be edited."""
    most = 0
    for n in range(1, 100 * 100 // threshold.percent):
        if of := threshold.of_probes(n):
            most = min(most or n, n // (of[-1] + 1))
    return most


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def key_of(part: str, seed: int) -> int:
    return signed(xxhash.xxh3_64_intdigest(part, seed=seed))


def again(line: str, key: int, probe: bool, left) -> Iterator[tuple[int, bool, tuple]] | None:
    """(key, probe, stretches left) after the longest stretch is cut; None if there is nothing to cut."""
    able = [i for i, (_, _, t, r) in enumerate(left) if r > t]
    if not able:
        return None
    which = max(able, key=lambda i: (left[i][3], -i))
    a, b, t, r = left[which]
    rest = tuple(left[:which]) + tuple(left[which + 1 :])

    def made():
        if abs(b - a - r) <= t:
            for j, start, size, at in moves(r, t, b - a - r):
                stretches = ((a, a + at, j, start), (a + at + size, b, t - j, r - start - size))
                seed = (key ^ (j + 1) * 0x9E3779B97F4A7C15) & _MASK
                yield key_of(line[a + at : a + at + size], seed), probe or at != start, rest + tuple(x for x in stretches if x[3])

    return made()


def identity(line: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(line)
    return signed(h >> 64), signed(h & _MASK)


def distance_within(s: str | tuple, t: str | tuple, k: int) -> bool:
    """Whether the edit distance, of characters or of a tuple's items, is ``k`` or less: equal ends are cut off, a band of
    2k + 1 diagonals of the rest is held in the bits of one integer."""
    if len(s) > len(t):
        s, t = t, s
    if len(t) - len(s) > k:
        return False
    a, most = _common(s, t), len(s)
    if a == most:
        return True
    s, t, most = s[a:], t[a:], most - a
    b = _common(s[::-1], t[::-1])
    s, t = s[: most - b], t[: len(t) - b]
    m, n = len(s), len(t)
    if not m or n <= k:
        return n <= k
    # Bit i of a column stands for the row (column - k + i). Rows move up by one bit from column to column.
    width = 2 * k + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(s):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, cost = (full >> k) << k, 0, min(k, m)
    limit = 2 * k + n - m
    for j in range(1, n + 1):
        # Rows of this column's band are j - k to j + k; row r is character r - 1 of s.
        low = j - k - 1
        found = where.get(t[j - 1], 0)
        eq = (found >> low if low >= 0 else found << -low) & full
        zero = (((eq & plus) + plus) ^ plus | eq | minus) & full
        hp, hn = (minus | ~(zero | plus)) & full, zero & plus
        if j + k <= m:
            cost += not zero & top
            if cost > limit:
                return False
        else:
            # The last row is inside the band: follow it to the right.
            bit = 1 << (m - j + k)
            cost += bool(hp & bit) - bool(hn & bit)
        down = zero >> 1
        plus, minus = (hn | ~(down | hp)) & full, down & hp
    return cost <= k


def _common(s: str | tuple, t: str | tuple) -> int:
    """Characters or items that the beginnings share."""
    most, a, step = min(len(s), len(t)), 0, 16
    while a < most:
        b = min(a + step, most)
        if s[a:b] == t[a:b]:
            a, step = b, 2 * step
        elif step > 1:
            step = max(1, step // 4)
        else:
            break
    return a


def _lines(value: str | None) -> Iterator[tuple[int, str]]:
    """(number, line) of the lines that take part."""
    for number, line in enumerate((value or "").split("\n")):
        if line := line.strip():
            yield number, line


_WORD = re.compile(r"[^\x20\x09-\x0d]+")


def words_of(line: str) -> tuple[str, ...]:
    return tuple(_WORD.findall(line))


_TWO = "h1 bigint, h2 bigint"


def _each_line(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, h1, h2) of the lines that take part; ``documents`` has (doc_id, text)."""

    def run(batches):
        for batch in batches:
            ids, numbers, ones, twos = [], [], [], []
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                for number, line in _lines(value.as_py()):
                    h1, h2 = identity(line)
                    ids.append(i)
                    numbers.append(number)
                    ones.append(h1)
                    twos.append(h2)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, numbers, ones, twos)], names=["doc_id", "line_no", "h1", "h2"])

    return documents.mapInArrow(task("lines", run), f"doc_id bigint, line_no bigint, {_TWO}")


def _batches_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, tuple[int, int]]]]:
    """Lists of (line, its identity), each line once for a batch; the texts are the second column."""
    for batch in batches:
        seen: set[tuple[int, int]] = set()  # lines of one batch
        found, held = [], 0
        for value in batch.column(1):
            for _, line in _lines(value.as_py()):
                if (h := identity(line)) in seen:
                    continue
                seen.add(h)
                found.append((line, h))
                held += len(line)
                if len(found) == LINES or held >= CHARS:
                    yield found
                    found, held = [], 0
        yield found


_MEMBER = f"key bigint, probe boolean, {_TWO}"


def _key_rows(documents: DataFrame, threshold: Threshold) -> DataFrame:
    """(key, probe, h1, h2): keys of the lines, each line once for a batch; ``probe`` marks those that are not in the index. Lines
    whose partners are found by words have none."""

    digest = xxhash.xxh3_64_intdigest

    def made(found: list[tuple[str, tuple[int, int]]]) -> pa.RecordBatch:
        keys, probes, sizes = [], [], []
        for line, _ in found:
            own, probe = ((), ()) if threshold.by_words(line) else plan(len(line), threshold)
            sizes.append(len(own))
            keys += [digest(line[a:b], seed) for seed, a, b in own]
            probes += probe
        h = np.repeat(np.array([h for _, h in found], np.int64).reshape(-1, 2), sizes, axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(probes, pa.bool_()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["key", "probe", "h1", "h2"])

    def run(batches):
        for found in _batches_of_lines(batches):
            yield made(found)

    return documents.mapInArrow(task("lines", run), _MEMBER)


def _shared(rows: DataFrame) -> DataFrame:
    """Keys of two lines or more, one of them indexed. A key is summed up in each map task before it moves; half a line's
    hash is enough to see that it has a second one."""
    of = rows.groupBy("key").agg(F.min("h1").alias("least"), F.max("h1").alias("most"), F.min("probe").alias("probe"))
    return of.filter("not probe and least != most").select("key")


def _of(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` of ``keys``; nearly all others go before any of them move."""
    return among(rows, "key", keys).filter("_maybe").drop("_maybe").join(keys, "key", "left_semi")


def _texts(documents: DataFrame, at: DataFrame, wanted=lambda line: True) -> DataFrame:
    """(h1, h2, line) of the ``wanted`` lines at the places (doc_id, numbers)."""

    def run(batches):
        for batch in batches:
            rows = []
            for value, numbers in zip(batch.column(0), batch.column(1).to_pylist()):
                numbers = set(numbers)
                rows += [(*identity(line), line) for number, line in _lines(value.as_py()) if number in numbers and wanted(line)]
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["h1", "h2", "line"])

    some = among(documents, "doc_id", at.select("doc_id")).filter("_maybe").drop("_maybe")
    return some.join(at, "doc_id").select("text", "numbers").mapInArrow(task("lines", run), f"{_TWO}, line string").dropDuplicates(["h1", "h2"])


_LEFT = "left array<array<int>>"


def _cut_again(members: DataFrame, threshold: Threshold) -> DataFrame:
    """(old, key, probe, h1, h2, left) of members of large groups (key, probe, h1, h2, left, line); the key is null where
    nothing is left to cut. ``left`` is null for members of first groups, whose stretches their lines tell."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            rows = []
            for key, probe, h1, h2, left, line in zip(*columns):
                if left is None:
                    states = [x[3:] for x in first_cuts(len(line), threshold) if key_of(line[x[1] : x[2]], x[0]) == key]
                else:
                    states = [(probe, [tuple(x) for x in left])]
                for probe, state in states:
                    made = again(line, key, probe, state)
                    if made is None:
                        rows.append((key, None, probe, h1, h2, None))
                    else:
                        rows += [(key, k, p, h1, h2, s) for k, p, s in made]
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())))
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["old", "key", "probe", "h1", "h2", "left"])

    return members.select("key", "probe", "h1", "h2", "left", "line").mapInArrow(task("lines", run), f"old bigint, {_MEMBER}, {_LEFT}")


def _odd(parts: str | tuple[str, ...]) -> int:
    """Of each of 64 classes of parts whether there is an odd number. The classes are those of one process."""
    out = 0
    for part, n in Counter(parts).items():
        if n & 1:
            out ^= 1 << (hash(part) & 63)
    return out


class _Member:
    """A line of a group: its number of characters or words, whether it has an odd number of each of 64 classes of them, and its
    keys. Words and sets are made when they are first asked for, as most pairs are told apart without."""

    __slots__ = ("_indexed", "_keys", "_own", "_parts", "_sketch", "block", "h", "line", "probe", "size", "words")

    def __init__(self, block: int, probe: bool, h: tuple[int, int], line: str, keys: list[int], indexed: list[int], words: bool, size: int | None = None, sketch: int | None = None):
        self.block, self.probe, self.h, self.line, self.words = block, probe, h, line, words
        self._keys, self._indexed, self._parts, self._own = keys, indexed, None, None
        self._sketch = None if sketch is None else sketch & _MASK
        self.size = len(self.parts) if size is None else size

    @property
    def parts(self) -> str | tuple[str, ...]:
        if self._parts is None:
            self._parts = words_of(self.line) if self.words else self.line
        return self._parts

    @property
    def sketch(self) -> int:
        if self._sketch is None:
            self._sketch = _odd(self.parts)
        return self._sketch

    @property
    def keys(self) -> frozenset:
        if not isinstance(self._keys, frozenset):
            self._keys = frozenset(self._keys)
        return self._keys

    @property
    def indexed(self) -> frozenset:
        if not isinstance(self._indexed, frozenset):
            self._indexed = frozenset(self._indexed)
        return self._indexed

    def has_own(self, beside: Threshold) -> bool:
        """Whether the line has keys of characters."""
        if self._own is None:
            self._own = not beside.by_words(self.line)
        return self._own


class _Groups:
    """What a task finds in groups: how many links each line has, and edges that join classes, no more than there are lines.

    A pair is compared in the first group that it shares; two probes share none. ``beside``: the threshold of characters, whose
    pairs are left out where both lines have keys of characters, as they are found by these.
    """

    #: Lines from which a group is compared by arrays.
    ARRAYS = 12

    def __init__(self, threshold: Threshold, words: bool, beside: Threshold | None):
        self.threshold, self.words, self.beside = threshold, words, beside
        self.rows: list[tuple] = []

    def _near(self, x: _Member, y: _Member, most: int) -> bool:
        s, t = x.parts, y.parts
        if not ((self.words and len(s) == len(t) and sum(map(ne, s, t)) <= most) or distance_within(s, t, most)):
            return False
        return not self._beside(x, y)

    def _beside(self, x: _Member, y: _Member) -> bool:
        if self.beside is None:
            return False
        most = self.beside.of(max(len(x.line), len(y.line)))
        if abs(len(x.line) - len(y.line)) > most or not (x.has_own(self.beside) and y.has_own(self.beside)):
            return False
        return distance_within(x.line, y.line, most)

    def add(self, key: int, apart: bool, group: list[_Member]) -> None:
        """Compare a group's lines; ``apart``: only those of its two blocks with each other."""
        if all(m.probe for m in group):
            return
        counts, edges = (self._arrays if len(group) > self.ARRAYS else self._plain)(key, apart, group)
        self.rows += [(*m.h, n, None, None) for m, n in zip(group, counts) if n]
        self.rows += [(*group[i].h, 0, *group[j].h) for i, j in edges]

    def _plain(self, key: int, apart: bool, group: list[_Member]) -> tuple[list[int], list[tuple[int, int]]]:
        counts, edges, top = [0] * len(group), [], list(range(len(group)))
        for i, x in enumerate(group):
            for j in range(i + 1, len(group)):
                y = group[j]
                most = self.threshold.of(max(x.size, y.size))
                if (x.probe and y.probe) or (apart and x.block == y.block) or abs(x.size - y.size) > most:
                    continue
                if min((x.indexed & y.keys) | (x.keys & y.indexed)) != key:
                    continue
                # An edit changes two bits at most; a sketch of words is there, one of characters is no cheaper than the comparison.
                if self.words and (x.sketch ^ y.sketch).bit_count() > 2 * most:
                    continue
                if self._near(x, y, most):
                    counts[i] += 1
                    counts[j] += 1
                    if top[i] != top[j]:
                        edges.append((i, j))
                        old, new = top[j], top[i]
                        top = [new if t == old else t for t in top]
        return counts, edges

    def _candidates(self, key: int, apart: bool, group: list[_Member]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(a line, later ones that may be near, the edits allowed) by lengths, sketches and keys."""
        size = len(group)
        lengths, sketch = np.array([m.size for m in group]), np.array([m.sketch for m in group], np.uint64)
        most = np.array([self.threshold.of(n) for n in range(int(lengths.max()) + 1)])
        probe, block = np.array([m.probe for m in group]), np.array([m.block for m in group])
        # Of each key that comes before this one: the lines that have it, and those in whose index it is.
        having: dict[int, list[int]] = {}
        for i, m in enumerate(group):
            for k in m.keys:
                if k < key:
                    having.setdefault(k, []).append(i)
        shared = {k: (np.array(v), np.array([i for i in v if k in group[i].indexed], np.int64)) for k, v in having.items() if len(v) > 1}
        out = []
        for i in range(size - 1):
            x, rest = group[i], slice(i + 1, size)
            bound = most[np.maximum(lengths[rest], lengths[i])]
            may = (np.abs(lengths[rest] - lengths[i]) <= bound) & (np.bitwise_count(sketch[rest] ^ sketch[i]) <= 2 * bound)
            if x.probe:
                may &= ~probe[rest]
            if apart:
                may &= block[rest] != block[i]
            if not may.any():
                continue
            for k in x.keys:
                if k < key and k in shared:
                    found = shared[k][0] if k in x.indexed else shared[k][1]
                    may[found[np.searchsorted(found, i, side="right") :] - (i + 1)] = False
            at = np.flatnonzero(may)
            if len(at):
                out.append((i, at + i + 1, bound[at]))
        return out

    def _arrays(self, key: int, apart: bool, group: list[_Member]) -> tuple[list[int], list[tuple[int, int]]]:
        size = len(group)
        counts, edges, top = np.zeros(size, np.int64), [], np.arange(size)
        candidates = self._candidates(key, apart, group)
        if not candidates:
            return counts.tolist(), edges
        used = np.unique(np.concatenate([np.array([i for i, _, _ in candidates]), *(at for _, at, _ in candidates)])).tolist()
        if self.words:
            codes, where = self._codes(group, used)
            lengths = np.array([m.size for m in group])
        if self.beside is not None:
            chars, letters, own = np.array([len(m.line) for m in group]), np.zeros(size, np.uint64), np.zeros(size, bool)
            near = np.array([self.beside.of(n) for n in range(int(chars.max()) + 1)])
            for i in used:
                own[i] = group[i].has_own(self.beside)
                letters[i] = _odd(group[i].line) if own[i] else 0
        for i, at, bound in candidates:
            x = group[i]
            if self.words:
                same = lengths[at] == lengths[i]
                sure = np.zeros(len(at), bool)
                table = codes[int(lengths[i])]
                sure[same] = (table[where[at[same]]] != table[where[i]]).sum(axis=1) <= bound[same]
                for place in np.flatnonzero(~sure).tolist():
                    sure[place] = distance_within(x.parts, group[at[place]].parts, int(bound[place]))
                at = at[sure]
                if self.beside is not None and own[i]:
                    most_of = near[np.maximum(chars[at], chars[i])]
                    close = own[at] & (np.abs(chars[at] - chars[i]) <= most_of) & (np.bitwise_count(letters[at] ^ letters[i]) <= 2 * most_of)
                    for place in np.flatnonzero(close).tolist():
                        close[place] = distance_within(x.line, group[at[place]].line, int(most_of[place]))
                    at = at[~close]
                linked = at.tolist()
            else:
                linked = [j for j, b in zip(at.tolist(), bound.tolist()) if self._near(x, group[j], b)]
            if not linked:
                continue
            counts[i] += len(linked)
            counts[linked] += 1
            others, first = np.unique(top[linked], return_index=True)
            for other, place in zip(others.tolist(), first.tolist()):
                if other != top[i]:
                    edges.append((i, linked[place]))
                    top[top == other] = top[i]
        return counts.tolist(), edges

    @staticmethod
    def _codes(group: list[_Member], used: list[int]) -> tuple[dict[int, np.ndarray], np.ndarray]:
        """Words as numbers, a table for each length, and the row there of each line that is used."""
        known: dict[str, int] = {}
        tables: dict[int, list] = {}
        where = np.zeros(len(group), np.int64)
        for i in used:
            own = tables.setdefault(group[i].size, [])
            where[i] = len(own)
            own.append([known.setdefault(w, len(known)) for w in group[i].parts])
        return {n: np.array(rows, np.int32).reshape(len(rows), n) for n, rows in tables.items()}, where


def merged(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``top``, the first of each one's class, once those of ``a`` are joined with those of ``b``."""
    while len(a):
        low, high = np.minimum(top[a], top[b]), np.maximum(top[a], top[b])
        np.minimum.at(top, high, low)
        while (higher := top[top]).tobytes() != top.tobytes():
            top = higher
        left = top[a] != top[b]
        a, b = a[left], b[left]
    return top


#: Two lines of each pair and the edits allowed between them.
_PAIRS = tuple[np.ndarray, np.ndarray, np.ndarray]


class _Compared:
    """What a task finds in groups of words, as ``_Groups`` does, but by arrays over all groups of a batch.

    A pair is looked at by its numbers of words and sketches, then by keys, as it counts in the first group that it shares, then by
    words as numbers.
    """

    def __init__(self, threshold: Threshold, beside: Threshold | None):
        self.threshold, self.beside = threshold, beside

    def rows(self, members: pa.Table) -> pa.RecordBatch:
        """What is found in whole groups, whose ``members`` are together."""
        key, p, q, block, probe, h1, h2 = (members.column(i).to_numpy() for i in range(7))
        size, sketch = members.column(10).to_numpy().astype(np.int64), members.column(11).to_numpy().view(np.uint64)
        group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
        end = np.searchsorted(group, group, side="right")
        self._lines, self._size, self._letters = members.column(7), size, {}
        self._earlier_keys(key, group, members.column(8).combine_chunks(), members.column(9).combine_chunks())
        counts, top = np.zeros(len(key), np.int64), np.arange(len(key))
        for a, b in self._linked(self._new(self._near(size, sketch, probe, end, (p != q), block))):
            counts += np.bincount(a, minlength=len(key)) + np.bincount(b, minlength=len(key))
            top = merged(top, a, b)
        one, other = np.flatnonzero(counts), np.flatnonzero(top != np.arange(len(top)))
        nothing = pa.nulls(len(one), pa.int64())
        columns = [
            pa.array(np.r_[h1[one], h1[other]]),
            pa.array(np.r_[h2[one], h2[other]]),
            pa.array(np.r_[counts[one], np.zeros(len(other), np.int64)]),
            *(pa.concat_arrays([nothing, pa.array(h[top[other]])]) for h in (h1, h2)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _FOUND.split(", ")])

    def _earlier_keys(self, key: np.ndarray, group: np.ndarray, keys: pa.ListArray, indexed: pa.ListArray) -> None:
        """Of each member the keys before its group's that another of the group has as well, as numbers in order."""
        row, own = np.repeat(np.arange(len(key)), keys.value_lengths().to_numpy()), keys.flatten().to_numpy()
        of, those = np.repeat(np.arange(len(key)), indexed.value_lengths().to_numpy()), indexed.flatten().to_numpy()
        row, own = row[before := own < key[row]], own[before]
        of, those = of[before := those < key[of]], those[before]
        names, number = np.unique(np.r_[own, those], return_inverse=True)
        self._names = max(1, len(names))
        number, code = number[: len(own)], of * self._names + number[len(own) :]
        _, which, often = np.unique(group[row] * self._names + number, return_inverse=True, return_counts=True)
        found = np.sort((row * self._names + number)[often[which] > 1])
        self._earlier, self._in_index = found, np.isin(found, code)
        self._begin = np.searchsorted(found, np.arange(len(key) + 1) * self._names)

    def _met_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs share a group before this one."""
        many = self._begin[a + 1] - self._begin[a]
        pair = np.repeat(np.arange(len(a)), many)
        at = self._begin[a][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
        wanted = self._earlier[at] + (b - a)[pair] * self._names
        place = np.minimum(np.searchsorted(self._earlier, wanted), max(0, len(self._earlier) - 1))
        hit = (self._earlier[place] == wanted) & (self._in_index[at] | self._in_index[place])
        return np.bincount(pair[hit], minlength=len(a)) > 0

    def _near(self, size: np.ndarray, sketch: np.ndarray, probe: np.ndarray, end: np.ndarray, apart: np.ndarray, block: np.ndarray) -> Iterator[_PAIRS]:
        """Pairs, with the edits allowed, that numbers of words and sketches don't tell apart; each edit changes two bits at most."""
        x, step = np.arange(len(size)), 1
        while len(x := x[x + step < end[x]]):
            y = x + step
            most = np.maximum(size[x], size[y]) * self.threshold.percent // 100
            may = (np.bitwise_count(sketch[x] ^ sketch[y]) <= 2 * most) & (np.abs(size[x] - size[y]) <= most)
            may &= ~(probe[x] & probe[y]) & (~apart[x] | (block[x] != block[y]))
            yield x[may], y[may], most[may]
            step += 1

    def _new(self, pairs: Iterator[_PAIRS]) -> Iterator[_PAIRS]:
        for a, b, most in _together(pairs, PAIRS):
            new = ~self._met_before(a, b)
            yield a[new], b[new], most[new]

    def _linked(self, pairs: Iterator[_PAIRS]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b, most in _together(pairs, 8 * PAIRS):
            used, at = np.unique(np.r_[a, b], return_inverse=True)
            near = words_within(*coded(self._lines.take(pa.array(used))), at[: len(a)], at[len(a) :], most)
            a, b = a[near], b[near]
            if self.beside is not None:
                keep = [not self._beside(i, j) for i, j in zip(a.tolist(), b.tolist())]
                a, b = a[np.array(keep, bool)], b[np.array(keep, bool)]
            yield a, b

    def _of(self, i: int) -> tuple[str, int, int]:
        """(line, its characters, their sketch, or None where the line has no keys of characters)"""
        if (found := self._letters.get(i)) is None:
            line = self._lines[i].as_py()
            found = self._letters[i] = line, len(line), None if self._size[i] >= implied(len(line), self.beside) else _odd(line)
        return found

    def _beside(self, i: int, j: int) -> bool:
        (s, m, x), (t, n, y) = self._of(i), self._of(j)
        if x is None or y is None or abs(m - n) > (most := self.beside.of(max(m, n))):
            return False
        return (x ^ y).bit_count() <= 2 * most and distance_within(s, t, most)


def _together(pairs: Iterator[_PAIRS], most: int) -> Iterator[_PAIRS]:
    """About ``most`` pairs at once, or those that are left."""
    held, size = [], 0
    for some in pairs:
        held.append(some)
        size += len(some[0])
        if size >= most:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(c) for c in zip(*held))


def coded(lines: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the lines' words, one after another, that are equal where the words are; where each line begins, and the end."""
    words, sizes = [], []
    for _, _, data, offsets in text.chunks(lines):
        starts, ends, first = text.words(data, offsets, text.NONSPACE)
        at = np.r_[0, np.cumsum(ends - starts)]
        words.append(pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[text.NONSPACE[data]])]))
        sizes.append(np.diff(first))
    numbers = pa.chunked_array(words, pa.large_binary()).combine_chunks().dictionary_encode().indices
    return numbers.to_numpy(), np.r_[0, np.cumsum(np.concatenate(sizes))]


def words_within(words: np.ndarray, begin: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair of lines a and b, as ``coded`` has them, is ``most`` or less; their lengths differ by
    no more than that."""
    size = np.diff(begin)
    a, b = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
    out = np.zeros(len(a), bool)
    order = np.lexsort((size[a], most))
    at = 0
    while at < len(order):
        # Pairs of one threshold, as many as have about CELLS cells of bands of the longest of them.
        k = int(most[order[at]])
        stop = at + int(np.searchsorted(most[order[at : at + CELLS]], k, side="right"))
        cells = (size[a[order[at:stop]]] + 1) * (k + 1)
        stop = at + max(1, int(np.searchsorted(cells * np.arange(1, len(cells) + 1), CELLS, side="right")))
        some = order[at:stop]
        at = stop
        if cells[0] > CELLS:
            i, j = (tuple(words[begin[of] : begin[of + 1]].tolist()) for of in (a[some[0]], b[some[0]]))
            out[some] = distance_within(i, j, k)
            continue
        out[some] = _replaced(words, begin, a[some], b[some], k)
        left = some[~out[some]]
        if len(left):
            out[left] = _edited(words, begin, a[left], b[left], k)
    return out


def _laid(words: np.ndarray, begin: np.ndarray, of: np.ndarray, first: np.ndarray | int, size: int, none: int) -> np.ndarray:
    """A column of ``size`` words of each line, from its word ``first`` on; ``none`` outside of the line."""
    place = np.arange(size)[:, None] + first
    inside = (place >= 0) & (place < (begin[of + 1] - begin[of]))
    return np.where(inside, words[np.where(inside, begin[of] + place, 0)], np.int32(none))


def _replaced(words: np.ndarray, begin: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Whether lines have equally many words and ``k`` at most differ place by place."""
    m = begin[a + 1] - begin[a]
    same = np.flatnonzero(m == begin[b + 1] - begin[b])
    out = np.zeros(len(a), bool)
    if len(same):
        longest = int(m[same].max())
        out[same] = (_laid(words, begin, a[same], 0, longest, -1) != _laid(words, begin, b[same], 0, longest, -1)).sum(axis=0) <= k
    return out


def _edited(words: np.ndarray, begin: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Whether the edit distance of pairs is ``k`` or less, a the shorter one: the furthest word of a that e edits reach on each
    diagonal, for e from 0 to k, all pairs at once. No path of k edits leaves k + 1 diagonals."""
    m, n = begin[a + 1] - begin[a], begin[b + 1] - begin[b]
    low, longest = -((k - (n - m)) // 2), int(m.max())
    s, t = _laid(words, begin, a, 0, longest + 1, -1), _laid(words, begin, b, low, longest + 1 + k, -2)
    # The first word from each one on that differs; what is outside of a line differs.
    kind = np.int16 if longest < 1 << 15 else np.int32
    place = np.arange(longest + 1, dtype=kind)[:, None]
    differs = np.empty((longest + 1, k + 1, len(a)), kind)
    for d in range(k + 1):
        differs[:, d] = np.where(s == t[d : d + longest + 1], kind(longest), place)
    differs = np.minimum.accumulate(differs[::-1], axis=0)[::-1].reshape(-1)
    diagonal = np.arange(k + 1)[:, None]
    cap, goal, pair, width = np.minimum(m, n - diagonal - low), n - m - low, np.arange(len(a)), len(a)
    out, far = np.zeros(len(a), bool), np.full((k + 3, len(a)), -(1 << 40))
    own = far[1:-1]
    own[-low, pair] = 0
    for e in range(k + 1):
        if e:
            # A word of a replaced, one of a left out, one of b put in; where that is outside, the cell beside is as near.
            own[:] = np.minimum(np.maximum(np.maximum(own, far[2:]) + 1, far[:-2]), cap)
        slid = differs[(np.maximum(own, 0) * (k + 1) + diagonal) * width + pair]
        own[:] = np.where(own < 0, own, slid)
        done = own[goal, np.arange(len(pair))] >= m
        out[pair[done]] = True
        if 2 * np.count_nonzero(done) > len(done):
            far, cap, goal, m, pair = far[:, ~done], cap[:, ~done], goal[~done], m[~done], pair[~done]
            own = far[1:-1]
            if not len(pair):
                break
    return out


_FOUND = "a1 bigint, a2 bigint, n bigint, b1 bigint, b2 bigint"


def _verified(members: DataFrame, threshold: Threshold, words: bool = False, beside: Threshold | None = None) -> DataFrame:
    """What is found inside of groups of (key, p, q), whose members have all ``keys`` of their line and those that are ``indexed``:
    (a1, a2, n, null, null) a line with the number of its links, (a1, a2, 0, b1, b2) an edge between classes. For words members
    have their number ``n`` and ``sketch`` as well."""

    def lists(column: pa.Array) -> Iterator[list[int]]:
        values, at = column.flatten().to_numpy().tolist(), 0
        for size in column.value_lengths().to_numpy().tolist():
            yield values[at : at + size]
            at += size

    def of_words(batches):
        found, held = _Compared(threshold, beside), []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last group may go on in the next batch.
            columns = [batch.column(i).to_numpy() for i in range(3)]
            first = [held[-1].column(i)[-1].as_py() if held else None for i in range(3)]
            begins = np.flatnonzero(np.logical_or.reduce([np.r_[not held or c[0] != f, c[1:] != c[:-1]] for c, f in zip(columns, first)]))
            at = int(begins[-1]) if len(begins) else None
            if at is not None:
                if held or at:
                    yield found.rows(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held = []
            held.append(batch.slice(at or 0))
        if held:
            yield found.rows(pa.Table.from_batches(held))

    def run(batches):
        found = _Groups(threshold, words, beside)
        group: list[_Member] = []
        at = None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(8)]
            for key, p, q, block, probe, h1, h2, line, keys, indexed in zip(*columns, lists(batch.column(8)), lists(batch.column(9))):
                if at != (key, p, q):
                    if group:
                        found.add(at[0], at[1] != at[2], group)
                    at, group = (key, p, q), []
                group.append(_Member(block, probe, (h1, h2), line, keys, indexed, words))
            yield _found_batch(found)
        if group:
            found.add(at[0], at[1] != at[2], group)
        yield _found_batch(found)

    # Groups are together and in order in a partition; one has two blocks at most.
    sorted_ = members.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return sorted_.select("key", "p", "q", "block", "probe", "h1", "h2", "line", "keys", "indexed", *(["n", "sketch"] if words else [])).mapInArrow(task("lines", of_words if words else run), _FOUND)


def _found_batch(found: _Groups) -> pa.RecordBatch:
    columns = list(zip(*found.rows)) or [[]] * 5
    found.rows = []
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in _FOUND.split(", ")])


def _known(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(h1, h2, line, keys, indexed) of the lines of groups (key, probe, h1, h2)."""
    keys = members.groupBy("h1", "h2").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(~F.col("probe"), F.col("key"))).alias("indexed"))
    return texts.join(keys, ["h1", "h2"])


def _links(documents: DataFrame, firsts: DataFrame, threshold: Threshold, group: int, candidates: DataFrame | None = None) -> DataFrame:
    """What ``_verified`` finds of all pairs of different lines within the threshold of characters, but for those of lines whose
    partners are found by words; stored. ``firsts``: a place of each line; ``candidates``: what ``_candidates`` finds, if that is known."""
    rows, shared = None, None
    if candidates is not None:
        members = candidates.filter(F.col("kind") == _CHARACTERS)
    else:
        rows = stored(_key_rows(documents, threshold), "keys")
        shared = stored(_shared(rows), "shared")
        members = _of(rows, shared)
    met = members.groupBy("key", "h1", "h2").agg(F.min("probe").alias("probe"))
    met = stored(met.select("key", "probe", "h1", "h2"), "members")
    discard(rows, shared)
    places = firsts.join(met.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    places = stored(places.groupBy("doc_id").agg(F.collect_set("line_no").alias("numbers")), "places")
    texts = stored(_texts(documents, places), "lines")
    discard(places)
    made = [met, texts]

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(stored(df, name))
        return made[-1]

    members = met.withColumn("left", F.lit(None).cast(_LEFT.split(" ", 1)[1]))
    ready = []

    def sized(rows: DataFrame, name: str) -> DataFrame:
        return keep(_sizes(rows, texts, group), name)

    while True:
        # Small groups are ready; large ones are cut again for as long as there is something to cut.
        sizes = sized(members, "sizes")
        ready.append(members.join(sizes.filter(F.col("n") <= group), "key").select("key", "probe", "h1", "h2", "blocks"))
        large = sizes.filter(F.col("n") > group).select("key")
        if large.isEmpty():
            break
        hot = members.join(large, "key", "left_semi").join(texts, ["h1", "h2"])
        cut = keep(_cut_again(hot, threshold), "cut")
        whole = cut.filter("key is null").select(F.col("old").alias("key"), "probe", "h1", "h2").distinct()
        ready.append(whole.join(sized(whole, "whole"), "key").select("key", "probe", "h1", "h2", "blocks"))
        new = cut.filter("key is not null").drop("old")
        members = keep(_of(new, keep(_shared(new), "shared")).select("key", "probe", "h1", "h2", "left").distinct(), "members")
    all_ready = ready[0]
    for more in ready[1:]:
        all_ready = all_ready.unionAll(more)
    all_ready = keep(all_ready.groupBy("key", "h1", "h2").agg(F.min("probe").alias("probe"), F.max("blocks").alias("blocks")), "ready")
    known = keep(_known(all_ready, texts), "known")
    links = stored(_verified(_dealt(all_ready).join(known, ["h1", "h2"]), threshold), "found")
    discard(*made)
    return links


def _sizes(rows: DataFrame, texts: DataFrame, group: int) -> DataFrame:
    """(key, n, blocks), to be a table, a row per key, so that a join with a large group can be split."""
    weights = texts.select("h1", "h2", F.octet_length("line").alias("bytes"))
    of = rows.join(weights, ["h1", "h2"]).groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return of.select("key", "n", F.greatest(F.ceil(F.col("n") / group), F.ceil(F.col("bytes") / BYTES)).cast("int").alias("blocks"))


def _dealt(ready: DataFrame, *more: str) -> DataFrame:
    """(key, p, q, block, probe, h1, h2) and ``more``, members of groups (with blocks) once for each pair of blocks that theirs is in."""
    dealt = ready.withColumn("block", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "probe", "h1", "h2", *more)


@lru_cache(maxsize=1 << 12)
def word_edits(n: int, threshold: Threshold) -> int:
    """Word edits between a line of ``n`` words and any partner, at most."""
    return max(threshold.of_probes(n), default=0)


def ranks_of(words: np.ndarray, grams: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A number of 52 bits of each gram that is the same wherever it occurs, by about how common it is and then by its hash;
    ``common`` has how often words and grams are in a sample, by the first bits of their hashes. (All of this is exact in doubles:
    machines may not differ.)"""
    place = np.uint64(64 - COMMON_BITS)
    by_words, known = np.ones(len(grams)), common[words >> place]
    for i in range(len(words) - len(grams) + 1):
        by_words *= known[i : i + len(grams)]
    part, power = np.frexp(np.maximum(by_words, (common[grams >> place] - 1) * common.sum()))
    level = power.astype(np.uint64) * np.uint64(16) + ((part - 0.5) * 32).astype(np.uint64)
    return np.minimum(level, np.uint64(1023)) << np.uint64(42) | grams & np.uint64((1 << 42) - 1)


def _common_of(documents: DataFrame, share: float, size: int) -> list[tuple[int, int]]:
    """(place, how often) of the words and grams that are common in the lines of about a ``share`` of the documents."""

    def run(batches):
        for found in _batches_of_lines(batches):
            made = []
            for _, _, data, offsets in text.chunks(pa.array([line for line, _ in found], pa.large_string())):
                words = text.hashes(data, *text.words(data, offsets, text.NONSPACE)[:2])
                made += [words, text.grams(words, size)] if size > 1 else [words]
            hashes, counts = np.unique(np.concatenate(made or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))], names=["h", "n"])

    some = documents.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    of = some.mapInArrow(task("lines", run), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 2")
    rows = of.orderBy(F.desc("n"), "h").limit(COMMON).collect()
    return [((r.h & _MASK) >> 64 - COMMON_BITS, r.n) for r in rows]


def rarest(ranks: np.ndarray, at: np.ndarray, line: np.ndarray, need: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, probe) of the grams that stand for each line: the least by rank, until so many of them as the line needs are apart.

    ``at`` is the first word of each gram of ``size`` words, ``line`` its line, in order. Those that overlap one that was taken
    are probes; if a line has too few apart, all of its grams stand for it and none is a probe.
    """
    # Lines are LINES at most, so that one number has the line and the rank.
    order = np.argsort(line.astype(np.uint64) << np.uint64(52) | ranks)
    begin, end = (np.searchsorted(line, np.arange(len(need)), side=side) for side in ("left", "right"))
    taken, apart = np.zeros(int(at.max(initial=0)) + size, bool), np.zeros(len(need), np.int64)
    state = np.zeros(len(order), np.int8)  # 1: taken, 2: a probe
    active, step = np.flatnonzero((need > 0) & (end > begin)), 0
    while len(active):
        place = begin[active] + step
        word = at[order[place]]
        free = ~taken[word]
        for i in range(1, size):
            free &= ~taken[word + i]
        for i in range(size):
            taken[word[free] + i] = True
        state[place] = np.where(free, 1, 2)
        apart[active] += free
        step += 1
        more, left = apart[active] < need[active], begin[active] + step < end[active]
        for i in active[more & ~left]:
            state[begin[i] : end[i]] = 1
        active = active[more & left]
    found = np.flatnonzero(state)
    return order[found], state[found] == 2


_SKETCH = "n int, sketch bigint"


def _table_of(counted: list[tuple[int, int]]) -> np.ndarray:
    common = np.ones(1 << COMMON_BITS)
    places, counts = np.array(counted, np.int64).reshape(-1, 2).T
    np.maximum.at(common, places, counts)
    return common


def _grams(found: list[tuple[str, tuple[int, int]]], threshold: Threshold, size: int, common: np.ndarray) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
    """(first line, numbers of words, (key, probe, line, its number of words, its sketch) of the rarest grams) of runs of lines.
    A sketch tells of each of 64 classes of words whether the line has an odd number of them."""
    for a, b, data, offsets in text.chunks(pa.array([line for line, _ in found], pa.large_string())):
        starts, ends, first = text.words(data, offsets, text.NONSPACE)
        words, counts = text.hashes(data, starts, ends), np.diff(first)
        lengths, which = np.unique(counts, return_inverse=True)
        need = np.array([t + 1 if (t := word_edits(n, threshold)) else 0 for n in lengths.tolist()])[which]
        line, at = np.repeat(np.arange(b - a), counts), np.arange(len(words))
        grams = text.grams(words, size)
        whole = np.flatnonzero((need[line] > 0) & (at + size <= first[line + 1]))
        ranks = ranks_of(words, grams, common)[whole]
        places, probe = rarest(ranks, at[whole], line[whole], need, size)
        sketch = np.zeros(b - a, np.uint64)
        np.bitwise_xor.at(sketch, line, np.uint64(1) << (words >> np.uint64(58)))
        of = line[whole][places]
        yield a, counts, (ranks[places].astype(np.int64), probe, a + of, counts[of].astype(np.int32), sketch[of].view(np.int64))


def _gram_rows(documents: DataFrame, threshold: Threshold, size: int, counted: list[tuple[int, int]]) -> DataFrame:
    """(key, probe, h1, h2, n, sketch): the rarest grams of the lines, their number of words and their sketch."""

    def run(batches):
        common = _table_of(counted)
        for found in _batches_of_lines(batches):
            identities = np.array([h for _, h in found], np.int64).reshape(-1, 2)
            for _, _, (key, probe, line, n, sketch) in _grams(found, threshold, size, common):
                columns = (key, probe, identities[line, 0], identities[line, 1], n, sketch)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "probe", "h1", "h2", "n", "sketch"])

    return documents.mapInArrow(task("lines", run), f"{_MEMBER}, {_SKETCH}")


def _records(key, probe, h: np.ndarray, n=0, sketch=0) -> np.ndarray:
    out = np.empty(len(h), _RECORD)
    for name, values in zip(_RECORD.names, (key, h[:, 0], h[:, 1], sketch, n, probe)):
        out[name] = values
    return out


def _bucketed(records: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, end of its records) of the buckets in use, and ``records`` in their order."""
    bucket = (text.mix(records["key"].view(np.uint64)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order].astype(np.int64)
    ends = np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], True]) + 1
    return bucket[ends - 1], ends, records[order]


def _packed_rows(documents: DataFrame, threshold: Threshold, beside: Threshold, size: int, counted: list[tuple[int, int]], buckets: int) -> DataFrame:
    """(bucket, records): the rarest grams of the lines, and below 0 their keys of characters, as ``_key_rows`` has them. What
    moves is an array of records for each bucket, as nearly all keys are of one line only and a row for each is mostly overhead."""
    digest = xxhash.xxh3_64_intdigest

    def characters(found: list, begin: int, counts: list[int], identities: np.ndarray) -> np.ndarray:
        keys, probes, sizes = [], [], []
        for (line, _), words in zip(found[begin : begin + len(counts)], counts):
            own, probe = ((), ()) if words >= implied(len(line), beside) else plan(len(line), beside)
            sizes.append(len(own))
            keys += [digest(line[a:b], seed) for seed, a, b in own]
            probes += probe
        return _records(np.array(keys, np.uint64).view(np.int64), probes, np.repeat(identities[begin : begin + len(counts)], sizes, axis=0))

    def packed(grams: list[np.ndarray], others: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for records, of in ((grams, lambda b: b), (others, lambda b: -1 - b)):
            every = np.concatenate([np.empty(0, _RECORD), *records])
            if len(every):
                bucket, ends, made = _bucketed(every, buckets)
                offsets = np.r_[0, ends].astype(np.int32) * np.int32(_RECORD.itemsize)
                column = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(made.view(np.uint8))])
                yield pa.RecordBatch.from_arrays([pa.array(of(bucket).astype(np.int32)), column], names=["bucket", "records"])

    def run(batches):
        common = _table_of(counted)
        grams, others, held = [], [], 0
        for found in _batches_of_lines(batches):
            identities = np.array([h for _, h in found], np.int64).reshape(-1, 2)
            for begin, counts, (key, probe, line, n, sketch) in _grams(found, threshold, size, common):
                grams.append(_records(key, probe, identities[line], n, sketch))
                others.append(characters(found, begin, counts.tolist(), identities))
                held += len(grams[-1]) + len(others[-1])
            if held >= PACK:
                yield from packed(grams, others)
                grams, others, held = [], [], 0
        yield from packed(grams, others)

    return documents.mapInArrow(task("lines", run), "bucket int, records binary")


def _shared_records(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records of keys of two lines or more, one of them indexed, each line once for a key, in the order of keys; the numbers of
    lines of the keys."""
    none = np.empty(0, _RECORD), np.zeros(0, np.int64)
    order = np.argsort(records["key"])
    key = records["key"][order]
    same = key[1:] == key[:-1]
    found = records[order[np.r_[False, same] | np.r_[same, False]]] if len(key) else records
    if not len(found):
        return none
    found = found[np.lexsort((found["probe"], found["h2"], found["h1"], found["key"]))]
    key, h1, h2 = found["key"], found["h1"], found["h2"]
    found = found[np.r_[True, (key[1:] != key[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]]
    starts = np.flatnonzero(np.r_[True, found["key"][1:] != found["key"][:-1]])
    sizes = np.diff(np.r_[starts, len(found)])
    able = (sizes > 1) & ~np.logical_and.reduceat(found["probe"], starts)
    return found[np.repeat(able, sizes)], sizes[able]


def _joined(records: np.ndarray, sizes: np.ndarray, threshold: Threshold) -> np.ndarray:
    """For each record of groups of ``sizes`` the first that it is joined with by lines whose sketches are as near as edits allow."""
    end = np.repeat(np.cumsum(sizes), sizes)
    top, x, step = np.arange(len(records)), np.arange(len(records)), 1
    bits, n, probe = np.ascontiguousarray(records["sketch"]).view(np.uint64), records["n"].astype(np.int64), np.ascontiguousarray(records["probe"])
    while len(x := x[x + step < end[x]]):
        apart = x[top[x] != top[x + step]]
        y = apart + step
        most = np.maximum(n[apart], n[y]) * threshold.percent // 100
        hit = (np.bitwise_count(bits[apart] ^ bits[y]) <= 2 * most) & (np.abs(n[apart] - n[y]) <= most) & ~(probe[apart] & probe[y])
        top = merged(top, apart[hit], y[hit])
        step += 1
    return top


def _joint(records: np.ndarray, sizes: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Records of lines that are joined with others of their group, with a key that tells which lines these are: lines that meet
    in many groups, as near copies do in all that they have in common, need be compared in one only. Keys of two sets that
    were the same by chance would do no harm, as those were one group."""
    top = _joined(records, sizes, threshold)
    lines = np.bincount(top, minlength=len(records))[top] if len(records) else top
    records, top = records[lines > 1].copy(), top[lines > 1]
    line = text.mix(text.mix(np.ascontiguousarray(records["h1"]).view(np.uint64)) + np.ascontiguousarray(records["h2"]).view(np.uint64))
    if len(records):
        tops, which = np.unique(top, return_inverse=True)
        sums = np.zeros(len(tops), np.uint64)
        np.add.at(sums, which, line)
        records["key"] = text.mix(sums)[which].view(np.int64)
        records["probe"] = False
    return records


#: What becomes of a key: one of characters, lines to be compared, or a group too large to be looked at here.
_CHARACTERS, _JOINT, _LARGE = range(3)


def _met(packed: DataFrame, threshold: Threshold, block: int = BLOCK, bucket_of: int = 8 * BUCKET) -> DataFrame:
    """(kind, key, probe, h1, h2, n, sketch) of keys of two lines or more, one of them indexed. What isn't of characters is left
    out where no other line of the group has a sketch as near as edits allow; a line may be there twice in what is ``_LARGE``: groups
    of more than ``block`` lines, which go on at once where a bucket has more than ``bucket_of`` records."""

    def rows(kind: int, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(records):
            columns = [np.full(len(records), kind, np.int32), *(np.ascontiguousarray(records[c]) for c in ("key", "probe", "h1", "h2", "n", "sketch"))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "key", "probe", "h1", "h2", "n", "sketch"])

    def ended(bucket: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, sizes = _shared_records(np.concatenate(held))
        if bucket < 0:
            yield from rows(_CHARACTERS, found)
            return
        large = sizes > block
        yield from rows(_LARGE, found[np.repeat(large, sizes)])
        yield from rows(_JOINT, _joint(found[np.repeat(~large, sizes)], sizes[~large], threshold))

    def run(batches):
        at, held, size, most, hot = None, [], 0, 0, np.zeros(0, np.int64)
        for batch in batches:
            for bucket, records in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != at:
                    if held:
                        yield from ended(at, held)
                    at, held, size, most, hot = bucket, [], 0, bucket_of, np.zeros(0, np.int64)
                own = np.frombuffer(records.as_buffer(), _RECORD).copy()
                if len(hot):
                    gone = np.isin(own["key"], hot)
                    yield from rows(_CHARACTERS if at < 0 else _LARGE, own[gone])
                    own = own[~gone]
                held.append(own)
                size += len(own)
                if size > most:
                    # Keys of very many lines go on as they come; the others of a bucket are few.
                    every = np.concatenate(held)
                    keys, counts = np.unique(every["key"], return_counts=True)
                    hot = np.union1d(hot, keys[counts > block])
                    gone = np.isin(every["key"], hot)
                    yield from rows(_CHARACTERS if at < 0 else _LARGE, every[gone])
                    held = [every[~gone]]
                    size = len(held[0])
                    most = max(most, 2 * size)
        if held:
            yield from ended(at, held)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(task("lines", run), f"kind int, {_MEMBER}, {_SKETCH}")


def _candidates(documents: DataFrame, firsts: DataFrame, threshold: Threshold, beside: Threshold) -> DataFrame:
    """What ``_met`` finds, by words and by characters; stored."""
    size, count = min(GRAM, run_words(threshold)), max(1, firsts.count())
    common = _common_of(documents, min(1.0, SAMPLE / count), size)
    buckets = -(-count * 12 // BUCKET)
    return stored(_met(_packed_rows(documents, threshold, beside, size, common, buckets), threshold), "met")


def _possible(members: DataFrame, threshold: Threshold) -> DataFrame:
    """Of members (key, p, q, block, probe, h1, h2, n, sketch), those with a partner in their group whose sketch is as near as
    edits allow: each changes two bits at most."""
    names = ["key", "p", "q", "block", "probe", "h1", "h2"]

    def kept(rows: pa.Table) -> pa.RecordBatch:
        key, p, q, block, probe, h1, h2, n, sketch = (rows.column(i).to_numpy() for i in range(9))
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]) if len(key) else np.zeros(0, np.int64)
        end = np.repeat(np.r_[starts[1:], len(key)], np.diff(np.r_[starts, len(key)])) if len(key) else starts
        near, x, step = np.zeros(len(key), bool), np.arange(len(key)), 1
        bits = sketch.view(np.uint64)
        while len(x := x[x + step < end[x]]):
            y = x + step
            most = np.maximum(n[x], n[y]).astype(np.int64) * threshold.percent // 100
            hit = (np.bitwise_count(bits[x] ^ bits[y]) <= 2 * most) & (np.abs(n[x] - n[y]) <= most) & ~(probe[x] & probe[y]) & ((p[x] == q[x]) | (block[x] != block[y]))
            near[x[hit]] = near[y[hit]] = True
            step += 1
        return rows.filter(pa.array(near)).combine_chunks()

    def run(batches):
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
            if not len(rows):
                continue
            # The last group may go on in the next batch.
            last = [rows.column(i).to_numpy() for i in range(3)]
            other = np.flatnonzero((last[0] != last[0][-1]) | (last[1] != last[1][-1]) | (last[2] != last[2][-1]))
            at = int(other[-1]) + 1 if len(other) else 0
            rest = rows.slice(at)
            yield from kept(rows.slice(0, at).combine_chunks()).to_batches()
        if rest is not None:
            yield from kept(rest.combine_chunks()).to_batches()

    sorted_ = members.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return sorted_.select(*names, "n", "sketch").mapInArrow(task("lines", run), f"key bigint, p int, q int, block int, probe boolean, {_TWO}, {_SKETCH}")


def _word_links(documents: DataFrame, firsts: DataFrame, threshold: Threshold, beside: Threshold, met: DataFrame | None = None) -> DataFrame:
    """What ``_verified`` finds of all pairs of different lines whose words are within the threshold, but for those that ``_links``
    finds with ``beside``; stored. ``firsts``: a place of each line; ``met``: what ``_candidates`` finds, if that is known."""
    own = [] if met is not None else [met := _candidates(documents, firsts, threshold, beside)]
    no = F.lit(0)
    possible = met.filter(F.col("kind") == _JOINT).select("key", no.alias("p"), no.alias("q"), no.alias("block"), "probe", "h1", "h2", "n", "sketch").distinct()
    large = met.filter(F.col("kind") == _LARGE)
    if not large.isEmpty():
        large = stored(large.groupBy("key", "h1", "h2").agg(F.min("probe").alias("probe"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "members")
        blocks = large.groupBy("key").agg(F.count("*").alias("of")).select("key", F.ceil(F.col("of") / BLOCK).cast("int").alias("blocks"))
        blocks = stored(blocks, "sizes")
        own += [large, blocks]
        possible = possible.unionAll(_possible(_dealt(large.join(blocks, "key"), "n", "sketch"), threshold))
    possible = stored(possible, "possible")
    discard(*own)
    places = firsts.join(possible.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    places = stored(places.groupBy("doc_id").agg(F.collect_set("line_no").alias("numbers")), "places")
    texts = stored(_texts(documents, places), "lines")
    discard(places)
    known = stored(_known(possible, texts), "known")
    discard(texts)
    links = stored(_verified(possible.join(known, ["h1", "h2"]), threshold, True, beside), "found")
    discard(possible, known)
    return links


def _name(h1: str, h2: str):
    return F.concat(F.hex(h1), F.lit("-"), F.hex(h2))


def near_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Threshold = Threshold(), group: int = GROUP) -> DataFrame:
    """A row per line that takes part: doc_id, line_no, h1, h2, class_doc_id, class_line_no (the first of its class),
    n_copies (of equal lines), n_links (other lines within the threshold) and kept.

    A group of candidates of more than ``group`` lines is cut again before its lines are compared.
    """
    return _near_lines(documents, id_col, text_col, threshold, group)[0]


def _near_lines(documents: DataFrame, id_col: str, text_col: str, threshold: Threshold, group: int) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of ``near_lines``, and the stored tables that they are read from."""
    bounded_batches(documents.sparkSession)
    slim = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    lines = stored(_each_line(slim), "each")
    firsts = stored(lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n_copies")), "firsts")
    places = firsts.select("h1", "h2", "first.*")
    if threshold.words:
        met = _candidates(slim, places, threshold.of_words(), threshold)
        found = [_links(slim, places, threshold, group, met), _word_links(slim, places, threshold.of_words(), threshold, met)]
        discard(met)
    else:
        found = [_links(slim, places, threshold, group)]
    links = found[0].unionAll(found[1]) if len(found) > 1 else found[0]
    counts = stored(links.filter("n > 0").groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2")).agg(F.sum("n").alias("n_links")), "counts")
    # Half a hash is a node's name where no two linked lines have it in common; numbers are summed up without being sorted.
    every, halves = counts.agg(F.count("*"), F.count_distinct("h1")).first()
    name = _name if every != halves else lambda h1, _: F.col(h1)
    classes = components(links.filter("b1 IS NOT NULL").select(name("a1", "a2").alias("a"), name("b1", "b2").alias("b")))
    some = among(firsts, "h1", counts.select("h1")).filter("_maybe").select("h1", "h2", "first")
    linked = counts.withColumn("node", name("h1", "h2")).join(classes, "node").join(some, ["h1", "h2"])
    tops = linked.groupBy("component").agg(F.min("first").alias("top"))
    placed = stored(linked.join(tops, "component").select("h1", "h2", "top", "n_links"), "placed")
    marked = among(firsts, "h1", placed.select("h1"))
    alone = marked.filter("not _maybe").withColumns({"top": F.col("first"), "n_links": F.lit(0).cast("bigint")})
    known = marked.filter("_maybe").join(placed, ["h1", "h2"], "left").withColumns({"top": F.coalesce("top", "first"), "n_links": F.coalesce("n_links", F.lit(0)).cast("bigint")})
    # A table, so that the join of a very common line, one row on the right, can be split.
    columns = ["h1", "h2", "n_copies", "top", "n_links"]
    known = stored(known.select(*columns).unionAll(alone.select(*columns)), "known")
    discard(firsts, classes, counts, placed, *found)
    out = lines.join(known, ["h1", "h2"]).select(
        "doc_id",
        "line_no",
        "h1",
        "h2",
        F.col("top.doc_id").alias("class_doc_id"),
        F.col("top.line_no").alias("class_line_no"),
        "n_copies",
        "n_links",
        (F.struct("doc_id", "line_no") == F.col("top")).alias("kept"),
    )
    return out, [lines, known]


def deduplicate(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Threshold = Threshold(), group: int = GROUP) -> DataFrame:
    """``documents`` without the lines that are not the first of their class; a document that loses all its lines goes."""
    found, tables = _near_lines(documents, id_col, text_col, threshold, group)
    gone = found.filter("not kept").groupBy(F.col("doc_id").alias("_gone_id")).agg(F.collect_list(F.struct("line_no", "h1", "h2")).alias("_gone"))
    gone = stored(gone, "gone")
    discard(*tables)
    placed, (id_at, text_at), columns = aside(documents, id_col, text_col)
    marked = among(placed, id_at, gone.select("_gone_id"))
    joined = marked.filter("_maybe").drop("_maybe").join(gone, F.col(id_at).cast("bigint") == F.col("_gone_id"), "left").drop("_gone_id")
    arrow = arrow_schema(joined.schema)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_at)
            values, marked = batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index("_gone")).to_pylist()
            kept = []
            for row, (value, numbers) in enumerate(zip(values, marked)):
                if numbers:
                    left = without(value or "", {x["line_no"]: (x["h1"], x["h2"]) for x in numbers})
                    if not left.strip():
                        continue
                    values[row] = left
                kept.append(row)
            made = list(batch.columns)
            made[at] = pa.array(values, made[at].type)
            whole = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, arrow)], schema=arrow)
            yield whole.take(pa.array(kept, pa.int64()))

    changed = joined.mapInArrow(task("lines", run), joined.schema).select(*columns)
    return marked.filter("not _maybe").drop("_maybe").unionAll(changed).toDF(*documents.columns)


def without(value: str, numbers: dict[int, tuple[int, int]]) -> str:
    """``value`` less the numbered lines whose hashes are those given."""
    return "\n".join(line for i, line in enumerate(value.split("\n")) if i not in numbers or identity(line.strip()) != numbers[i])


def brute_force(rows: list[tuple[int, str | None]], threshold: Threshold = Threshold()) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """(class id, class line, copies, links) of each line that takes part, by comparing all pairs by the textbook table, for tests."""
    places: dict[str, list] = {}
    for i, value in rows:
        for n, line in _lines(value) if i is not None else ():
            places.setdefault(line, []).append((i, n))
    distinct = list(places)
    bags = {s: Counter(s) for s in distinct}

    def linked(s: str, t: str) -> bool:
        if threshold.words and s != t:
            x, y = words_of(s), words_of(t)
            most = threshold.of_words().of(max(len(x), len(y)))
            if most and abs(len(x) - len(y)) <= most and distance(x, y) <= most:
                return True
        most = threshold.of(max(len(s), len(t)))
        # Characters that only one of them has are edits in any case.
        return s != t and max((bags[s] - bags[t]).total(), (bags[t] - bags[s]).total()) <= most and distance(s, t) <= most

    near = {s: [t for t in distinct if linked(s, t)] for s in distinct}
    out = {}
    for s in distinct:
        group, todo = {s}, [s]
        while todo:
            for t in near[todo.pop()]:
                if t not in group:
                    group.add(t)
                    todo.append(t)
        top = min(p for t in group for p in places[t])
        for p in places[s]:
            out[p] = (*top, len(places[s]), len(near[s]))
    return out


def distance(s: str | tuple, t: str | tuple) -> int:
    """The edit distance by the textbook table, for tests."""
    row = list(range(len(t) + 1))
    for i, c in enumerate(s, 1):
        old, row[0] = row[0], i
        for j, d in enumerate(t, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (c != d))
    return row[-1]
