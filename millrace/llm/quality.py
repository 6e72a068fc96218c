"""Quality classifier: a sparse ensemble of rules over statistics of whole texts, compiled into Spark columns.

Statistics of each text (shares of kinds of characters, word lengths, repeated and distinct words) are made in batches of
arrays. Shallow trees are boosted on the labelled rows of a bounded sample; every path from a root to a node is a rule, a
conjunction of comparisons. A logistic model with a lasso penalty weights the rules and leaves most at zero. What
remains is compiled into one column expression, so that scoring is inside whole-stage code generation.

Labels are learned only from rows that ``held_out`` does not set aside, and at most about ``SAMPLE`` of them, taken by a hash
of their id (the bound is a parameter). Labels, languages, sources and ids are no inputs of a score.

Defined cases: a null or empty text has statistics of zero and is scored by the same rules; a null id is not held out and
has no label; labels that are null, or name no document, teach nothing; a label row counts once for each row it meets;
without labels of both kinds there are no rules, each score is the smoothed share (positives + 1) / (labels + 2), and
``keep`` keeps all; repeated rows get equal scores; other columns are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import _text as text
from millrace.llm._work import arrow_schema, aside, bounded_batches, task, widen

SAMPLE = 20_000
THRESHOLD = 0.7
TREES, DEPTH, ROWS, BINS, LEAST = 40, 3, 4000, 32, 20
PENALTY = 0.001

FEATURES = ("size", "n_words", "letters", "upper", "digits", "marks", "symbols", "spaces", "lines", "word_length", "repeated", "distinct")
_PREFIX = "_quality_"

_TABLES = {name: np.zeros(256, dtype=np.uint8) for name in ("letters", "upper", "digits", "marks", "symbols", "spaces", "lines")}
_TABLES["letters"][0x41:0x5B] = _TABLES["letters"][0x61:0x7B] = _TABLES["letters"][0x80:] = 1
_TABLES["upper"][0x41:0x5B] = 1
_TABLES["digits"][0x30:0x3A] = 1
_TABLES["marks"][list(b".,;:?'\"-()")] = 1
_TABLES["symbols"][list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 1
_TABLES["spaces"][list(b" \t\n\r\x0b\x0c")] = 1
_TABLES["lines"][0x0A] = 1


def statistics(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(column), len(FEATURES)))
    for a, b, data, offsets in text.chunks(column):
        size = np.diff(offsets)
        per = 1 / np.maximum(size, 1)
        row = {"size": size.astype(float)}
        if len(data):
            ends = np.concatenate([[0], offsets[1:]])
            for name, table in _TABLES.items():
                row[name] = np.diff(np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])[ends]) * per
            starts, stops, first = text.words(data, offsets, text.NONSPACE)
            h = text.hashes(text.LOWER[data], starts, stops)
            n = np.diff(first)
            each = 1 / np.maximum(n, 1)
            row["n_words"] = n.astype(float)
            row["word_length"] = np.diff(np.concatenate([[0], np.cumsum(stops - starts)])[first]) * each
            document = np.repeat(np.arange(len(n), dtype=np.uint64), n)
            same = np.concatenate([[False], (h[1:] == h[:-1]) & (document[1:] == document[:-1])]) if len(h) else np.zeros(0, bool)
            row["repeated"] = np.diff(np.concatenate([[0], np.cumsum(same)])[first]) * each
            keys = (document << np.uint64(44)) | (h >> np.uint64(20))
            keys.sort()
            new = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
            row["distinct"] = np.bincount((new >> np.uint64(44)).astype(np.int64), minlength=len(n)) * each
        for k, name in enumerate(FEATURES):
            out[a:b, k] = row.get(name, 0)
    return out


def with_statistics(documents: DataFrame, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """``documents`` and a column of each statistic; without the text if ``drop_text``."""
    bounded_batches(documents.sparkSession)
    kept = [f for f in documents.schema if not (drop_text and f.name == text_col)]
    base = type(documents.schema)(kept)
    schema = widen(base, ", ".join(f"{_PREFIX}{f} double" for f in FEATURES))
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            made = statistics(batch.column(batch.schema.get_field_index(text_col)))
            columns = {f"{_PREFIX}{f}": pa.array(made[:, k]) for k, f in enumerate(FEATURES)}
            yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in arrow], schema=arrow)

    return documents.mapInArrow(task("quality", run), schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction: (place in FEATURES, whether above, threshold) each."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for k, above, limit in self.terms:
            out &= (x[:, k] > limit) == above
        return out

    def column(self) -> Column:
        parts = [(F.col(_PREFIX + FEATURES[k]) > limit) if above else (F.col(_PREFIX + FEATURES[k]) <= limit) for k, above, limit in self.terms]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out


@dataclass(frozen=True)
class Model:
    base: float
    weighted: tuple[tuple[float, Rule], ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for w, rule in self.weighted:
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score, from 0 to 1, over the columns of ``with_statistics``."""
        z = F.lit(self.base)
        for w, rule in self.weighted:
            z = z + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(binned: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, columns: np.ndarray, rows: np.ndarray, terms: tuple, depth: int, update: np.ndarray, rules: set) -> None:
    """Split ``rows`` where it lowers the squared error most; each node below the root is a rule."""
    if terms:
        rules.add(Rule(tuple(sorted(terms))))
    best = (1e-9, None, None)
    y = target[rows]
    total, n = y.sum(), len(rows)
    if depth and n >= 2 * LEAST:
        for k in columns.tolist():
            bins = binned[rows, k]
            left_n = np.cumsum(np.bincount(bins, minlength=BINS + 1))[:-1]
            left = np.cumsum(np.bincount(bins, weights=y, minlength=BINS + 1))[:-1]
            ok = (left_n >= LEAST) & (n - left_n >= LEAST)
            gain = np.where(ok, left**2 / np.maximum(left_n, 1) + (total - left) ** 2 / np.maximum(n - left_n, 1) - total**2 / n, 0)
            if gain.max(initial=0) > best[0]:
                best = (float(gain.max()), k, int(gain.argmax()))
    _, k, cut = best
    if k is None:
        update[rows] = y.mean()
        return
    below = binned[rows, k] <= cut
    limit = float(cuts[k][cut])
    for part, above in ((rows[below], False), (rows[~below], True)):
        _grow(binned, cuts, target, columns, part, (*terms, (k, above, limit)), depth - 1, update, rules)


def rules_of_trees(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """Paths of boosted shallow trees, each grown on part of the rows and columns."""
    rng = np.random.default_rng(seed)
    cuts = []
    for k in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        cuts.append(np.concatenate([values, np.full(BINS - len(values), np.inf)]))
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    score, rules = np.zeros(len(y)), set()
    for _ in range(TREES):
        rows = rng.choice(len(y), min(ROWS, len(y)), replace=False)
        columns = rng.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False)
        residual = y - 1 / (1 + np.exp(-score))
        update = np.zeros(len(y))
        grown: set[Rule] = set()
        _grow(binned, cuts, residual, columns, rows, (), DEPTH, update, grown)
        score += 2 * update
        rules |= grown
    rules = {r for r in rules if all(np.isfinite(t[2]) for t in r.terms)}
    return sorted(rules, key=lambda r: r.terms)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Lasso logistic weights of the trees' rules, by accelerated proximal steps."""
    n, ones = len(y), float(y.sum()) if len(y) else 0.0
    share = (ones + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    if n < 2 * LEAST or ones in (0.0, float(n)):
        return Model(base, ())
    rules = rules_of_trees(x, y)
    if not rules:
        return Model(base, ())
    held = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float32)
    _, first = np.unique(held, axis=1, return_index=True)  # rules that hold for the same rows are one
    first = np.sort(first)
    rules, held = [rules[i] for i in first], held[:, first]
    mean = held.mean(axis=0)
    held = held - mean
    step = 4 * n / float(np.linalg.eigvalsh((held.T @ held).astype(np.float64))[-1] + n)
    w = v = np.zeros(held.shape[1], dtype=np.float64)
    b = c = base
    t = 1.0
    for _ in range(400):
        error = 1 / (1 + np.exp(-(held @ v.astype(np.float32) + c))) - y
        moved = v - step * (held.T @ error.astype(np.float32)) / n
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * PENALTY, 0)
        new_b = c - step * float(error.mean())
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Model(float(b - mean[kept] @ w[kept]), tuple((float(w[i]), rules[i]) for i in kept))


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Whether a row is set aside from learning: crc32 of its id as text, modulo 4, is 2."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(column.cast("string")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of the labelled rows that are not held out, from at most about ``sample`` of them."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label")).filter("_id is not null and _label in (0.0, 1.0)").filter(~held_out("_id"))
    count = known.count()
    if count > sample:
        known = known.filter(F.xxhash64("_id", F.lit(17)) < F.lit(int(sample / count * 2.0**64) - (1 << 63)))
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")
    rows = with_statistics(texts.select("_id", "_label", "_text"), "_text", drop_text=True).toArrow()
    columns = [rows[c].to_numpy() for c in ["_id", "_label", *(_PREFIX + f for f in FEATURES)]]
    order = np.lexsort(columns[::-1])  # the same rows in the same order, however they were read
    x = np.stack(columns[2:], axis=1)[order] if len(order) else np.zeros((0, len(FEATURES)))
    return fit(x, columns[1][order])


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: its id, held_out, score and predicted."""
    slim = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = with_statistics(slim, drop_text=True).select("doc_id", held_out("doc_id").alias("held_out"), model.column().alias("score"))
    return made.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` that the model does not reject."""
    if not model.weighted:
        return documents
    placed, (text_at,), columns = aside(documents, text_col)
    return with_statistics(placed, text_at).filter(model.column() >= threshold).select(*columns).toDF(*documents.columns)
