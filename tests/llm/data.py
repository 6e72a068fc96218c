"""Small corpora with what real ones hold."""

import random

WORDS = "the of and to in that was his it with is for as had you not be her on at by which have or from this him but all she they were my are".split()


def prose(rng, n, start=0):
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(start, start + 400)}" for _ in range(n))


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=1, n=60):
    """(doc_id, text) with exact and near copies, odd texts and nulls."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(5, 160))) for i in range(n)]
    for i in range(n, n + 40):
        base = rows[rng.randrange(n)][1]
        rows.append((i, edited(rng, base, rng.randrange(0, 6))))
    odd = [None, "", " \t\n", "one", "One", "two words", "a b c", "A  b\nc", "é à ü", "é à Ü", "\x00 x", "x" * 5000, prose(rng, 5000), " a b c"]
    rows += [(n + 40 + k, t) for k, t in enumerate(odd)]
    return rows


def frame(spark, rows, kind="doc_id bigint, text string"):
    return spark.createDataFrame(rows, kind)


def clashing(df):
    """``df`` with columns of the names that operators use inside."""
    from pyspark.sql import functions as F

    names = ("id", "n", "band", "signature", "score", "shard", "slot", "line_no", "_hit_items", "size", "_gone", "h1", "key", "bands")
    return df.select("*", *(F.lit(1).alias(x) for x in names if x not in df.columns))
