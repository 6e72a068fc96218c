"""Connected components of links, by alternating stars: each round is two joins, whatever a component's size or shape.

A large star links each node's larger neighbours to the smallest node that it knows; a small star links its smaller
ones and itself. After a few rounds (about the logarithm of the longest path) each node is linked to the smallest of its
component. Minima are summed up in the map tasks before they meet, and the joins that follow have no row per pair, so
that a hub's links are only as many rows as it has links. Each round's links are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._work import discard, stored

#: About the square of the logarithm of the longest path is needed; more is an error, never a partial result.
ROUNDS = 200


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that a link touches, a stored table; the component is its smallest node. Links may repeat.

    Links from a node to itself, or with a null end, count for nothing; no links give no rows.
    """
    current = stored(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b").distinct(), "links")
    state = _state(current)
    for _ in range(ROUNDS if state[0] else 0):
        last, current = current, stored(_small(_large(current)).distinct(), "links")
        discard(last)
        before, state = state, _state(current)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = stored(current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots), "components")
    discard(current)
    return found
