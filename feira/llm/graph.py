"""Connected components of a link table, by alternating large-star and small-star steps.

Both steps only take minima per node and joins, so a node with very many links is
pre-aggregated in the map tasks and its join partition can be split. Each round is
written to the shared folder. The number of rounds grows with the logarithm of the
longest chain; the loop ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm._store import materialise


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _state(links: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    row = links.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(0xFFFFFFFF))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """Columns ``id`` and ``component`` (the smallest id that links lead to), for every id of ``links(a, b)``.

    An empty link table gives an empty result; loops and repeated links are ignored.
    """
    now = materialise(links.filter("a <> b").select("a", "b").distinct(), "links")
    before = _state(now)
    while before[0]:
        now = materialise(_small_star(_large_star(now).distinct()).filter("a <> b").distinct(), "links")
        after = _state(now)
        if after == before:
            break
        before = after
    labels = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return labels.unionByName(roots).groupBy("id").agg(F.min("component").alias("component"))
