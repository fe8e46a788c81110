"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a partially aggregated minimum and an equi-join that AQE can split, so a node with very many links never
lands in one task; each round is written to shared scratch space.  Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, keep


def _stars(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The links after one round, and the scratch tables they are read from.

    The minima are written before they are joined: a join whose sides are plain shuffles is one that AQE can split where a
    node has very many links, or turn into a broadcast where the minima are few."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
    large = keep(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
    least = keep(large.groupBy("a").agg(F.min("b").alias("m")), "least")
    small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct(), [low, large, least]


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(a, b)`` long links, any order, repeats and self-links allowed -> ``(node, root)``: each linked node but the
    smallest of its component, with that smallest node.  An empty table gives an empty table."""
    at = keep(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = _signature(at)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        made, used = _stars(at)
        after = keep(made, "links")
        now = _signature(after)
        for old in (at, *used):
            discard(old)
        at = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return at.select(F.col("a").alias("node"), F.col("b").alias("root"))
