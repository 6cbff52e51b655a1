"""Connected components of a table of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import staged


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One step: every node hands its least neighbour to its greater (large) or smaller (small) neighbours."""
    both = links if small else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if small:  # a is the greater end
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
    joined = both.join(least, "a")
    if small:
        out = joined.select(F.col("b").alias("a"), F.col("root").alias("b")).unionByName(
            least.select("a", F.col("root").alias("b"))
        )
    else:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return out.where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``links`` (a, b); root is the least node it reaches.

    Loops and repeated links are ignored. The rounds needed grow with the logarithm of the longest path.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        stepped = staged(_star(_star(edges, small=False), small=True))
        # settled when a step changes nothing: then every node has one link, to its root
        now = stepped.agg(F.count("*").alias("links"), F.bit_xor(F.xxhash64("a", "b")).alias("digest")).first()
        edges, before, last = stepped, now, before
        if now == last:
            break
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
