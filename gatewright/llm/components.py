"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.storage import forget, written


#: Links of a file; later rounds have no more links than the ones before.
ROWS_A_FILE = 500_000


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node's neighbours move to the smallest of them and the node itself.

    The minimum is an aggregate with partial sums and is joined back, so a node with very many
    neighbours is a skewed join (which Spark splits) and never one task's group.
    """
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """links: columns a and b (long). Returns node, root (the smallest node of its component) for every linked node.

    Each round is two shuffled joins over the remaining links; it ends when a round changes nothing,
    after a number of rounds that grows with the logarithm of the longest chain. Links of a node with
    itself and nulls count for nothing; an empty table gives an empty result.
    """
    edges = written(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(max_rounds):
        moved = _star(_star(edges, small=False), small=True)
        after = written(moved if state is None else moved.coalesce(max(1, -(-state[0] // ROWS_A_FILE))), "links")
        seen = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        forget(edges)
        edges = after
        if tuple(seen) == state or seen[0] == 0:
            break
        state = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
