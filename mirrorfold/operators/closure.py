"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorfold.plans.checkpoints import cut


TOGETHER = 100_000  # edges a task; rounds over few edges leave few files


def _settled(edges: DataFrame, n: int | None = None) -> tuple[DataFrame, int, int]:
    made = edges.where("u <> v").distinct()
    made = cut(made if n is None else made.coalesce(1 + n // TOGETHER))
    n, check = made.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return made, n, check or 0


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of longs -> (node, root): the least node of each node's component.

    A hub's edges are never gathered: its least neighbour is a partial minimum and the join that hands it
    back can be split. Self-loops say nothing. The rounds grow with the logarithm of the longest path.
    """
    down = lambda e: e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, n, check = _settled(down(edges))
    while n:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = down(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new, n_new, check_new = _settled(small, n)
        if (n_new, check_new) == (n, check):
            break
        now, n, check = new, n_new, check_new
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())


def welded(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, root) after links (left_root, right_root) between them; an end in no component is its own."""
    more = components(links.select(F.col("left_root").alias("u"), F.col("right_root").alias("v")))
    moved = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return moved.unionByName(more.join(roots.select("node"), "node", "left_anti"))
