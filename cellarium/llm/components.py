"""Connected components of a large graph by alternating large and small stars.

Each round joins every node's neighbours with the smallest of them; a component
ends as a star around its smallest node.  Rounds are written to the shared folder, so
lineage stays short and executors may be lost.  Nothing but counts reaches the driver.

Cases: loops and repeated edges change nothing; NULL ends are no edges; without edges there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarium.llm.common import discard, join_by_key, written

MOST_ROUNDS = 64


def stars(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of an edge other than the roots; root is the smallest node of its component."""
    # An edge is kept as (larger, smaller).
    now = edges.dropna(subset=[u, v]).select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).filter("a <> b").distinct()
    now, before = written(now, "stars"), None
    edges_now = now.count()
    for _ in range(MOST_ROUNDS):
        both = now.select("a", "b").union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("count"))
        # Large star: larger neighbours go to the smallest of all.  The middle of a large star is a hot key.
        met = join_by_key(both, least.select("a", "m"), "a", 2 * edges_now, least.select("a", "count"))
        large = written(met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large-stars")
        # Small star: smaller neighbours, and the node itself, go to the smallest of them.  A node beside many centres is hot.
        small = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("count"))
        moved = join_by_key(large, small.select("a", "m"), "a", 2 * edges_now, small.select("a", "count"))
        after = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        last, now = now, written(after, "stars")
        discard(last, large)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, edges_now = mark, mark[0]
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
