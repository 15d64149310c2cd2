"""Connected components of a link table, by large-star and small-star rounds.

Nodes are longs. Each round is two aggregations and joins over the links; the
result of a round is written to the shared folder, and the rounds end when the
links no longer change. Nothing but two sums comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours (larger ones; or smaller ones and the node itself) on the least node around."""
    if large:
        near = links.union(links.select("b", "a"))
        least = saved(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")  # a table, so that Spark may split the side of a node with many links
        out = near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = saved(near.groupBy("a").agg(F.min("b").alias("m")), "least")
        out = near.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: each linked node and the least node of its component. ``links`` has long columns a and b."""
    now = saved(links.select("a", "b").filter("a <> b").distinct(), "links")
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    mark = print_of(now)
    for _ in range(most_rounds):
        now = saved(_star(_star(now, True), False), "stars")
        if (after := print_of(now)) == mark:
            break
        mark = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return stars.union(stars.select("root", "root")).groupBy("node").agg(F.min("root").alias("root"))
