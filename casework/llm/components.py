"""Connected components of a link table by repeated random contraction, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.common import cut


def connected_components(links: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """From links (a, b) the rows (node, component), component being the smallest node reachable.

    Each round orders the nodes anew by a hash, points every node to the first one in that order within two links, and
    replaces both ends of each link by what they point to; links inside one node disappear. A star of any size is one node
    after a round; as the order is random, only a share of the nodes is left also on long chains in order of id, so rounds
    grow with the logarithm of the nodes. Pointers come from aggregates that combine before the shuffle, and joins are plain
    merge joins at every size, so a hub with many links is split by AQE and nothing is sent to the driver. Each round is
    cut in the shared checkpoint folder. Nodes without a link are not in the result; null ends and links from a node to
    itself are ignored.
    """
    edges = cut(links.select("a", "b").filter("a <> b").distinct())
    placed = None
    for number in range(max_rounds):
        if edges.isEmpty():
            break

        def order(c: str, number: int = number):
            return F.xxhash64(F.lit(number), c)

        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min_by("b", order("b")).alias("near"))
        reach = first.select(F.col("a").alias("b"), F.when(order("near") < order("a"), F.col("near")).otherwise(F.col("a")).alias("to"))
        points = both.join(reach.hint("merge"), "b").groupBy("a").agg(F.min_by("to", order("to")).alias("to"))
        points = cut(points.select(F.col("a").alias("node"), "to"))
        if placed is None:
            placed = points.select("node", F.col("to").alias("root"))
        else:
            moved = points.select(F.col("node").alias("root"), "to")
            placed = placed.join(moved.hint("merge"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        at_a = points.select(F.col("node").alias("a"), F.col("to").alias("x"))
        at_b = points.select(F.col("node").alias("b"), F.col("to").alias("y"))
        joined = edges.join(at_a.hint("merge"), "a").join(at_b.hint("merge"), "b").filter("x <> y")
        edges = cut(joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if placed is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    placed = cut(placed)
    least = placed.groupBy("root").agg(F.min("node").alias("component"))
    return cut(placed.join(least.hint("merge"), "root").select("node", "component"))
