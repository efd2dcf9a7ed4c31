"""Connected components by repeated contraction: joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a long, b long); root is the same within a component.

    Each round hangs every node under its smallest neighbour, shortens these paths twice, and draws the
    edges anew between what the nodes hang under. Nodes with edges at least halve in most rounds: after a
    round only the smallest nodes of their surroundings are left. Minima are summed before the shuffle,
    so a node with a third of all edges is no burden. An empty table of edges gives no rows."""
    left = common.settle(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    ends = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
    roots = ends.select("node", F.col("node").alias("root"))
    while not left.isEmpty():
        both = left.select(F.col("b").alias("node"), F.col("a").alias("up")).union(left.select(F.col("a").alias("node"), F.col("b").alias("up")))
        ups = both.groupBy("node").agg(F.min("up").alias("up")).select("node", F.least("node", "up").alias("up"))
        ups = common.settle(ups, "ups")
        for _ in range(2):
            above = ups.select(F.col("node").alias("_n"), F.col("up").alias("_up"))
            ups = ups.join(above, ups["up"] == above["_n"], "left").select("node", F.coalesce("_up", "up").alias("up"))
        ups = common.settle(ups, "ups")
        to_a, to_b = ups.select(F.col("node").alias("a"), F.col("up").alias("_a")), ups.select(F.col("node").alias("b"), F.col("up").alias("_b"))
        drawn = left.join(to_a, "a").join(to_b, "b").filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        left = common.settle(drawn, "edges")
        moved = ups.select(F.col("node").alias("root"), F.col("up").alias("_root"))
        roots = common.settle(roots.join(moved, "root", "left").select("node", F.coalesce("_root", "root").alias("root")), "roots")
    return roots
