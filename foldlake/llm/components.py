"""Connected components of a graph given as edges, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlake.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b of any one type with an order): root is the least node of its component.

    Every round each node takes the least root among its neighbours, and then its root's root;
    so the rounds grow as the logarithm of the longest path. The job ends when no root has changed.

    A node may have very many neighbours, and a root very many nodes. So each join reads two written
    tables and nothing stands between its sort and its shuffle: a partition that one key makes large is
    read by several tasks (adaptive skew joins, which split the side of many rows).
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = saved(both, "edges")
    roots = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "roots")
    while True:
        near = saved(both.join(roots, F.col("b") == F.col("node")).select("a", "root"), "near").groupBy("a").agg(F.min("root").alias("near"))
        hooked = saved(roots.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), "hooked")
        # A root may itself have found a smaller one: pass that on to all that point at it.
        moved = hooked.filter("node <> root").select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        lifted = hooked.join(moved, F.col("root") == F.col("_n"), "left").select("node", "old", F.least("root", F.coalesce("_r", "root")).alias("root"))
        new = saved(lifted, "roots")
        if not new.filter("old <> root").limit(1).count():
            return new.select("node", "root")
        roots = new.select("node", "root")
