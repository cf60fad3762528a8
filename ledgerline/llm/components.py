"""Connected components over an edge table, with tables of one label per node between the rounds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for each node of ``edges`` (``a``, ``b``).

    Each round takes the smallest root among the neighbours and then jumps to the root's root, so long chains shrink fast.  Busy
    nodes meet in aggregates that combine before the shuffle.
    """
    both = stage(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("seen"))
        moved = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "seen").alias("root"))
        top = labels.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        moved = stage(moved.join(top, F.col("root") == F.col("__n"), "left").select("node", "was", F.least("root", F.coalesce("__r", "root")).alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.filter("was <> root").isEmpty():
            return labels
