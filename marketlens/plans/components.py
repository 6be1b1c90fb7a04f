"""Connected components of large edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.session import scratch_dir


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read from there."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root for every node that an edge (src, dst) joins to another: the least node of its component.

    Rounds of two steps: every node takes the least label among its neighbours'
    and its own, then the label of its label. Labels are minima over partial minima,
    so a hub costs one row per task; each round is written before the next, which
    cuts the lineage.
    """
    both = written(edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct(), "edges")
    labels = written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("root")), "labels")
    for _ in range(most):
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("root").alias("near"))
        hooked = labels.join(near, labels["node"] == near["src"]).select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        top = labels.select(F.col("node").alias("via"), F.col("root").alias("over"))
        moved = written(hooked.join(top, hooked["root"] == top["via"], "left").select(
            "node", "old", F.least("root", "over").alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.filter("root <> old").isEmpty():
            return labels
    raise RuntimeError(f"components not settled after {most} rounds")
