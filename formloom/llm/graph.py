"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.llm.common import written
from formloom.operators.skew import resharded_join


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node its links lead to) of all nodes of edges (a, b).

    Each round, a node takes the smallest label among its own and its
    neighbours', then the label of that label, so long paths halve. Labels are
    written to the shared folder each round; the driver sees only whether one
    changed. A node with very many links is cut by the joins.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "edges")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node")
    labels = written(labels, "labels")
    while True:
        near = resharded_join(both.withColumnRenamed("b", "node"), labels, ["node"]).select(F.col("a").alias("node"), F.col("root").alias("near"))
        own = labels.select("node", F.col("root").alias("near"), F.col("root").alias("old"))
        met = near.withColumn("old", F.lit(None).cast(own.schema["old"].dataType)).unionByName(own)
        met = met.groupBy("node").agg(F.min("near").alias("near"), F.max("old").alias("old"))
        jump = met.select(F.col("node").alias("near"), F.col("near").alias("to"))
        step = resharded_join(met, jump, ["near"], "left").select(
            "node", F.coalesce("to", "near").alias("root"), (F.coalesce("to", "near") != F.col("old")).alias("changed"))
        step = written(step, "labels")
        labels = step.select("node", "root")
        if step.where("changed").isEmpty():
            return labels
