"""Connected components of an edge table by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, release


def components(edges: DataFrame) -> DataFrame:
    """Written table (node, component) of the nodes of edges (a, b); component is the smallest node.

    Each round gives a node the smallest label among its neighbours' and then that label's
    own label, so the rounds grow with the logarithm of a component's width.  A node with
    very many edges is combined before exchanges; joins are between written tables and can
    be split where a key is skewed.  The driver sees one number a round.
    """
    both = materialise(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    written = label
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("low"))
        step = materialise(step, "step")
        jump = step.select(F.col("node").alias("low"), F.col("low").alias("next"))
        after = step.join(jump, "low").select("node", "next", (F.col("next") != F.col("label")).alias("moved"))
        after = materialise(after, "labels")
        release(step, written)
        written = after
        label = after.select("node", F.col("next").alias("label"))
        if after.where("moved").limit(1).count() == 0:
            release(both)
            return label.withColumnRenamed("label", "component")
