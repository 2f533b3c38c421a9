"""Connected components over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def connected(edges: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) for each end of edges (a, b: long).

    Each round takes the smallest label among a node and its neighbours, then the label of that label, which halves long paths. Every
    aggregation combines before its shuffle, and joins on hot labels are plain equi-joins that AQE can split; labels are written out each
    round. Rounds end when no label changes.
    """
    edges = durable(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges")
    labels = durable(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("component").alias("near"))
        step = durable(labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("to")), "step")
        far = step.select(F.col("id").alias("to"), F.col("to").alias("far"))
        labels = durable(step.join(far, "to").select("id", "was", F.least("to", "far").alias("component")), "labels")
        if not labels.where("was <> component").limit(1).count():
            return labels.select("id", "component")
