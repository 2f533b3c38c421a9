"""Connected components of string-named nodes by smallest labels, with paths halved each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest name reachable) for every end of edges (a, b).

    A round gives each node the smallest label among its own, its neighbours' and its label's label. The last step doubles the reach, so
    a path takes a number of rounds that grows with the logarithm of its length. Labels are written out each round until none changes."""
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = durable(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("component").alias("near"))
        offers = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("least"))
        # the old label hears of what its nodes found: so a hooked tree moves as a whole, not node by node
        hooks = offers.groupBy(F.col("was").alias("id")).agg(F.min("least").alias("hook"))
        step = durable(offers.join(hooks, "id", "left").select("id", "was", F.least("least", F.coalesce("hook", "least")).alias("to")), "step")
        far = step.select(F.col("id").alias("to"), F.col("to").alias("far"))
        labels = durable(step.join(far, "to").select("id", "was", F.least("to", "far").alias("component")), "labels")
        if not labels.where("was <> component").limit(1).count():
            return labels.select("id", "component")
