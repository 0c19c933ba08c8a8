"""Connected components of a graph that is held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T


def components(links: DataFrame) -> DataFrame:
    """``node``, ``label`` (the smallest node reachable) for each node in ``links`` (a, b).

    Every round takes the least label of the neighbours and then the label of that label, until
    nothing changes: the number of rounds grows with the logarithm of the longest path for chains
    and is two for stars.  State is written to the shared folder after each round.
    """
    spark = links.sparkSession
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = T.written(spark, both, "links")
    labels = T.written(spark, both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        # The centre of a star and the label of a large component stand in very many rows.
        near = T.join_unique(both, labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        low = T.written(spark, labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("was"), F.least("label", "m").alias("low")), "labels")
        step = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        low = T.join_unique(low, step, "low").select("node", "was", F.least("low", "jump").alias("label"))
        low = T.written(spark, low, "labels")
        labels = low.select("node", "label")
        if low.filter("label <> was").isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) of :func:`components` after ``links`` (a, b) came in.

    Links are first drawn between components, one for each pair of them, so however many links two
    components have, one is followed.
    """
    one = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    two = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    a, b = F.coalesce("label_a", "a"), F.coalesce("label_b", "b")
    between = links.join(one, "a", "left").join(two, "b", "left").filter(a != b).select(
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    top = components(between)
    step = top.select(F.col("node").alias("label"), F.col("label").alias("least"))
    out = T.join_unique(labels, step, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    return T.written(links.sparkSession, out.unionByName(top.join(labels, "node", "left_anti")), "labels")
