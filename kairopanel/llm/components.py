"""Connected components by alternating large and small stars, one Spark job a round."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialized


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets that labels describes (each entry holds its set's smallest index) along the edges a - b."""
    while True:
        x, y = labels[a], labels[b]
        if not (differ := x != y).any():
            return labels
        x, y = x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (a, b); component is the smallest node reachable.

    Loops, repeated and null edges are ignored. Each round links all larger neighbours of a node to its smallest
    one, then all smaller ones; both are grouped minimums, so a node with very many neighbours is combined before
    the shuffle. The rounds end when the edges form stars; their number grows with the logarithm of the longest path.
    """
    edges = materialized(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = materialized(small)
        roots = after.select("b").distinct()
        # stars: each node has one parent, and no parent has a parent
        open_ = after.groupBy("a").count().where("count > 1").limit(1).count() + after.join(roots.withColumnRenamed("b", "a"), "a", "left_semi").limit(1).count()
        edges = after
        if not open_:
            break
    else:
        raise RuntimeError(f"components are not complete after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
