"""Reads of node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, node): nodes (node, label, file) that a name means by id, label or file, whatever the case; the first of these kinds wins."""
    ways = F.explode(F.array(F.struct(F.lit(0).alias("way"), F.lower(F.col("node").cast("string")).alias("k")), F.struct(F.lit(1).alias("way"), F.lower("label").alias("k")), F.struct(F.lit(2).alias("way"), F.lower("file").alias("k"))))
    keyed = nodes.select("node", ways.alias("w")).select("node", "w.way", "w.k")
    met = names.select("name", F.lower("name").alias("k")).join(keyed, "k")
    return met.withColumn("__r", F.rank().over(Window.partitionBy("name").orderBy("way"))).where("__r = 1").select("name", "node").distinct()


def neighbours(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(node, direction, other, kind) of the edges (src, dst, kind) at the given nodes."""
    out = edges.join(of, edges["src"] == of["node"]).select("node", F.lit("out").alias("direction"), F.col("dst").alias("other"), "kind")
    into = edges.join(of, edges["dst"] == of["node"]).select("node", F.lit("in").alias("direction"), F.col("src").alias("other"), "kind")
    return out.unionByName(into)


def degrees(edges: DataFrame, containers: str | None = "contains", top: int | None = None) -> DataFrame:
    """(node, degree), without nodes that contain others; the first ``top`` by degree, ties by node."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    out = ends.groupBy("node").agg(F.count("*").alias("degree"))
    if containers:
        out = out.join(edges.where(F.col("kind") == containers).select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    return out.orderBy(F.desc("degree"), "node").limit(top) if top else out


def summary(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """(group, nodes, edges): the size of each group of nodes and the edges within it."""
    sizes = nodes.groupBy(by).agg(F.count("*").alias("nodes"))
    a = nodes.select(F.col("node").alias("src"), F.col(by).alias("__a"))
    b = nodes.select(F.col("node").alias("dst"), F.col(by).alias("__b"))
    inner = edges.join(a, "src").join(b, "dst").where("__a = __b").groupBy(F.col("__a").alias(by)).agg(F.count("*").alias("edges"))
    return sizes.join(inner, by, "left").fillna(0, ["edges"])
