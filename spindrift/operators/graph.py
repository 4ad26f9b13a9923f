"""Connected components of a table of links, without any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import drop, stage


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """links (a, b) as a staged table; gives (node, component) as a staged table and its path, component being the least node reachable.

    In each round both ends of a link, and the nodes that label them, take the lesser of the two labels; then labels take their own label's. Minima are
    aggregated partially before each shuffle, so a node with very many links costs a task no more than others; rounds grow with the logarithm of the diameter.
    """
    spark = links.sparkSession
    both = links.select(F.col("a").alias("node"), F.least("a", "b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.least("a", "b").alias("component")))
    labels, path = stage(both.groupBy("node").agg(F.min("component").alias("component")), "labels")
    while True:
        ends = (
            links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("x")), "a")
            .join(labels.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
            .where("x <> y")
        )
        least = F.least("x", "y")
        told = ends.select(F.explode(F.array(*(F.struct(F.col(c).alias("node"), least.alias("component")) for c in "abxy"))).alias("s")).select("s.*")
        told, told_path = stage(told.groupBy("node").agg(F.min("component").alias("component")), "told")
        if told.isEmpty():
            drop(spark, told_path)
            return labels, path
        new, new_path = stage(labels.unionByName(told).groupBy("node").agg(F.min("component").alias("component")), "labels")
        up = new.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped, jumped_path = stage(new.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        drop(spark, path, told_path, new_path)
        labels, path = jumped, jumped_path


def connected_components(nodes: DataFrame, edges: DataFrame, a: str = "a", b: str = "b", node: str = "node") -> DataFrame:
    """(node, component) of all nodes, linked or not, component being the least node reachable."""
    links, path = stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links")
    labels, _ = components(links)
    drop(nodes.sparkSession, path)
    return nodes.select(F.col(node).alias("node")).distinct().join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
