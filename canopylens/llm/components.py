"""Connected components of an undirected graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopylens.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b); component is the smallest node of its component.

    In each round every node joins its smallest neighbour, if that is smaller than itself, and the edges are drawn
    between the nodes so joined; rounds end when no edge is left. An empty table gives an empty table.
    """
    both = edges.select("a", "b").where("a <> b")
    both = cut(both.union(both.select("b", "a")).toDF("a", "b").distinct(), "edges")
    label = None
    while not both.isEmpty():
        joined = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("parent")), "parents")
        up = joined.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        if label is None:
            label = joined.select("node", F.col("parent").alias("component"))
        else:
            label = label.join(up.withColumnRenamed("parent", "component"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        label = cut(label, "labels")
        of_a, of_b = joined.toDF("a", "pa"), joined.toDF("b", "pb")
        both = cut(both.join(of_a, "a").join(of_b, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
    return label if label is not None else both.select(F.col("a").alias("node"), F.col("b").alias("component"))
