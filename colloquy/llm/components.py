"""Connected components over tables of nodes and edges, by hooking and pointer jumping.

Every step is a join or an aggregation on node ids and is written to the shared folder; nothing is collected. A
label that many nodes share is on the many-rows side of joins with one row a label, which adaptive execution
broadcasts or splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import store


def flatten(parents: DataFrame) -> DataFrame:
    """(node, parent) with parent < node: each node's root among them."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        parents = store(parents.join(up, "parent", "left").select("node", F.coalesce("up", "parent").alias("parent"), F.col("up").isNotNull().alias("moved")), "parents")
        if parents.where("moved").isEmpty():
            return parents.select("node", "parent")
        parents = parents.select("node", "parent")


def link(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label: the smallest node of its component) after edges (a, b) between nodes are added."""
    while True:
        a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        across = edges.join(a, "a").join(b, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        edges = store(across, "across")
        if edges.isEmpty():
            return labels
        hooks = store(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "hooks")
        up = flatten(hooks).select(F.col("node").alias("label"), "parent")
        labels = store(labels.join(up, "label", "left").select("node", F.coalesce("parent", "label").alias("label")), "labels")
