"""Operators on ordered rows of a conversation. All windows are partitioned; none is global."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_forward(value: str, by: list[str], order: list[str]) -> Column:
    """value, or the last one known before it."""
    return F.last_value(value, ignoreNulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def fill_leading(value: str, by: list[str], order: list[str]) -> Column:
    """value; rows before the first known value take that one, later gaps stay."""
    w = Window.partitionBy(*by).orderBy(*order)
    seen = F.last_value(value, ignoreNulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first_value(value, ignoreNulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.when(seen.isNull(), first).otherwise(F.col(value))


def islands(df: DataFrame, same: str, by: list[str], order: list[str], name: str = "island") -> DataFrame:
    """df with the number of the run of equal `same` values that each row is in, from 1 in each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    begins = ~F.lag(same).over(w).eqNullSafe(F.col(same)) | (F.row_number().over(w) == 1)
    return df.withColumn("_b", begins.cast("int")).withColumn(name, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def consumed(df: DataFrame, key: str, is_call: Column, name: str, by: list[str], order: list[str]) -> Column:
    """On rows that are not calls: the name of the call that stands right before under the same key, else null. A
    call serves one result."""
    w = Window.partitionBy(*by, key).orderBy(*order)
    return F.when(~is_call & F.lag(is_call.cast("int")).over(w).eqNullSafe(F.lit(1)), F.lag(name).over(w))


def as_of(name: str, by: list[str], order: list[str]) -> Column:
    """The last value known before the row, the row excluded."""
    return F.last_value(name, ignoreNulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def path_to_root(nodes: DataFrame, leaves: DataFrame, by: str = "conv") -> DataFrame:
    """(conv, node, depth) of the chain from each conversation's leaf (conv, node; depth 0) up to its root.

    nodes has conv, node, parent. One aggregation gathers a conversation's tree, and the walk goes over a map in the
    row, so there is no join for each level. A chain that returns to itself ends before it repeats a node; a parent
    that is no node ends it too.
    """
    tree = nodes.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("node", "parent"))).alias("up"))
    start = tree.join(leaves.select(by, F.col("node").alias("leaf")), by).where(F.map_contains_key("up", F.col("leaf")))

    def further(path: Column, _: Column) -> Column:
        parent = F.element_at("up", F.element_at(path, -1))
        ends = parent.isNull() | ~F.map_contains_key("up", parent) | F.array_contains(path, parent)
        return F.when(F.coalesce(ends, F.lit(True)), path).otherwise(F.concat(path, F.array(parent)))

    path = F.aggregate(F.sequence(F.lit(1), F.size("up")), F.array(F.col("leaf")), further)
    return start.select(by, F.posexplode(path).alias("depth", "node")).select(by, "node", "depth")
