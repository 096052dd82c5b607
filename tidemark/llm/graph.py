"""Connected components by repeated contraction, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import through_table


def _mapped(rows: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """`column` replaced by the node it hooks onto."""
    to = hooks.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
    return (rows.join(to, F.col(column) == F.col("_node"), "left")
            .withColumn(column, F.coalesce("_parent", column)).drop("_node", "_parent"))


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): component is the smallest node reachable; only nodes with an edge are listed.

    Every node hooks onto its smallest smaller neighbour, chains are shortened by pointer jumping, and the edges are
    mapped to what is left. Each round at least halves the nodes that still have edges, and only narrow rows move.
    Rows with a null end are ignored."""
    pairs = edges.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo")).where(
        F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("hi") != F.col("lo")))
    pairs = through_table(pairs.distinct(), "edges")
    nodes = pairs.select(F.col("hi").alias("node")).union(pairs.select(F.col("lo").alias("node"))).distinct()
    nodes = nodes.withColumn("component", F.col("node"))
    while not pairs.isEmpty():
        hooks = through_table(pairs.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("_up"), F.col("parent").alias("_top"))
            jumped = hooks.join(up, F.col("parent") == F.col("_up"), "left")
            jumped = through_table(jumped.select("node", F.coalesce("_top", "parent").alias("parent"),
                                                 F.col("_top").isNotNull().alias("moved")), "jumps")
            hooks = jumped.select("node", "parent")
            if jumped.where("moved").isEmpty():
                break
        nodes = through_table(_mapped(nodes, "component", hooks), "nodes")
        pairs = _mapped(_mapped(pairs, "hi", hooks), "lo", hooks)
        pairs = through_table(
            pairs.where("hi != lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(),
            "edges")
    return nodes
