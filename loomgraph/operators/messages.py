"""Message passing: one round of aggregating neighbours' features, by edge type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def aggregate_messages(edges: DataFrame, features: DataFrame, nodes: DataFrame, how: str = "sum") -> DataFrame:
    """(dst, type, dim, value): features (node, dim, value) of the sources of a node's edges, joined by sum, avg, max or min.

    Every node of ``nodes`` (node) gets a row for each type and dimension, 0 where nothing arrives.
    Types and dimensions come from small tables of their own, so the frame is made by joins on them.
    """
    sent = edges.select(F.col("src").alias("node"), "dst", "type").join(features, "node")
    got = sent.groupBy("dst", "type", "dim").agg(getattr(F, how)("value").alias("value"))
    kinds = F.broadcast(edges.select("type").distinct().join(features.select("dim").distinct()))
    frame = nodes.select(F.col("node").alias("dst")).join(kinds)
    return frame.join(got, ["dst", "type", "dim"], "left").select("dst", "type", "dim", F.coalesce("value", F.lit(0.0)).alias("value"))


def mean_by_in_degree(edges: DataFrame) -> DataFrame:
    """Add weight: one over the number of edges of the type that end in the same node."""
    return edges.withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy("dst", "type")))


def sparse_times_dense(entries: DataFrame, table: DataFrame) -> DataFrame:
    """(row, dim, value): sums of the table's vectors (token, dim, value) over the tokens of a row (row, token)."""
    return entries.join(table, "token").groupBy("row", "dim").agg(F.sum("value").alias("value"))


def readout(values: DataFrame, graph: str, how: str = "sum") -> DataFrame:
    """(graph, dim, value) over the nodes of a graph."""
    return values.groupBy(graph, "dim").agg(getattr(F, how)("value").alias("value"))
