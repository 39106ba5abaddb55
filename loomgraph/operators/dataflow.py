"""Ordered relations between occurrences: next token, last use, last read and write, ranks and redefinitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_token(df: DataFrame, group: list[str], order: list[str], node: str) -> DataFrame:
    """Add next_token: the node that follows in a group."""
    return df.withColumn("next_token", F.lead(node).over(Window.partitionBy(*group).orderBy(*order)))


def last_use(df: DataFrame, group: list[str], order: list[str], node: str) -> DataFrame:
    """Add last_use: the previous occurrence in a group (a variable of a program)."""
    return df.withColumn("last_use", F.lag(node).over(Window.partitionBy(*group).orderBy(*order)))


def last_read_write(df: DataFrame, group: list[str], order: list[str], node: str, is_read: Column) -> DataFrame:
    """Add last_read and last_write: the previous occurrence of either kind; no row is its own."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    read = F.last(F.when(is_read, F.col(node)), ignorenulls=True).over(before)
    write = F.last(F.when(~is_read, F.col(node)), ignorenulls=True).over(before)
    return df.withColumns({"last_read": read, "last_write": write})


def earlier_or_same_counts(df: DataFrame, group: list[str], order: list[str], is_read: Column) -> DataFrame:
    """Add n_last_read: of all pairs (i, j), i <= j, of a group in which j is a read, those that end here. Pairs aren't made."""
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("n_last_read", F.when(is_read, F.count("*").over(upto)).otherwise(F.lit(0)))


def rank_in_block(df: DataFrame, block: list[str], order: list[str]) -> DataFrame:
    """Add rank (dense, from 1), is_first and is_last among the definitions of a block."""
    rank = F.dense_rank().over(Window.partitionBy(*block).orderBy(*order))
    ranked = df.withColumn("rank", rank)
    top = F.max("rank").over(Window.partitionBy(*block))
    return ranked.withColumns({"is_first": F.col("rank") == 1, "is_last": F.col("rank") == top})


def redefinitions(df: DataFrame, block: list[str], order: list[str], node: str) -> DataFrame:
    """Pairs (definition, redefinition) of neighbouring ranks in a block."""
    ranked = rank_in_block(df, block, order).select(*block, "rank", F.col(node).alias("definition"))
    after = ranked.select(*block, (F.col("rank") - 1).alias("rank"), F.col("definition").alias("redefinition"))
    return ranked.join(after, [*block, "rank"]).select(*block, "definition", "redefinition")


def reached_in_order(df: DataFrame, group: list[str], order: list[str], key: list[str], node: str) -> DataFrame:
    """(origin, n_reached): how many later nodes of its group each node reaches up to and with the next one of its key.

    What :func:`loomgraph.operators.graph.reaches_without` counts where the only way on is the next
    node, from places alone: no pair of nodes is made. Nodes that reach nothing are left out.
    """
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    stop = F.lead("__place").over(Window.partitionBy(*group, *key).orderBy("__place"))
    last = F.max("__place").over(Window.partitionBy(*group))
    placed = df.withColumn("__place", place).withColumn("__stop", F.coalesce(stop, last))
    return placed.select(F.col(node).alias("origin"), (F.col("__stop") - F.col("__place")).cast("long").alias("n_reached")).where("n_reached > 0")


def numbered_by_location(df: DataFrame, group: list[str], line: str, column: str, tie: str) -> DataFrame:
    """Add number from 1 by (line, column), missing ones as 0."""
    order = [F.coalesce(F.col(line), F.lit(0)), F.coalesce(F.col(column), F.lit(0)), F.col(tie)]
    return df.withColumn("number", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def first_seen_ids(df: DataFrame, group: list[str], position: str, key: str) -> DataFrame:
    """Add slot: keys of a group numbered from 0 in the order they are first seen."""
    first = df.withColumn("__first", F.min(position).over(Window.partitionBy(*group, key)))
    return first.withColumn("slot", F.dense_rank().over(Window.partitionBy(*group).orderBy("__first")) - 1).drop("__first")
