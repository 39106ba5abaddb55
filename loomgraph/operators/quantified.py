"""Existential and universal conditions as semi- and anti-joins and boolean aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import running_within


def having_some(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left_semi")


def having_none(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def for_all(left: DataFrame, right: DataFrame, on: list[str], condition: Column) -> DataFrame:
    """Rows of ``left`` none of whose partners breaks the condition; vacuously true without partners."""
    return left.join(right.where(~F.coalesce(condition, F.lit(False))), on, "left_anti")


def for_all_and_some(left: DataFrame, right: DataFrame, on: list[str], condition: Column) -> DataFrame:
    """As :func:`for_all`, and with at least one partner."""
    good = right.groupBy(*on).agg(F.bool_and(F.coalesce(condition, F.lit(False))).alias("__all")).where("__all")
    return left.join(good.select(*on), on, "left_semi")


def divided_by(pairs: DataFrame, divisor: DataFrame, key: str, value: str) -> DataFrame:
    """Relational division: keys paired with every value of ``divisor``."""
    needed = divisor.select(value).distinct()
    held = pairs.select(key, value).distinct().join(needed, value, "left_semi").groupBy(key).agg(F.count("*").alias("__n"))
    return held.join(needed.agg(F.count("*").alias("__m")), F.col("__n") == F.col("__m")).select(key)


def more_than_one(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys with two or more rows; absent keys count as nothing, not as zero."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def ignorable_name(name: Column) -> Column:
    """Names that are meant to be unused."""
    return name.rlike("^_+$") | name.startswith("__") | name.isin("empty", "dummy") | name.contains("unused") | name.contains("dummy")


def pairs_below(left: DataFrame, right: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n): pairs of a left and a right row of a group in which the left value is the smaller one; groups without any are left out.

    Left rows are counted against the running number of right ones in the order of values, which is taken range by
    range, so no pair is made and a group may hold most rows. NaN is above all numbers.
    """
    side = lambda df, kind: df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(group, F.struct((F.col(value) + 0).alias("v"), F.lit(kind).alias("kind")).alias("__order"))
    rows = side(right, 0).unionByName(side(left, 1)).groupBy(group, "__order").agg(F.count("*").alias("__rows"))
    placed = running_within(rows.withColumn("__right", F.when(F.col("__order.kind") == 0, F.col("__rows")).otherwise(0)), group, "__order", "__right")
    above = placed.where("__order.kind = 1").groupBy(group).agg(F.sum(F.col("__rows") * (F.col("total") - F.col("low"))).alias("n"))
    return above.where("n > 0")
