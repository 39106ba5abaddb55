"""Classification metrics, losses and poolings as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import running_offsets

TINY = 1e-18


def argmax(scores: Column) -> Column:
    """Number (from 0) of the largest value of an array, the first among equals."""
    return F.array_position(scores, F.array_max(scores)) - 1


def accuracy(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    return df.agg(F.avg((F.col(predicted) == F.col(truth)).cast("int")).alias("accuracy"))


def confusion(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def roc_auc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties at their mean rank.

    Scores are counted first, and running counts of distinct scores are taken range by range.
    """
    each = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(truth).cast("long")).alias("p"))
    ranked = running_offsets(each, "s", "n", "below").select("n", "p", (F.col("p") * (F.col("below") + (F.col("n") + 1) / 2)).alias("r"))
    total = ranked.agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("r").alias("r"))
    return total.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0))).alias("auc"))


def log_loss(df: DataFrame, probability: str, truth: str) -> DataFrame:
    p, y = F.col(probability), F.col(truth)
    return df.agg(F.avg(-y * F.log(p + TINY) - (1 - y) * F.log(1 - p + TINY)).alias("log_loss"))


def conditional_mean(value: Column, mask: Column) -> Column:
    """Mean of a value where a 0/1 mask is 1, guarded against empty masks."""
    return F.sum(value.cast("double") * mask) / (F.lit(1e-9) + F.sum(mask))


def softmax(df: DataFrame, group: list[str], score: str, name: str = "probability") -> DataFrame:
    w = Window.partitionBy(*group)
    e = df.withColumn("__e", F.exp(F.col(score) - F.max(score).over(w)))
    return e.withColumn(name, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def weighted_vote(df: DataFrame, group: list[str], score: str, value: Column) -> DataFrame:
    """(group, vote): values weighted by the softmax of their scores."""
    return softmax(df, group, score, "__w").groupBy(*group).agg(F.sum(F.col("__w") * value).alias("vote"))


def pooled(df: DataFrame, group: list[str], vector: str, how: str) -> DataFrame:
    """(group, dim, value) of vectors by max, avg, sum or min in each dimension."""
    each = df.select(*group, F.posexplode(vector).alias("dim", "x"))
    return each.groupBy(*group, "dim").agg(getattr(F, how)("x").alias("value"))


def best_by(df: DataFrame, group: list[str], what: str, score: str) -> DataFrame:
    return df.groupBy(*group).agg(F.max_by(what, F.struct(score, what)).alias(f"best_{what}"), F.max(score).alias(f"best_{score}"))
