"""Deterministic sampling and splitting by hashes; equal for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import running_offsets, running_within


def draw(*parts: Column | str) -> Column:
    """A number below 2^28 from the md5 of values joined by bars."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 7), 16, 10).cast("long")


def first_by_hash(df: DataFrame, group: list[str], key: str, count: int, seed: str = "0") -> DataFrame:
    """``count`` rows of each group, those with the smallest hashes of their keys: a sample without replacement."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(order, key))).where(F.col("__n") <= count).drop("__n")


def class_draws(df: DataFrame, label: str, key: str, draws: int, seed: str = "0") -> DataFrame:
    """(draw, class, key): draws with replacement, class first (each as likely), then a member of it."""
    spark = df.sparkSession
    members = running_within(df.select(F.col(label).alias("class"), F.col(key).alias("key"), F.lit(1).alias("one")), "class", "key", "one")  # a class may hold most rows
    members = members.select("class", "key", (F.col("low") + 1).cast("int").alias("n"))
    classes = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("size")).withColumn("c", F.row_number().over(Window.orderBy("class")))
    total = classes.agg(F.count("*").alias("classes"))
    turns = spark.range(1, draws + 1).withColumnRenamed("id", "draw").join(F.broadcast(total))
    turns = turns.withColumn("c", (F.pmod(draw(F.lit(seed), F.lit("class"), F.col("draw").cast("string")), F.col("classes")) + 1).cast("int"))
    picked = turns.join(F.broadcast(classes), "c").withColumn("n", (F.pmod(draw(F.lit(seed), F.lit("member"), F.col("draw").cast("string")), F.col("size")) + 1).cast("int"))
    return picked.join(members, ["class", "n"]).select("draw", "class", "key")


def split_phases(df: DataFrame, key: str, dev: int = 1, evaluate: int = 1, of: int = 10) -> DataFrame:
    """Add phase: train, dev or eval by the key's remainder."""
    rest = F.pmod(F.col(key), F.lit(of))
    return df.withColumn("phase", F.when(rest < dev, "dev").when(rest < dev + evaluate, "eval").otherwise("train"))


def batches(df: DataFrame, order: str, size: int, drop_last: bool) -> DataFrame:
    """Add batch (from 0) in order; ``drop_last`` drops the short batch. Rows are numbered range by range, not in one task."""
    total = df.count()
    last = total // size if drop_last else -(-total // size)
    numbered = running_offsets(df.withColumn("__one", F.lit(1)), order, "__one", "__n")
    return numbered.withColumn("batch", F.floor(F.col("__n") / size)).where(F.col("batch") < last).drop("__one", "__n")


def length_bucketed_batches(df: DataFrame, key: str, length: str, budget: int, parts: int = 1) -> DataFrame:
    """Add bucket and batch: rows in order of length within hashed buckets; a batch closes before its longest row times its rows exceeds the budget.

    A bucket's rows are packed greedily by one task; ``parts`` says how many buckets there are.
    """
    schema = df.select("*", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("batch")).schema
    bucketed = df.withColumn("bucket", F.pmod(F.col(key), F.lit(parts)).cast("int")).repartition("bucket").sortWithinPartitions("bucket", length, key)

    def pack(frames):
        state: dict[int, list[int]] = {}  # bucket: batch, rows
        for pdf in frames:
            numbers = []
            for bucket, n in zip(pdf["bucket"], pdf[length], strict=True):
                batch, rows = state.get(bucket, (0, 0))
                if rows and n * (rows + 1) > budget:
                    batch, rows = batch + 1, 0
                state[bucket] = [batch, rows + 1]
                numbers.append(batch)
            yield pdf.assign(batch=numbers)

    return bucketed.mapInPandas(pack, schema)
