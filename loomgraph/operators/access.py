"""Walks made when a sample is asked for: endless epochs of samples, each at a place fixed by a hash.

Epoch and position are part of a walk's seed, so what is drawn at a position is the same whenever it
is asked for, on any cluster, and after any stop. A neighbour is drawn by its ticket: a node's
neighbours in order hold as many tickets as their weights, numbered from 0, and a number below the
node's total picks one. Thus a step is one equi-join of walks with tickets on (node, ticket): nothing
is made for the neighbours that aren't drawn, and a hub's tickets are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import both_ways, cut, likely, running_offsets, running_within, unsent
from loomgraph.operators.walks import FAVOURED_WEIGHT, weight_of

#: Hexadecimal digits of a hash that make a number: 52 bits.
DIGITS = 13
#: Bits by which the tickets that a step draws are told from others before they are joined: 8 MB.
BITS = 1 << 26


def number(*parts: Column | str) -> Column:
    """A number below 2^52 from the md5 of values joined by bars."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, DIGITS), 16, 10).cast("long")


def ticket_table(edges: DataFrame, favoured: tuple[str, ...], heavy: int = FAVOURED_WEIGHT) -> DataFrame:
    """(src, ticket, dst, labels, total, dst_total): a row for each ticket of each neighbour; totals are the numbers of tickets of src and dst."""
    ways = both_ways(edges.select("src", "dst", "label")).groupBy("src", "dst").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    ways = cut(running_within(ways.withColumn("weight", weight_of(F.col("dst"), favoured, heavy).cast("long")), "src", "dst", "weight"))
    there = ways.groupBy(F.col("src").alias("dst")).agg(F.first("total").alias("dst_total"))
    rows = ways.join(unsent(there), "dst").withColumn("ticket", F.explode(F.sequence("low", F.col("low") + F.col("weight") - 1)))
    return cut(rows.select("src", "ticket", "dst", "labels", "total", "dst_total"))


def epoch_order(samples: DataFrame, key: str, epoch: int, seed: str = "0") -> DataFrame:
    """(epoch, position, key): the samples' order in an epoch, by hashes of seed, epoch and key."""
    order = F.struct(F.md5(F.concat_ws("|", F.lit(seed), F.lit(str(epoch)), F.col(key).cast("string"))), F.col(key))
    ordered = running_offsets(samples.select(key, order.alias("__order"), F.lit(1).alias("__one")), "__order", "__one", "position")
    return ordered.select(F.lit(epoch).cast("long").alias("epoch"), "position", key)


def _near(tickets: DataFrame, going: DataFrame) -> DataFrame:
    """The tickets (node, ticket) that walks have drawn, and a few others."""
    places = going.select(F.col("node").alias("src"), F.col("ticket").cast("long").alias("__ticket"))
    return likely(tickets.withColumn("__ticket", F.col("ticket").cast("long")), places, ["src", "__ticket"], BITS).select(tickets.columns)


def walks_at(tickets: DataFrame, places: DataFrame, anchor: str, walks: int, steps: tuple[int, int], seed: str = "0") -> DataFrame:
    """(epoch, position, walk, step, node, label): ``walks`` walks from the anchor at each place (epoch, position, anchor).

    A walk has a number of steps drawn from a closed range; step 0 is the anchor with a null label. A
    step that would use an edge of the walk again (either way, same label) is spent without moving.
    Anchors without neighbours stay.
    """
    low, high = steps
    at = ["epoch", "position", "walk"]
    drawn = lambda *parts: number(F.lit(seed), *at, *parts)
    totals = tickets.where("ticket = 0").select(F.col("src").alias("node"), "total")
    now = places.select("epoch", "position", F.col(anchor).alias("node"), F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk")).join(unsent(totals), "node", "left")
    now = now.withColumn("length", low + F.pmod(drawn(F.lit("length")), F.lit(high - low + 1)))
    now = cut(now.select(*at, "length", F.lit(0).alias("step"), "node", F.lit(None).cast("string").alias("label"), F.array().cast("array<string>").alias("used"), F.lit(True).alias("moved"), "total"))
    out = now.select(*at, "step", "node", "label")
    for step in range(1, high + 1):
        going = now.where((F.col("length") >= step) & F.col("total").isNotNull()).select(*at, "length", "node", "used", "total")
        going = going.withColumn("ticket", F.pmod(drawn(F.lit(str(step)), F.lit("node")), F.col("total")))
        taken = going.join(unsent(_near(tickets, going).select(F.col("src").alias("node"), "ticket", "dst", "labels", "dst_total")), ["node", "ticket"])
        taken = taken.withColumn("label", F.get("labels", F.pmod(drawn(F.lit(str(step)), F.lit("edge")), F.size("labels")).cast("int")))
        taken = taken.withColumn("name", F.concat_ws(" ", F.least("node", "dst"), F.greatest("node", "dst"), "label"))
        taken = taken.withColumn("moved", ~F.array_contains("used", F.col("name")))
        here = lambda new, old: F.when(F.col("moved"), F.col(new) if isinstance(new, str) else new).otherwise(F.col(old)).alias(old)
        now = cut(taken.select(*at, "length", F.lit(step).alias("step"), here("dst", "node"), "label", here(F.concat("used", F.array("name")), "used"), "moved", here("dst_total", "total")))
        out = out.unionByName(now.where("moved").select(*at, "step", "node", "label"))
    return out


def endless_walks(spark: SparkSession, tickets: DataFrame, samples: DataFrame, key: str, folder: str, checkpoint: str, per_batch: int, walks: int, steps: tuple[int, int], seed: str = "0"):
    """A stream that goes through epoch after epoch of the samples and writes the walks of each micro-batch to ``folder``/batch=<number>.

    The checkpoint's offset is the next position. A micro-batch that was cut off is made again as it
    was and replaces what it had written, so after a stop at any point the walks are the same.
    """
    samples = cut(samples.select(key).distinct())
    size = samples.count()
    orders: dict[int, DataFrame] = {}

    def order(epoch: int) -> DataFrame:
        if epoch not in orders:
            orders.clear()  # epochs come one after the other
            orders[epoch] = cut(epoch_order(samples, key, epoch, seed))
        return orders[epoch]

    def write(batch: DataFrame, number: int) -> None:
        ends = batch.agg(F.min("value").alias("low"), F.max("value").alias("high")).first()
        if ends.low is None or not size:
            return
        places = None
        for epoch in range(ends.low // size, ends.high // size + 1):
            asked = order(epoch).where((F.col("position") + epoch * size).between(ends.low, ends.high))
            made = walks_at(tickets, asked, key, walks, steps, seed)
            places = made if places is None else places.unionByName(made)
        places.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", per_batch).load()
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
