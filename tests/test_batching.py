"""Buffered batches: a plain version, and a stream that is stopped and started again."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.streaming import batching

RULES = batching.Rules(budget=40, buffer=3, longest=20, seed="s")


def table(spark, rows=240):
    rng = random.Random(1)
    return spark.createDataFrame([(rng.randint(0, 2), i, 1000 + i, rng.choice([1, 3, 8, 20, 21, 30, None])) for i in range(rows)], "key int, seq long, row long, length int")


def plain(rows, rules):
    """The batches of one key, from the rules' words."""
    out, buffer, number = [], [], 0
    rows = [(i, n or 0) for i, n in rows if (n or 0) <= rules.longest][: rules.most]

    def leave():
        nonlocal buffer, number
        key = hashlib.md5(f"{rules.seed}|{plain.key}|{number}".encode()).hexdigest()
        pivot = buffer[int(key[:7], 16) % len(buffer)][1]
        buffer = sorted(buffer, key=lambda r: abs(r[1] - pivot))
        take = 1
        while take < len(buffer) and max(n for _, n in buffer[: take + 1]) * (take + 1) <= rules.budget:
            take += 1
        out.extend((number, i, n) for i, n in buffer[:take])
        buffer, number = buffer[take:], number + 1

    for row in rows:
        buffer.append(row)
        if sum(n for _, n in buffer) > rules.buffer * rules.budget:
            leave()
    while buffer:
        leave()
    return out


def wanted(df, rules):
    out = []
    for key in range(3):
        plain.key = key
        rows = [(r.row, r.length) for r in df.where(F.col("key") == key).orderBy("seq").collect()]
        out += [(key, *r) for r in plain(rows, rules)]
    return sorted(out)


@pytest.mark.parametrize("rules", [RULES, batching.Rules(40, 1, 25, 30), batching.Rules(10, 2, 30)])
def test_same_as_plain(spark, rules):
    df = table(spark)
    got = sorted(map(tuple, batching.buffered_batches(df, "key", "seq", "row", "length", rules).collect()))
    assert got == wanted(df, rules)
    sizes = {}
    for key, batch, _, n in got:
        sizes.setdefault((key, batch), []).append(n)
    assert all(len(s) == 1 or max(s) * len(s) <= rules.budget for s in sizes.values())
    assert batching.buffered_batches(df.limit(0), "key", "seq", "row", "length", rules).count() == 0


def test_stream_stopped_and_started_again(spark, tmp_path):
    """Files come in between runs, which each end; the state goes on where it was, and the result is that of the table."""
    batching.with_state_store(spark)
    df = table(spark)
    schema = "key int, seq long, row long, length int, last boolean"
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        made = batching.streamed_batches(stream, "key", "seq", "row", "length", "last", RULES)
        query = made.writeStream.outputMode("append").format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out)
        assert query.awaitTermination(200)

    for low, high in ((0, 90), (90, 100), (100, 240)):
        df.where((F.col("seq") >= low) & (F.col("seq") < high)).withColumn("last", F.lit(False)).coalesce(1).write.mode("append").parquet(source)
        run()
    spark.createDataFrame([(k, 10**9, None, None, True) for k in range(3)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == wanted(df, RULES)
