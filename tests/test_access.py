"""Walks on access: a plain walk, the odds of a draw, and a stream that is stopped and started again."""

import hashlib
import time
from collections import Counter

from pyspark.sql import functions as F

from loomgraph.operators import access, graph

EDGES = [("a(1)", "b(1)", "x"), ("a(2)", "b(1)", "x"), ("b(1)", "c(1)", "y"), ("b(1)", "c(1)", "z"), ("c(1)", "a(1)", "x"), ("d(1)", "d(2)", "x")]


def frame(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, label string")


def draw(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def plain_walk(seed, epoch, position, walk, anchor, low, high):
    near = {}
    for a, b, label in EDGES:
        near.setdefault(a, {}).setdefault(b, set()).add(label)
        near.setdefault(b, {}).setdefault(a, set()).add(label)
    out, node, used = [(0, anchor, None)], anchor, set()
    for step in range(1, low + draw(seed, epoch, position, walk, "length") % (high - low + 1) + 1):
        tickets = [n for n in sorted(near.get(node, {})) for _ in range(5 if n[0] == "c" else 1)]
        if not tickets:
            break
        there = tickets[draw(seed, epoch, position, walk, step, "node") % len(tickets)]
        labels = sorted(near[node][there])
        label = labels[draw(seed, epoch, position, walk, step, "edge") % len(labels)]
        if (name := (min(node, there), max(node, there), label)) not in used:
            used.add(name)
            node = there
            out.append((step, node, label))
    return out


def test_same_as_plain(spark):
    tickets = access.ticket_table(frame(spark), ("c",))
    places = spark.createDataFrame([(3, 7, "a(1)"), (3, 8, "b(1)"), (4, 0, "alone(1)"), (4, 1, "d(2)")], "epoch long, position long, anchor string")
    got = access.walks_at(tickets, places, "anchor", 6, (2, 5), "s").collect()
    want = {(e, p, w, *row) for e, p, a in map(tuple, places.collect()) for w in range(1, 7) for row in plain_walk("s", e, p, w, a, 2, 5)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_odds(spark):
    tickets = access.ticket_table(frame(spark), ("c",))
    places = spark.range(200).select(F.lit(0).alias("epoch"), F.col("id").alias("position"), F.lit("b(1)").alias("anchor"))
    first = Counter(r.node for r in access.walks_at(tickets, places, "anchor", 10, (1, 1)).where("step = 1").collect())
    assert 0.66 < first["c(1)"] / 2000 < 0.77  # five of seven tickets


def test_running_within(spark):
    df = spark.createDataFrame([("g" if i % 3 else "h", f"{i:03}", i % 5) for i in range(300)], "grp string, name string, size int")
    rows = graph.running_within(df, "grp", "name", "size").collect()
    for g in "gh":
        own = sorted((r for r in rows if r.grp == g), key=lambda r: r.name)
        assert [r.low for r in own] == [sum(x.size for x in own[:i]) for i in range(len(own))] and {r.total for r in own} == {sum(r.size for r in own)}


def test_epochs_are_permutations(spark):
    samples = spark.range(50).withColumnRenamed("id", "key")
    orders = [[r.key for r in access.epoch_order(samples, "key", e).orderBy("position").collect()] for e in (0, 1)]
    assert sorted(orders[0]) == sorted(orders[1]) == list(range(50)) and orders[0] != orders[1]
    assert [r.position for r in access.epoch_order(samples.repartition(7), "key", 0).orderBy("position").collect()] == list(range(50))


def test_stream_stopped_and_started_again(spark, tmp_path):
    tickets = access.ticket_table(frame(spark), ("c",))
    samples = spark.createDataFrame([("a(1)",), ("b(1)",), ("c(1)",)], "anchor string")
    out, mark = str(tmp_path / "walks"), str(tmp_path / "mark")

    def run(batches):
        query = access.endless_walks(spark, tickets, samples, "anchor", out, mark, per_batch=2, walks=2, steps=(1, 3), seed="s")
        until = time.time() + 200
        while time.time() < until and (query.lastProgress is None or query.lastProgress["batchId"] < batches):
            assert query.exception() is None
            time.sleep(0.2)
        query.stop()  # in the middle of a micro-batch, most likely

    run(1)
    run(3)
    got = {tuple(r) for r in spark.read.parquet(out).where("batch < 4").drop("batch").collect()}
    want = set()
    for value in range(8):
        epoch, position = divmod(value, 3)
        names = [r.anchor for r in access.epoch_order(samples, "anchor", epoch, "s").orderBy("position").collect()]
        want |= {(epoch, position, w, *row) for w in (1, 2) for row in plain_walk("s", epoch, position, w, names[position], 1, 3)}
    assert got == want


def test_few_tickets_meet_the_walks(spark, monkeypatch):
    """Before the join tickets that no walk has drawn are left out, and none that one has."""
    tickets = spark.range(20_000).selectExpr("'n' || id div 4 as src", "id % 4 as ticket", "'m' || id as dst")
    going = spark.range(300).selectExpr("'n' || id * 7 as node", "id % 4 as ticket")
    wanted = {(r.node, r.ticket) for r in going.collect()}
    near = {(r.src, r.ticket) for r in access._near(tickets, going).collect()}
    assert wanted <= near and len(near) < 310
    monkeypatch.setattr(access, "BITS", 8)
    assert wanted <= {(r.src, r.ticket) for r in access._near(tickets, going).collect()}


def test_walkers_are_not_broadcast(spark, monkeypatch):
    """However small their files look, neither walkers nor nodes go whole through the driver: only bitmaps do."""
    plans = []

    def kept(cut):
        return lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df)

    for module in (access, graph):
        monkeypatch.setattr(module, "cut", kept(module.cut))
    edges = spark.createDataFrame([(f"a({i % 3})", f"b({i})", "l") for i in range(30)], "src string, dst string, label string")
    tickets = access.ticket_table(edges, ("a",))
    places = spark.createDataFrame([(0, i, f"b({i})") for i in range(9)], "epoch long, position long, anchor string")
    access.walks_at(tickets, places, "anchor", 2, (2, 3), "s")
    joins = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert joins and all("__bucket" in line for line in joins)
    assert any("SortMergeJoin" in plan for plan in plans)
