"""Token graphs cut down by hand, permuted slots, and pointers against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import pointers, tokengraphs


def graphs(spark):
    nodes = [(g, p, "abc"[p % 3]) for g, n in ((1, 6), (2, 4), (3, 1)) for p in range(n)]
    edges = [(1, 0, 1, "NEXT"), (1, 1, 2, "NEXT"), (1, 0, 5, "USE"), (1, 3, 2, "USE"), (1, 4, 5, "OTHER"), (1, 0, 1, "NEXT"), (2, 2, 3, "USE"), (2, 0, 0, "USE"), (3, 0, 9, "NEXT")]
    marks = [(1, "error", 2), (1, "target", 5), (1, "target", 1), (2, "error", 0)]
    return spark.createDataFrame(nodes, "graph_id int, pos int, token string"), spark.createDataFrame(edges, "graph_id int, src int, dst int, name string"), spark.createDataFrame(marks, "graph_id int, role string, pos int")


def cut(spark, **limits):
    nodes, edges, marks = graphs(spark)
    kept = tokengraphs.pruned(nodes, F.col("token") != "b", **limits)
    found = sorted((r.graph_id, r.type, r.src, r.dst) for r in tokengraphs.renumbered_edges(edges, kept, ["USE", "NEXT"]).collect())
    return {(r.graph_id, r.pos): r.number for r in kept.collect()}, found, sorted((r.graph_id, r.role, r.number) for r in tokengraphs.renumbered_pointers(marks, kept).collect())


def test_pruned_by_hand(spark):
    numbers, edges, marks = cut(spark)
    assert numbers == {(1, 0): 0, (1, 2): 1, (1, 3): 2, (1, 5): 3, (2, 0): 0, (2, 2): 1, (2, 3): 2, (3, 0): 0}
    assert edges == sorted([(1, 0, 0, 3), (1, 1, 3, 0), (1, 0, 2, 1), (1, 1, 1, 2), (2, 0, 1, 2), (2, 1, 2, 1), (2, 0, 0, 0), (2, 1, 0, 0)])
    assert marks == [(1, "error", 1), (1, "target", 3), (2, "error", 0)]


def test_pruned_to_length(spark):
    numbers, edges, _ = cut(spark, first=2)
    assert numbers == {(1, 0): 0, (1, 2): 1, (2, 0): 0, (2, 2): 1, (3, 0): 0} and edges == [(2, 0, 0, 0), (2, 1, 0, 0)]
    numbers, edges, _ = cut(spark, longest=3)
    assert {g for g, _ in numbers} == {2, 3} and {e[0] for e in edges} == {2}


def test_edge_that_repeats_and_no_reverse(spark):
    nodes, edges, _ = graphs(spark)
    kept = tokengraphs.pruned(nodes, F.lit(True))
    ahead = tokengraphs.renumbered_edges(edges, kept, ["NEXT"], reverse=False)
    assert sorted((r.graph_id, r.type, r.src, r.dst) for r in ahead.collect()) == [(1, 0, 0, 1), (1, 0, 0, 1), (1, 0, 1, 2)]


def test_slots_are_permuted(spark):
    rows = spark.range(40).repartition(7).select("id", tokengraphs.slot_permutation(F.col("id"), 1, 12).alias("one"), tokengraphs.slot_permutation(F.col("id"), 2, 12).alias("two"))
    found = {r.id: (r.one, r.two) for r in rows.collect()}
    assert all(sorted(p) == list(range(12)) for pair in found.values() for p in pair)
    assert len({tuple(one) for one, _ in found.values()}) == 40 and all(one != two for one, two in found.values())
    again = spark.range(40).coalesce(1).select("id", tokengraphs.slot_permutation(F.col("id"), 1, 12).alias("one")).collect()
    assert all(found[r.id][0] == r.one for r in again)


def test_shuffled_slots(spark):
    row = spark.range(1).select(tokengraphs.shuffled_slots(F.array(*map(F.lit, [7, 50, 52, 51, 50, 8])), F.array(*map(F.lit, [2, 0, 1])), [50, 51, 52]).alias("t")).first()
    assert row.t == [7, 52, 51, 50, 52, 8]


def test_most_variables(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x"), (2, "x")], "graph_id int, variable string")
    assert [tokengraphs.most_variables(rows, most).first().n_slots for most in (100, 1)] == [2, 1]
    assert tokengraphs.most_variables(rows.limit(0)).first().n_slots == 0


def plain_mass(scores, targets, allowed):
    places = set(range(len(scores))) & (set(allowed) if allowed is not None else set(range(len(scores))))
    total = sum(math.exp(scores[i]) for i in places)
    return sum(math.exp(scores[i]) for i in places & set(targets or [])) / total if places else 0.0


def test_mass(spark):
    rng = random.Random(3)
    rows = [([rng.uniform(-3, 3) for _ in range(n)], [rng.randint(-1, 9) for _ in range(k)], [rng.randint(-1, 9) for _ in range(c)]) for n in (1, 5, 8) for k in (0, 1, 4) for c in (0, 3, 9)]
    rows += [([1.0, 2.0], None, [0]), ([1.0, 2.0], [1, 1, None], [1, None]), ([], [0], [0]), ([800.0, 900.0], [1], [0, 1])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s array<double>, t array<int>, a array<int>")
    got = df.select("i", pointers.mass(F.col("s"), F.col("t"), F.col("a")).alias("some"), pointers.mass(F.col("s"), F.col("t")).alias("every")).collect()
    for r in got:
        s, t, a = rows[r.i]
        s = [x - max(s) for x in s]
        assert r.some == pytest.approx(plain_mass(s, t, a)) and r.every == pytest.approx(plain_mass(s, t, None))


def test_pointer_metrics(spark):
    rows = [(0, [9.0, 0.0, 0.0], [0.0, 5.0, 0.0], 3, 0, [], [1]), (1, [0.0, 9.0, 99.0], [0.0, 5.0, 0.0], 2, 1, [1], [0, 1]), (2, [9.0, 0.0, 0.0], [0.0, 0.0, 0.0], 3, 2, [1, 2], [0, 1, 2])]
    df = spark.createDataFrame(rows, "i int, loc array<double>, rep array<double>, n int, e int, t array<int>, c array<int>")
    found = pointers.pointed(df, "loc", "rep", "n", "e", "t", "c")
    assert [(r.buggy, r.hit) for r in found.orderBy("i").collect()] == [(0, 1), (1, 1), (1, 0)]
    m = pointers.pointer_metrics(found).first()
    assert [m.sound_accuracy, m.location_accuracy, m.repair_accuracy, m.joint_accuracy] == pytest.approx([1, 0.5, 1, 0.5])
    assert m.target_loss == pytest.approx((-math.log(math.exp(5) / (math.exp(5) + 1)) - math.log(2 / 3)) / 2)
