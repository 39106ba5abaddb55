"""Data points of programs: anchors, shares of walks, padding and hints, with every walk checked against the graph."""

import collections

import pytest
from pyspark.sql import functions as F
from test_programs import GRAPH, HERE, plain, plain_stored

from loomgraph.operators import graph, programs, tasks
from loomgraph.plans import joinspec
from loomgraph.plans import relations as R
from loomgraph.sources import programs as sources

WALKS = 30


@pytest.fixture(scope="module")
def made(spark):
    loaded = [sources.read_program(spark, f"{HERE}/{p}", wanted=GRAPH) for p in ("program1", "program2")]
    t = {r: loaded[0][r].unionByName(loaded[1][r]) for r in GRAPH}
    nodes = graph.tuple_nodes(t, {r: R.COLUMNS[r] for r in GRAPH}).cache()
    links = R.program_links()
    edges = graph.tuple_edges(nodes, joinspec.spec_table(spark, links, R.COLUMNS), links, R.COLUMNS).cache()
    stored = programs.stored_names(t["py_exprs"], t["py_expr_contexts"])
    anchors = tasks.access_anchors(nodes, stored, t["py_exprs"]).cache()
    labels = spark.createDataFrame([("program1", "used"), ("program2", "unused"), ("nothing", "used")], "graph_id string, label string")
    return t, nodes, edges, anchors, labels, {r.graph_id: r for r in tasks.data_points(nodes, edges, anchors, labels, WALKS, (3, 6), seed="t").collect()}


def test_anchors(made):
    _, _, _, anchors, _, points = made
    for program in ("program1", "program2"):
        rows = {int(r[0]): r for r in plain(program, "py_exprs")}
        want = sorted(f"py_exprs({','.join(rows[i])})" for i in plain_stored(program))
        assert sorted(r.anchor for r in anchors.where(F.col("graph_id") == program).collect()) == want == points[program].anchors
        assert points[program].source == program
    assert points["program2"].label == "unused"
    empty = points["nothing"]
    assert (empty.anchors, empty.trajectories, empty.hints, empty.label) == ([], [], [], "used")


@pytest.mark.parametrize("program", ["program1", "program2"])
def test_trajectories_are_walks_of_the_graph(made, program):
    _, nodes, edges, _, _, points = made
    label = {r.id: r.label for r in nodes.where(F.col("graph_id") == program).collect()}
    near = collections.defaultdict(set)
    for r in edges.where(F.col("graph_id") == program).collect():
        near[label[r.src], label[r.dst]].add(r.label)
        near[label[r.dst], label[r.src]].add(r.label)
    point = points[program]
    assert len(point.trajectories) == WALKS
    starts = collections.Counter()
    distinct = {}
    for t in point.trajectories:
        names = [f"{kind}({value})" for kind, value in zip(t.node_types, t.node_values, strict=True)]
        assert len(t.edges) == len(names) - 1 and 2 <= len(names) <= 7
        assert all(e in near[a, b] for a, b, e in zip(names, names[1:], t.edges, strict=False))
        assert names[0] in point.anchors
        if (key := (tuple(names), tuple(t.edges))) not in distinct:
            distinct[key] = names
            starts[names[0]] += 1
    assert max(starts.values()) <= max(1, WALKS // len(point.anchors))
    seen = collections.Counter(n for names in distinct.values() for n in names)
    assert point.hints == sorted(n for n, c in seen.items() if c > 1)


def test_same_for_any_partitioning(spark, made):
    _, nodes, edges, anchors, labels, points = made
    again = tasks.data_points(nodes.repartition(5), edges.repartition(3), anchors.repartition(2), labels, WALKS, (3, 6), seed="t").collect()
    assert {r.graph_id: r for r in again} == points


def test_roles(spark, made):
    t = made[0]
    names = t["py_exprs"].where(F.col("kind") == programs.NAME_KIND)
    got = {(r.graph_id, r.id): r.role for r in tasks.stored_and_read(names, t["py_expr_contexts"], programs.STORE_KINDS).collect()}
    assert {i for (g, i), role in got.items() if g == "program2" and role == "write"} == plain_stored("program2")
    assert len(got) == names.count() and set(got.values()) == {"read", "write"}


def test_nth_occurrence(spark):
    rows = [("a.b.a.a", "a"), ("aaa", "aa"), ("", "a"), ("xyz", ""), ("a", "a")]
    df = spark.createDataFrame(rows, "t string, w string").select("t", "w", *[tasks.nth_occurrence(F.col("t"), F.col("w"), n).alias(f"n{n}") for n in range(3)])
    assert [(r.n0, r.n1, r.n2) for r in df.collect()] == [(0, 4, 6), (0, 1, -1), (-1, -1, -1), (-1, -1, -1), (0, -1, -1)]
