"""Random access to graphs by index, with the files that it reads, and lookups of nodes by label."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomgraph.sources import graphstore


def graphs(spark, first=0, count=40):
    """Graph i has i % 5 + 1 nodes in a line; every third one no edges."""
    meta = [(f"g{i:03}", "even" if i % 2 == 0 else "odd") for i in range(first, first + count)]
    nodes = [(f"g{i:03}", n + 1, f"n{n}", i * 100 + n) for i in range(first, first + count) for n in range(i % 5 + 1)]
    edges = [(f"g{i:03}", n, n + 1, "next") for i in range(first, first + count) for n in range(1, i % 5 + 1) if i % 3]
    return spark.createDataFrame(meta, "graph_id string, label string"), spark.createDataFrame(nodes, "graph_id string, id int, label string, value int"), spark.createDataFrame(edges, "graph_id string, src int, dst int, label string")


def files_read(df):
    """Files that the scans of a plan select, from Spark's own plan."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).selectedPartitions().totalNumberOfFiles() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    folders = [str(tmp_path_factory.mktemp("store") / name) for name in "ab"]
    graphstore.write_store(*graphs(spark), folders[0], per_block=8)
    graphstore.write_store(*graphs(spark, 40, 10), folders[1], per_block=8)
    return folders


def test_index(spark):
    rows = {r.graph_id: r for r in graphstore.graph_index(*graphs(spark), 8).collect()}
    before = {"num_nodes": 0, "num_edges": 0}
    for i, name in enumerate(sorted(rows)):
        r = rows[name]
        assert (r["index"], r.block, r.num_nodes, r.num_edges) == (i, i // 8, i % 5 + 1, i % 5 if i % 3 else 0)
        assert (r.node_offset, r.edge_offset) == (before["num_nodes"], before["num_edges"])
        before = {"num_nodes": r.node_offset + r.num_nodes, "num_edges": r.edge_offset + r.num_edges}


def test_one_graph_reads_one_block(spark, stores):
    store = graphstore.GraphStore(spark, *stores)
    assert len(store) == 50
    for number in (0, 13, 39, 40, 49):
        row, nodes, edges = store.at(number)
        assert row.first().graph_id == f"g{number:03}"
        assert sorted((r.id, r.value) for r in nodes.collect()) == [(n, number * 100 + n) for n in range(number % 5 + 1)]
        assert sorted((r.src, r.dst) for r in edges.collect()) == ([(n, n + 1) for n in range(number % 5)] if number % 3 else [])
        assert files_read(nodes) == 1 and files_read(edges) <= 1
    for number in (-1, 50):
        with pytest.raises(IndexError):
            store.at(number)


def test_fetch_many(spark, stores):
    store = graphstore.GraphStore(spark, *stores)
    wanted = spark.createDataFrame([(0, 41), (1, 3), (2, 3), (3, 99)], "draw int, index long")
    found, nodes, edges = store.fetch(wanted)
    assert sorted((r.draw, r.graph_id) for r in found.collect()) == [(0, "g041"), (1, "g003"), (2, "g003")]
    assert sorted((r.draw, r.value) for r in nodes.collect()) == [(0, 4100), (0, 4101)] + [(d, 300 + n) for d in (1, 2) for n in range(4)]
    assert sorted((r.draw, r.src) for r in edges.collect()) == [(0, 0)]


def test_by_class(spark, stores):
    store = graphstore.GraphStore(spark, *stores)
    drawn = store.by_class("label", 200).join(store.index().select("index", "label"), "index").collect()
    assert len(drawn) == 200 and all(r["class"] == r.label for r in drawn)
    assert 60 < sum(r.label == "odd" for r in drawn) < 140


def test_anchor_numbers(spark):
    _, nodes, _ = graphs(spark)
    rows = [("g004", ["n2", "n0"], [], 5), ("g003", ["none"], [2, 4], 4), ("g002", [], [], 3), ("g001", ["n1", "none"], [1], 2)]
    found = {r.graph_id: (r.anchors, r.numbers) for r in graphstore.anchor_numbers(spark.createDataFrame(rows, "graph_id string, anchors array<string>, anchor_index array<int>, num_nodes int"), nodes).collect()}
    assert found == {"g004": (["n2", "n0"], [2, 0]), "g003": (["1", "3"], [1, 3]), "g002": (["3"], [3]), "g001": (["n1", "none"], [1])}


def test_labelled_nodes(spark):
    _, nodes, _ = graphs(spark)
    wanted = spark.createDataFrame([("g004", "n2"), ("g004", "none")], "graph_id string, label string")
    assert [r.id for r in graphstore.labelled_nodes(nodes, wanted, strict=False).collect()] == [3]
    assert [r.id for r in graphstore.labelled_nodes(nodes, wanted.where(F.col("label") == "n2")).collect()] == [3]
    with pytest.raises(PySparkException, match="no node is labelled none"):
        graphstore.labelled_nodes(nodes, wanted).collect()
