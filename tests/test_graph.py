"""Tuple graphs and graph queries on small hand-made inputs."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import graph, programs, quantified, walks
from loomgraph.plans import joinspec, relations


def test_links_of_programs():
    links = relations.program_links()
    assert len(links) == 88
    assert len([r for r in relations.COLUMNS if r not in relations.AUXILIARY]) == 41
    assert {x.left for x in links} | {x.right for x in links} <= set(relations.COLUMNS)
    assert relations.schema("py_strs").simpleString() == "struct<id:string,parent:bigint,idx:int>"


def brute_edges(rows, links):
    """rows: (rel, {column: value}); pairs of rows for each link, with the number of distinct key values both have."""
    keys = joinspec.key_columns(links)
    found = {}
    for x in links:
        for a in rows:
            for b in rows:
                if a[0] == x.left and b[0] == x.right and a is not b and a[1][x.left_column] == b[1][x.right_column]:
                    shared = {a[1][c] for c in keys[a[0]]} & {b[1][c] for c in keys[b[0]]}
                    found[frozenset([str(a), str(b)]), x.label] = len(shared)
    return found


def test_tuple_edges(spark):
    columns = {"a": ["id", "parent"], "b": ["id", "up", "name"]}
    links = [joinspec.link("a.parent <-> b.id"), joinspec.link("b.up <----> b.id"), joinspec.link("a.id <-> b.up")]
    data = {"a": [(1, 10), (2, 10), (10, 11), (2, 10)], "b": [(10, 1, "x"), (11, 10, "x,y"), (12, 12, None)]}
    frames = {r: spark.createDataFrame([(7, *row) for row in data[r]], "graph_id int, " + ", ".join(f"{c} {'string' if c == 'name' else 'int'}" for c in columns[r])) for r in data}
    nodes = graph.tuple_nodes(frames, columns)
    assert nodes.count() == 6
    assert {r.label: r.dup_count for r in nodes.collect()}["a(2,10)"] == 2
    edges = graph.tuple_edges(nodes, joinspec.spec_table(spark, links, columns), links, columns, multiplicity=True)
    rows = [(r, dict(zip(columns[r], map(str, row), strict=True))) for r in data for row in dict.fromkeys(data[r])]
    want = brute_edges(rows, links)
    assert edges.count() == len(want)
    assert sorted(r.multiplicity for r in edges.collect()) == sorted(want.values())


def chain(spark, *pairs):
    return spark.createDataFrame([(a, b, f"({a},{b})") for a, b in pairs], "src string, dst string, label string")


def test_paths_and_levels(spark):
    edges = chain(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "d"), ("x", "y"))
    levels = {r.node: r.level for r in graph.bfs_levels(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert levels == {"a": 0, "b": 1, "e": 1, "c": 2, "d": 2}
    assert graph.shortest_path(edges, "a", "d").collect()[0].path == ["a", "e", "d"]
    assert graph.shortest_path(edges, "a", "x").count() == 0
    assert [r.node for r in graph.bfs_sample(edges, spark.createDataFrame([("a",)], "node string"), 3).orderBy("number").collect()] == ["a", "b", "e"]


def plain_reach(edges, starts, stops):
    after, found = {}, set()
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    for origin, first in starts:
        todo = set(after.get(first, ()))
        while todo:
            node = todo.pop()
            if (origin, node) not in found:
                found.add((origin, node))
                if (origin, node) not in stops:
                    todo |= after.get(node, set())
    return found


def test_reaches_without(spark):
    """Cycles, branches, repeated edges and stops, against a plain search; and a chain of more than 1001 events."""
    rng = random.Random(3)
    for ways in (1, 2):
        edges = [(i, rng.randrange(60)) for i in range(60) for _ in range(rng.choice([0, 1, 1, 1, ways]))]
        edges += [(100 + i, 101 + i) for i in range(40)] + [(140, 3), edges[0]]
        starts = [(o, rng.choice([o, 100, 120])) for o in range(60)]
        stops = {(o, rng.randrange(60)) for o in range(0, 60, 2) for _ in range(8)} | {(o, 110 + o % 20) for o in range(0, 60, 3)}
        got = graph.reaches_without(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame(starts, "origin int, node int"), spark.createDataFrame(sorted(stops), "origin int, node int")).collect()
        assert sorted((r.origin, r.node) for r in got) == sorted(plain_reach(edges, starts, stops))
    n = 1200
    line = spark.range(n).selectExpr("id as src", "id + 1 as dst")
    far = graph.reaches_without(line, spark.createDataFrame([(7, 0), (8, 0)], "origin long, node long"), spark.createDataFrame([(8, 1150)], "origin long, node long"))
    assert {r.origin: r["count"] for r in far.groupBy("origin").count().collect()} == {7: n, 8: 1150}


def test_ancestors_and_handlers(spark):
    parents = spark.createDataFrame([(2, 1), (3, 2), (4, 1)], "node int, parent int")
    found = {(r.node, r.ancestor, r.distance) for r in graph.ancestors(parents).collect()}
    assert found == {(2, 1, 1), (3, 2, 1), (4, 1, 1), (3, 1, 2)}
    handlers = spark.createDataFrame([(100, 1), (101, 4), (102, 3)], "id int, type int")
    names = spark.createDataFrame([(3, "HoleException"), (4, "KeyError")], "node int, name string")
    assert {r.id for r in programs.handler_holes(handlers, parents, names).collect()} == {100, 102}


def test_walk_invariants(spark):
    edges = chain(spark, *[(f"n({i})", f"n({(i * 7 + 3) % 12})") for i in range(12) if i != (i * 7 + 3) % 12], ("n(0)", "py_exprs(1)"), ("py_exprs(1)", "n(5)"))
    anchors = spark.createDataFrame([("n(0)",), ("n(5)",)], "anchor string")
    one = walks.random_walks(edges, anchors, 30, (4, 6), walks.FAVOURED, seed=1)
    again = walks.random_walks(edges.repartition(7), anchors.repartition(3), 30, (4, 6), walks.FAVOURED, seed=1)
    assert sorted(map(str, one.collect())) == sorted(map(str, again.collect()))
    pairs = {frozenset([r.src, r.dst]) for r in edges.collect()}
    for row in walks.as_arrays(one).collect():
        assert row.nodes[0] == row.anchor and len(row.labels) == len(row.nodes) - 1 > 0
        steps = [(frozenset(p), label) for p, label in zip(zip(row.nodes, row.nodes[1:], strict=False), row.labels, strict=True)]
        assert all(p in pairs for p, _ in steps)
        assert len({(tuple(sorted(p)), label) for p, label in steps}) == len(steps)
    padded = walks.padded_walks(walks.as_arrays(one), 40)
    assert {r["count"] for r in padded.groupBy("anchor").count().collect()} == {40}


def test_weights_of_walks(spark):
    edges = chain(spark, ("c(0)", "py_exprs(1)"), ("c(0)", "d(1)"))
    first = walks.random_walks(edges, spark.createDataFrame([("c(0)",)], "anchor string"), 3000, (1, 1), walks.FAVOURED).where("step = 1")
    heavy = first.where(F.col("node") == "py_exprs(1)").count()
    assert 0.80 < heavy / first.count() < 0.87


def test_quantifiers(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "k int, v int")
    ids = lambda df: sorted(r.k for r in df.collect())
    assert ids(quantified.for_all(left, right, ["k"], F.col("v") == 5)) == [2, 3]
    assert ids(quantified.for_all_and_some(left, right, ["k"], F.col("v") == 5)) == [2]
    assert ids(quantified.divided_by(right, right, "k", "v")) == [1]


def test_program_tasks(spark):
    exprs = spark.createDataFrame([(1, 10, 18, 5, 0), (1, 11, 18, 5, 1), (1, 12, 3, 5, 2), (2, 20, 18, 5, 0)], "graph_id int, id long, kind int, parent long, idx int")
    contexts = spark.createDataFrame([(1, 1, 1, 10), (1, 2, 4, 11), (1, 3, 3, 12), (2, 4, 5, 20), (2, 5, 1, 20)], "graph_id int, id long, kind int, parent long")
    unused = spark.createDataFrame([(1, 11)], "graph_id int, id long")
    labels = programs.definition_labels(exprs, contexts, unused)
    assert {(r.id, r.label) for r in labels.collect()} == {(10, "used"), (11, "unused"), (20, "used")}
    assert {(r.graph_id, r.label) for r in programs.program_labels(labels).collect()} == {(1, "unused"), (2, "used")}
    local = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "graph_id int, id long, name string")
    assert [r.id for r in programs.shadowing(local, spark.createDataFrame([(1, "a")], "graph_id int, name string")).collect()] == [1]


def test_syntax_graph(spark):
    df = programs.syntax_graph(spark.createDataFrame([(1, "x = 1\nprint(x)\n"), (2, "def ("), (3, None)], "k int, code string"), "k", "code")
    rows = df.collect()
    nodes = [r for r in rows if r.k == 1 and r.kind == "node"]
    edges = [r for r in rows if r.k == 1 and r.kind == "edge"]
    assert len(edges) == len(nodes) - 1 and nodes[0].name == "Module"
    assert {r.kind for r in rows if r.k == 2} == {"error"}
    children = df.where("k = 1 and kind = 'edge'").select(F.col("b").alias("node"), F.col("a").alias("parent"))
    assert {n.name for n in nodes if n.a in {r.node for r in programs.leaves(children).collect()}} == {"Name", "Constant"}


def test_offsets_over_ranges(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as size")
    total = 0
    for row in graph.running_offsets(df, "id", "size").orderBy("id").collect():
        assert row.offset == total
        total += row.size


def test_tree_relations(spark):
    df = programs.syntax_graph(spark.createDataFrame([("g", "def f(a):\n    if a:\n        return a\n    return 0\n")], "graph_id string, code string"), "graph_id", "code")
    nodes = df.where("kind = 'node'").select("graph_id", F.col("a").alias("node"), "name", "line", "column")
    children = df.where("kind = 'edge'").select("graph_id", F.col("b").alias("node"), F.col("a").alias("parent"))
    function = nodes.where("name = 'FunctionDef'").collect()[0].node
    back = programs.returns_to(nodes, children).collect()
    assert len(back) == 2 and {r.dst for r in back} == {function}
    assert len(programs.returns_to(nodes, children, depth=1).collect()) == 1
    guards = spark.createDataFrame([("g", 1, "a", 7)], "graph_id string, branch int, name string, condition int")
    inside = spark.createDataFrame([("g", 1, "a", 9), ("g", 1, "b", 10)], "graph_id string, branch int, name string, node int")
    assert [(r.src, r.dst, r.label) for r in programs.guarded_by(inside, guards).collect()] == [(9, 7, "GuardedBy")]
    edges = spark.createDataFrame([("g", 1, 2, "Child")], "graph_id string, src int, dst int, label string")
    assert {r.label: r.pairs for r in programs.categories(edges, ["Child", "LastUse"]).collect()} == {"Child": [[1, 2]], "LastUse": []}


def test_masks_symbols_sentences(spark):
    df = spark.createDataFrame([("x = x + y", 4, "x", "Add"), ("abc", 0, "z", "Foo")], "code string, at int, word string, op string")
    rows = df.select(programs.masked(F.col("code"), F.col("at"), F.col("word")).alias("m"), programs.operator_symbol(F.col("op")).alias("o")).collect()
    assert [(r.m, r.o) for r in rows] == [("x = ___CURR___ + y", "+"), ("abc", None)]
    toks = spark.createDataFrame([(1, 0, "NAME", "a"), (1, 1, "NEWLINE", "\n"), (1, 2, "NEWLINE", "\n"), (1, 3, "NAME", "b")], "doc int, pos int, kind string, spelling string")
    assert [r.tokens for r in programs.sentences(toks).orderBy("sentence").collect()] == [["a", "\n"], ["\n"], ["b"]]
    files = spark.createDataFrame([(1, "correct"), (2, "misuse"), (5, "correct")], "n int, kind string")
    assert [r.partner.n for r in programs.neighbouring_files(files, "n", "kind", "misuse").collect()] == [2]
