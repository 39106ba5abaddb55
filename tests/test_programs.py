"""The relations of whole programs, their graphs against graphs drawn of them, and the tasks on them."""

import collections
import csv
import os

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import definitions, graph, programs
from loomgraph.plans import joinspec
from loomgraph.plans import relations as R
from loomgraph.sources import programs as sources

HERE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")
GRAPH = [r for r in R.COLUMNS if r not in R.AUXILIARY]
#: Nodes, edges, and edges without repeats of the drawn graphs.
DRAWN = {"program1": (108, 175, 164), "program2": (648, 998, 982)}


def plain(program, relation):
    with open(f"{HERE}/{program}/{relation}.bqrs.csv", encoding="utf-8", newline="") as f:
        return list(csv.reader(f))[1:]


@pytest.fixture(scope="module")
def loaded(spark):
    return {p: sources.read_program(spark, f"{HERE}/{p}", wanted=list(R.COLUMNS)) for p in ("program1", "program2", "program3")}


@pytest.mark.parametrize("program", ["program1", "program2"])
def test_every_relation_is_read(loaded, program):
    """All rows, by position, with the types of the schema; files that hold a header alone are empty relations."""
    found = loaded[program]
    assert set(GRAPH) <= set(found)
    for name, df in found.items():
        rows = df.collect()
        assert df.schema[: len(R.COLUMNS[name])] == R.schema(name)
        want = [tuple(r) for r in plain(program, name)]
        assert collections.Counter(tuple(str(r[c]) for c in R.COLUMNS[name]) for r in rows) == collections.Counter(want), name
        assert {r.graph_id for r in rows} <= {program}


@pytest.fixture(scope="module")
def tuples(spark, loaded):
    """Nodes and edges of both programs at once, each a graph of its own."""
    columns = {r: R.COLUMNS[r] for r in GRAPH}
    relations = {r: loaded["program1"][r].unionByName(loaded["program2"][r]) for r in GRAPH}
    links = R.program_links()
    nodes = graph.tuple_nodes(relations, columns).cache()
    return nodes, graph.tuple_edges(nodes, joinspec.spec_table(spark, links, columns), links, columns, multiplicity=True).cache()


@pytest.mark.parametrize("program", sorted(DRAWN))
def test_graph_same_as_drawn(spark, tuples, program):
    nodes, edges = (df.where(F.col("graph_id") == program).drop("graph_id") for df in tuples)
    drawn_nodes, drawn_edges = sources.parse_dot(spark.read.text(f"{HERE}/{program}.gv"))
    n_nodes, n_edges, n_distinct = DRAWN[program]
    assert nodes.count() == drawn_nodes.count() == n_nodes
    assert sorted(r.label for r in nodes.collect()) == sorted(r.label for r in drawn_nodes.collect())

    def named(edges, nodes, times):
        label = {r.id: r.label for r in nodes.collect()}
        out = collections.Counter()
        for r in edges.collect():
            out[*sorted([label[r.src], label[r.dst]]), r.label] += times(r)
        return out

    got, want = named(edges, nodes, lambda r: r.multiplicity), named(drawn_edges, drawn_nodes, lambda r: 1)
    assert sum(want.values()) == n_edges and len(want) == n_distinct
    assert got == want


def test_labels_of_the_graph(tuples):
    nodes = tuples[0].where("graph_id = 'program2'")
    assert nodes.where("label like 'variable(%'").count() == 17
    stats = graph.graph_stats(nodes, tuples[1].where("graph_id = 'program2'")).first()
    assert (stats.n_nodes, stats.n_edges, stats.n_variables) == (648, 982, 17)


def plain_stored(program):
    stores = {r[2] for r in plain(program, "py_expr_contexts") if int(r[1]) in programs.STORE_KINDS}
    return {int(r[0]) for r in plain(program, "py_exprs") if int(r[1]) == programs.NAME_KIND and r[0] in stores}


@pytest.mark.parametrize("program", ["program1", "program2", "program3"])
def test_definitions_task(spark, loaded, program):
    t = loaded[program]
    assert {r.id for r in programs.stored_names(t["py_exprs"], t["py_expr_contexts"]).collect()} == plain_stored(program)
    marked = {int(r[0]) for r in plain(program, "unused_var")} if program == "program2" else set()
    unused = spark.createDataFrame([(program, i) for i in sorted(marked)], "graph_id string, id long")
    labels = {r.id: r.label for r in programs.definition_labels(t["py_exprs"], t["py_expr_contexts"], unused).collect()}
    assert labels == {i: "unused" if i in marked else "used" for i in plain_stored(program)}
    whole = programs.program_labels(programs.definition_labels(t["py_exprs"], t["py_expr_contexts"], unused)).collect()
    assert [(r.graph_id, r.label, r.anchors) for r in whole] == ([(program, "unused" if marked else "used", sorted(labels))] if labels else [])


def test_exception_task(loaded):
    t = loaded["program3"]
    holes = {tuple(r) for r in plain("program3", "except_hole")}
    want = {int(r[0]) for r in plain("program3", "py_stmts") if tuple(r) in holes}
    assert {r.id for r in programs.exception_anchors(t["py_stmts"], t["except_hole"]).collect()} == want and len(want) == 1


def flow_of(t):
    """Definitions and block successors of a program's control flow."""
    nodes = t["py_flow_bb_node"].select("graph_id", "flownode", "realnode", F.col("basicblock").alias("block"), F.col("index").alias("position"))
    stored = programs.stored_names(t["py_exprs"], t["py_expr_contexts"]).select("graph_id", F.col("id").alias("realnode"))
    names = t["py_variables"].select("graph_id", F.col("id").alias("variable"), F.col("parent").alias("realnode"))
    defs = nodes.join(stored, ["graph_id", "realnode"]).join(names, ["graph_id", "realnode"]).select("graph_id", F.col("flownode").alias("node"), "variable", "block", "position")
    of = lambda end: nodes.select("graph_id", F.col("flownode").alias(end), F.col("block").alias(f"{end}_block"))
    steps = t["py_successors"].join(of("predecessor"), ["graph_id", "predecessor"]).join(of("successor"), ["graph_id", "successor"])
    return defs, steps.where("predecessor_block <> successor_block or predecessor = successor").select("graph_id", F.col("predecessor_block").alias("block"), F.col("successor_block").alias("next")).distinct()


def test_redefinitions_in_a_program(loaded):
    """On the control flow of a real program, node by node: walk from a definition until its variable is defined again."""
    t = loaded["program3"]
    flow = [tuple(map(int, r)) for r in plain("program3", "py_flow_bb_node")]
    real, block = {f: e for f, e, _, _ in flow}, {f: b for f, _, b, _ in flow}
    inside = collections.defaultdict(list)
    for f, _, b, i in sorted(flow, key=lambda r: r[3]):
        inside[b].append(f)
    after = {a: {b} for nodes in inside.values() for a, b in zip(nodes, nodes[1:], strict=False)}  # nodes that were not recorded are passed over
    for a, b in (map(int, r) for r in plain("program3", "py_successors")):
        if a in block and b in block and (block[a] != block[b] or a == b):
            after.setdefault(inside[block[a]][-1], set()).add(inside[block[b]][0])
    variable = collections.defaultdict(set)
    stored = plain_stored("program3")
    for v, e in plain("program3", "py_variables"):
        if int(e) in stored:
            variable[int(e)].add(int(v))
    defined = {n: variable[e] for n, e in real.items() if variable[e]}
    want = set()
    for node, names in defined.items():
        for v in names:
            todo, seen = list(after.get(node, ())), set()
            while todo:
                n = todo.pop()
                if n in seen:
                    continue
                seen.add(n)
                if v in defined.get(n, ()):
                    if n != node:
                        want.add((node, n))
                else:
                    todo += after.get(n, ())
    got = {(r.definition, r.redefinition) for r in definitions.all_redefinitions(*flow_of(t)).collect()}
    assert got == want and len(want) > 0
