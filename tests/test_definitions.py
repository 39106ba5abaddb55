"""Redefinitions across basic blocks and unused names, against a plain walk over graphs with loops."""

import random
import re

from pyspark.sql import functions as F

from loomgraph.operators import definitions


def programs(seed):
    """Definitions (graph_id, node, variable, block, position) and flow (graph_id, block, next) of random programs with loops."""
    rng = random.Random(seed)
    defs, flow, node = [], set(), 0
    for graph in range(6):
        blocks = rng.randint(1, 9)
        for b in range(blocks):
            for at in range(rng.choice([0, 0, 1, 2, 4])):
                node += 1
                defs.append((graph, node, rng.choice("xyz"), b, at))
            flow |= {(graph, b, rng.randrange(blocks)) for _ in range(rng.choice([0, 1, 2, 2]))}
    return defs, sorted(flow)


def plain_redefinitions(defs, flow):
    """From each definition on, walk node by node until the variable is defined again."""
    out = set()
    for graph, node, variable, block, at in defs:
        of_block = lambda b, g=graph, v=variable: sorted((p, n) for g2, n, v2, b2, p in defs if (g2, v2, b2) == (g, v, b))
        later = [n for p, n in of_block(block) if p > at]
        if later:
            out.add((graph, node, later[0]))
            continue
        todo, seen = [c for g, a, c in flow if (g, a) == (graph, block)], set()
        while todo:
            b = todo.pop()
            if b in seen:
                continue
            seen.add(b)
            if found := of_block(b):
                if found[0][1] != node:
                    out.add((graph, node, found[0][1]))
            else:
                todo += [c for g, a, c in flow if (g, a) == (graph, b)]
    return out


def frames(spark, defs, flow):
    return spark.createDataFrame(defs, "graph_id int, node int, variable string, block int, position int"), spark.createDataFrame(flow, "graph_id int, block int, next int")


def test_redefinitions_same_as_walk(spark):
    defs, flow = programs(1)
    got = {tuple(r) for r in definitions.all_redefinitions(*frames(spark, defs, flow)).collect()}
    assert got == plain_redefinitions(defs, flow) and len(got) > 10


def test_loop_and_killing_block(spark):
    # 0 -> 1 -> 2 -> 1 (loop), 2 -> 3; x in 0, 1 and 3; y in 0 alone
    defs = [(0, 1, "x", 0, 0), (0, 2, "y", 0, 1), (0, 3, "x", 1, 0), (0, 4, "x", 3, 0)]
    flow = [(0, 0, 1), (0, 1, 2), (0, 2, 1), (0, 2, 3)]
    d, f = frames(spark, defs, flow)
    assert {tuple(r) for r in definitions.all_redefinitions(d, f).collect()} == {(0, 1, 3), (0, 3, 4)}
    reached = {(r.variable, r.origin, r.block) for r in definitions.reached_blocks(d, f).collect()}
    assert reached == {("x", 0, 1), ("x", 1, 2), ("x", 1, 1), ("x", 1, 3)}


def test_without_flow(spark):
    d, f = frames(spark, [(0, 1, "x", 0, 0)], [(0, 0, 0)])
    assert definitions.all_redefinitions(d, f).count() == 0
    assert definitions.all_redefinitions(d.limit(0), f.limit(0)).count() == 0


def test_unused_names(spark):
    # expr: 10 good; 11 read; 12 replaced later by 13; 14 and 15 in a tuple, one read; 16 escapes; 17 foreign scope; 18 '_'; 19 For; 20 decorated; 21 dumped; 22 rebound; 23 two definitions, one of them read
    rows = []

    def add(expr, variable, block=0, scope=1, name="n", kind="Assign", parent=None, decorated=False):
        rows.append((0, len(rows) + 1, variable, block, len(rows), expr, scope, name, kind, parent, decorated))

    add(10, "a")
    add(11, "b")
    add(12, "c")
    add(13, "c", block=1)
    add(14, "d", kind="Tuple", parent=90)
    add(15, "e", kind="Tuple", parent=90)
    add(16, "f")
    add(17, "g", scope=2)
    add(18, "h", name="__")
    add(19, "i", kind="For")
    add(20, "j", decorated=True)
    add(21, "k", scope=3)
    add(22, "l")
    add(23, "m")
    add(23, "o")
    add(24, "p", kind="Tuple", parent=91)
    add(25, "q", kind="Tuple", parent=91)
    defs = spark.createDataFrame(rows, "graph_id int, node int, variable string, block int, position int, expr int, scope int, name string, parent_kind string, parent int, decorated boolean")
    flow = spark.createDataFrame([(0, 0, 1)], "graph_id int, block int, next int")
    variables = defs.select("graph_id", "variable").distinct().select("*", (F.col("variable") == "f").alias("escapes"), F.when(F.col("variable") == "k", 3).otherwise(1).alias("own_scope"))
    read = defs.where("expr in (11, 15) or variable = 'o'")
    dumping = spark.createDataFrame([(0, 3)], "graph_id int, scope int")
    shared = spark.createDataFrame([(0, "l")], "graph_id int, variable string")
    got = {r.expr for r in definitions.unused_names(defs, flow, variables, read, dumping, shared).collect()}
    assert got == {10, 13, 24, 25}
    assert {r.expr for r in definitions.unused_names(defs, flow, variables, read, dumping).collect()} == got | {22}


def test_leaked_uses(spark):
    # graph 1: 1 -> 2 -> 3 -> 4 -> 2 (loop), 5 apart; graph 2 has the same node numbers without flow
    flow = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 4, 2)], "graph_id int, src int, dst int")
    iterations = spark.createDataFrame([(1, "i", 7, 2), (1, "j", 7, 3), (2, "i", 7, 2)], "graph_id int, name string, scope int, node int")
    uses = spark.createDataFrame([(1, "i", 7, 4), (1, "i", 7, 2), (1, "i", 7, 1), (1, "i", 8, 3), (1, "i", 7, 5), (1, "j", 7, 4), (1, "k", 7, 4), (2, "i", 7, 4)], "graph_id int, name string, scope int, node int")
    got = sorted(tuple(r) for r in definitions.leaked_uses(iterations, uses, flow).collect())
    assert got == [(1, 2, 2), (1, 2, 4), (1, 3, 4)]


def test_search_at_once_and_in_rounds_agree(spark, monkeypatch):
    """Graphs whole in a group and graphs searched in rounds reach the same blocks; nulls are never reached."""
    rows = [(g, f"n{g}-{i}", "abc"[(i * 7 + g) % 3] if i != 5 else None, (i * i + g) % 11 if i != 8 else None, i) for g in range(6) for i in range(14)]
    defs = spark.createDataFrame([*rows, (None, "x", "a", 1, 1), (7, "y", "a", 1, 1), (7, "z", "a", 1, 2)], "graph_id long, node string, variable string, block long, position int")
    flow = [(g, b, n) for g in range(6) for b in range(11) for n in {(b + 1) % 11, (b * 3 + g) % 11}] + [(0, 3, None), (None, 1, 1), (9, 1, 1), (7, 1, 1)]
    flow = spark.createDataFrame(flow, "graph_id long, block long, next long")
    results = []
    for limit in (definitions.AT_ONCE, 30, 0):
        monkeypatch.setattr(definitions, "AT_ONCE", limit)
        results.append({(r.graph_id, r.variable, r.origin, r.block) for r in definitions.reached_blocks(defs, flow).where("block is not null").collect()})
        results.append({tuple(r) for r in definitions.reached_blocks(defs, flow, defining_only=True).collect()})
    assert results[0] and results[::2] == [results[0]] * 3 and results[1::2] == [results[1]] * 3
    at = {(r.graph_id, r.variable, r.block) for r in defs.collect()}
    assert results[1] == {r for r in results[0] if (r[0], r[1], r[3]) in at}


def test_unused_names_in_rounds_too(spark, monkeypatch):
    """The names found don't depend on how graphs are searched."""
    monkeypatch.setattr(definitions, "AT_ONCE", 0)
    test_unused_names(spark)


def test_unreplaced_is_what_has_no_redefinition(spark, monkeypatch):
    """Without making pairs: with loops, ties, nulls, nodes of several places, and however graphs are searched."""
    defs, flow = programs(2)
    odd = [(7, 900, "x", 0, 0), (7, 901, "x", 0, 0), (7, 902, "x", 0, 1), (7, 902, "x", 1, 0), (7, 902, "y", 2, 0), (7, 903, "y", 2, None), (7, 904, None, 2, 1), (7, 905, "x", None, 1), (7, 906, "z", 0, 1), (7, 906, "z", 1, 1), (8, None, "x", 0, 0), (8, 907, "x", 0, 1), (8, None, "x", 1, 1), (11, 908, "x", 0, 0)]
    links = [(7, 0, 1), (7, 1, 2), (7, 2, 0), (7, 2, None), (7, None, 1), (8, 0, 1), (9, 0, 1), (None, 0, 1)]
    d, f = frames(spark, defs + odd, flow + links)
    pairs = {(r.graph_id, r.definition) for r in definitions.all_redefinitions(d, f).collect()}
    want = sorted(map(repr, [tuple(r) for r in d.collect() if r.node is None or (r.graph_id, r.node) not in pairs]))
    assert 10 < len(want) < len(defs)
    for limit in (definitions.AT_ONCE, 12, 0):
        monkeypatch.setattr(definitions, "AT_ONCE", limit)
        assert sorted(repr(tuple(r)) for r in definitions.unreplaced_definitions(d, f).collect()) == want
    assert definitions.unreplaced_definitions(d.limit(0), f.limit(0)).count() == 0


def test_unused_names_read_definitions_few_times(spark, tmp_path, monkeypatch):
    """Definitions are read for the sizes of graphs, to be searched, and for the names; not once for every kind of pair."""
    row = "0L as graph_id, 1L as node, 'a' as variable, 0 as block, 0 as position, 1L as expr, 1L as scope, 'n' as name, 'Assign' as parent_kind, 1L as parent, false as decorated"
    spark.sql(f"select {row}").write.parquet(f"{tmp_path}/definitions")
    defs = spark.read.parquet(f"{tmp_path}/definitions")
    flow = spark.createDataFrame([(0, 0, 1)], "graph_id long, block int, next int")
    variables, nothing = spark.sql("select 0L as graph_id, 'a' as variable, 1L as own_scope, false as escapes"), spark.sql("select 0L as graph_id, 1L as node, 1L as scope").limit(0)
    plans, cut = [], definitions.cut
    monkeypatch.setattr(definitions, "cut", lambda df: (plans.append(df), cut(df))[1])
    plans.append(definitions.unused_names(defs, flow, variables, nothing, nothing))
    assert [tuple(r) for r in plans[-1].collect()] == [(0, 1, "a")]
    reads = sum(len(re.findall(r"Relation \[[^\]]*parent_kind#", df._jdf.queryExecution().optimizedPlan().toString())) for df in plans)
    assert 0 < reads <= 3
