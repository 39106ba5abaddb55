"""Registered queries of control flow, token graphs, streams and batches, each with the SQL that checks it where SQL can."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomgraph.functions import tokens
from loomgraph.operators import access, dataflow, definitions, graph, layout, pointers, propagation, sampling, tokengraphs, wordpieces
from loomgraph.queries import EDGES, WAYS, _edges, query
from loomgraph.sources import graphstore
from loomgraph.streaming import batching
from loomgraph.tables import shared_folder

# control flow: the events of a user are a program, its active days are basic blocks, types of events are variables

DAYS = """days AS (SELECT user_id AS graph_id, CAST(ts AS DATE) AS block, count(*) AS n FROM events GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY block) AS i FROM days),
flow AS (SELECT DISTINCT a.graph_id, a.block, b.block AS next FROM numbered a JOIN numbered b ON a.graph_id = b.graph_id
         AND (b.i = a.i + 1 OR (b.i = a.i + 2 AND a.n % 2 = 0) OR (a.i % 5 = 0 AND b.i = a.i - 3))),
defs AS (SELECT user_id AS graph_id, event_id AS node, event_type AS variable, CAST(ts AS DATE) AS block, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events),
halts AS (SELECT DISTINCT graph_id, variable, block FROM defs),
several AS (SELECT graph_id, variable FROM defs GROUP BY 1, 2 HAVING count(*) > 1),
reach(graph_id, variable, origin, block) AS (SELECT h.graph_id, h.variable, h.block, f.next FROM halts h JOIN several USING (graph_id, variable) JOIN flow f ON f.graph_id = h.graph_id AND f.block = h.block
    UNION SELECT r.graph_id, r.variable, r.origin, f.next FROM reach r JOIN flow f ON f.graph_id = r.graph_id AND f.block = r.block
    WHERE NOT EXISTS (SELECT 1 FROM halts h WHERE h.graph_id = r.graph_id AND h.variable = r.variable AND h.block = r.block)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY graph_id, variable, block ORDER BY position) AS up, row_number() OVER (PARTITION BY graph_id, variable, block ORDER BY position DESC) AS down FROM defs),
redefs AS (SELECT a.graph_id, a.node AS definition, b.node AS redefinition FROM ranked a JOIN ranked b ON a.graph_id = b.graph_id AND a.variable = b.variable AND a.block = b.block AND b.up = a.up + 1
    UNION SELECT a.graph_id, a.node, b.node FROM ranked a JOIN reach r ON a.graph_id = r.graph_id AND a.variable = r.variable AND a.block = r.origin AND a.down = 1
    JOIN ranked b ON b.graph_id = r.graph_id AND b.variable = r.variable AND b.block = r.block AND b.up = 1 WHERE a.node <> b.node)"""


def _control_flow(spark, sf_dir):
    """Definitions and successors of the users' programs: the next active day follows, the second next after an even number of events, and every fifth day loops three days back."""
    from pyspark.sql import Window

    events = graph.load(spark, sf_dir, "events")["events"]
    defs = events.select(F.col("user_id").alias("graph_id"), F.col("event_id").alias("node"), F.col("event_type").alias("variable"), F.to_date("ts").alias("block"), "ts", "value")
    # placed by graph_id, the name that later steps group by, so that they find the rows where they are
    defs = defs.withColumn("position", F.row_number().over(Window.partitionBy("graph_id").orderBy("ts", "node"))).drop("ts")
    days = defs.groupBy("graph_id", "block").agg(F.count("*").alias("n")).withColumn("i", F.row_number().over(Window.partitionBy("graph_id").orderBy("block")))
    by = Window.partitionBy("graph_id").orderBy("block")
    ahead = F.array(F.lead("block").over(by), F.when(F.col("n") % 2 == 0, F.lead("block", 2).over(by)), F.when(F.col("i") % 5 == 0, F.lag("block", 3).over(by)))
    flow = days.select("graph_id", "block", ahead.alias("ahead")).select("graph_id", "block", F.explode("ahead").alias("next")).where("next is not null")
    return defs, flow.select("graph_id", "block", "next").distinct()


@query(f"WITH RECURSIVE {DAYS} SELECT graph_id, definition, redefinition FROM redefs")
def redefinitions_across_blocks(spark, sf_dir):
    return definitions.all_redefinitions(*_control_flow(spark, sf_dir))


#: An event's value stands for how a definition is used and written.
FACTS = {
    "expr": "node - node % 2",
    "read": "value < 30",
    "scope": "CASE WHEN value >= 97 THEN -1 ELSE graph_id END",
    "name": "CASE WHEN value >= 90 AND value < 93 THEN '_' ELSE variable END",
    "parent_kind": "CASE WHEN value < 60 THEN 'Assign' WHEN value < 85 THEN 'Tuple' ELSE CASE WHEN value < 95 THEN 'AugAssign' ELSE 'For' END END",
    "parent": "CAST(position AS BIGINT) - CAST(position AS BIGINT) % 2",
    "decorated": "value >= 88 AND value < 89",
}


@query(
    f"""WITH RECURSIVE {DAYS}, facts AS (SELECT *, {", ".join(f"{sql} AS {name}" for name, sql in FACTS.items())} FROM (SELECT defs.*, value FROM defs JOIN events ON event_id = node)),
escaping AS (SELECT graph_id, variable FROM facts GROUP BY 1, 2 HAVING max(value) > 99.5),
marked AS (SELECT *, NOT read AND scope = graph_id AND (graph_id, variable) NOT IN (SELECT graph_id, variable FROM escaping) AND graph_id % 40 <> 0 AND parent_kind IN ('Assign', 'AugAssign', 'Tuple') AND name <> '_' AND NOT decorated
    AND (graph_id, node) NOT IN (SELECT graph_id, definition FROM redefs) AND NOT (variable = 'view' AND graph_id % 3 = 0) AS good FROM facts),
names AS (SELECT graph_id, expr, bool_and(good) AS unused, min(variable) AS variable, max(CASE WHEN parent_kind = 'Tuple' THEN parent END) AS tuple FROM marked GROUP BY 1, 2)
SELECT graph_id, expr, variable FROM names WHERE unused AND (tuple IS NULL OR (graph_id, tuple) NOT IN (SELECT graph_id, tuple FROM names WHERE NOT unused AND tuple IS NOT NULL))"""
)
def unused_names(spark, sf_dir):
    defs, flow = _control_flow(spark, sf_dir)
    facts = defs.select("*", *[F.expr(sql).alias(name) for name, sql in FACTS.items()])
    variables = facts.groupBy("graph_id", "variable").agg((F.max("value") > 99.5).alias("escapes")).withColumn("own_scope", F.col("graph_id"))
    dumping = facts.where("graph_id % 40 = 0").select("graph_id", F.col("graph_id").alias("scope")).distinct()
    shared = facts.where("variable = 'view' and graph_id % 3 = 0").select("graph_id", "variable").distinct()
    return definitions.unused_names(facts, flow, variables, facts.where("read"), dumping, shared)


# propagation: each vector is a node, its edges go to the node of a third of its number; weights follow a rule

ROUNDS, SIZE, TYPES = 3, 64, 2


def _weight(layer: int, kind: int, i, j):
    """Entry (i, j) of a layer's matrix; kind 0 and 1 for edge types, 2 and 3 for the halves of the merging layer, 4 for the readout."""
    return ((7 * i + 3 * j + 5 * layer + 2 * kind) % 11 - 5) / 100


def _rounds() -> list[propagation.Round]:
    i, j = np.indices((SIZE, SIZE))
    matrix = lambda layer, kind: _weight(layer, kind, i, j)
    bias = np.arange(SIZE) % 3 / 10
    return [propagation.Round([propagation.Dense(matrix(r, k), bias) for k in range(TYPES)], propagation.Dense(np.concatenate([matrix(r, 2), matrix(r, 3)], axis=1), -bias)) for r in range(ROUNDS)]


def _propagated(spark, sf_dir):
    e = graph.load(spark, sf_dir, "embeddings")["embeddings"]
    states = e.select(F.col("vec_id").alias("node"), F.transform("embedding", lambda v: v.cast("double")).alias("state"))
    edges = e.select(F.col("vec_id").alias("src"), F.floor(F.col("vec_id") / 3).alias("dst"), F.pmod("vec_id", F.lit(2)).cast("int").alias("type"))
    return propagation.propagate(states, edges, _rounds(), SIZE)


def _propagation_sql() -> str:
    weight = lambda layer, kind, i, j: f"((7 * {i} + 3 * {j} + 5 * {layer} + 2 * {kind}) % 11 - 5) / 100.0"
    parts = [
        f"d AS (SELECT CAST(unnest(range(0, {SIZE})) AS INT) AS i)",
        "m AS (SELECT vec_id AS src, vec_id // 3 AS dst, CAST(vec_id % 2 AS INT) AS type FROM embeddings)",
        "h0 AS MATERIALIZED (SELECT vec_id AS node, CAST(unnest(range(0, len(embedding))) AS INT) AS dim, tanh(CAST(unnest(embedding) AS DOUBLE)) AS v FROM embeddings)",
    ]
    for r in range(ROUNDS):
        parts += [
            f"s{r} AS MATERIALIZED (SELECT dst AS node, type, dim, sum(v) AS v, count(*) AS n FROM m JOIN h{r} ON node = src GROUP BY 1, 2, 3)",
            f"t{r} AS (SELECT node, k.type, i, tanh(coalesce(sum(v * ({weight(r, 'k.type', 'i', 'dim')})), 0) + coalesce(max(n), 0) * (i % 3) / 10.0) AS v FROM (SELECT node, type, i FROM (SELECT DISTINCT node FROM h0), (SELECT unnest([0, 1]) AS type), d) k LEFT JOIN s{r} USING (node, type) GROUP BY 1, 2, 3)",
            f"g{r} AS (SELECT node, d.i, sum(v * ({weight(r, '(2 + type)', 'd.i', 't.i')})) AS v FROM t{r} t, d GROUP BY 1, 2)",
            f"h{r + 1} AS MATERIALIZED (SELECT h.node, dim, tanh(h.v + g.v - (dim % 3) / 10.0) AS v FROM h{r} h JOIN g{r} g ON h.node = g.node AND h.dim = g.i)",
        ]
    return ", ".join(parts)


@query(f"WITH {_propagation_sql()} SELECT node, dim, round(v, 6) AS value FROM h{ROUNDS}")
def propagated_states(spark, sf_dir):
    last = _propagated(spark, sf_dir).where(F.col("level") == ROUNDS)
    return last.select("node", F.posexplode("state").alias("dim", "value")).select("node", "dim", F.round("value", 6).alias("value"))


@query(
    f"WITH {_propagation_sql()}, l AS ({' UNION ALL '.join(f'SELECT {r} AS level, * FROM h{r}' for r in range(ROUNDS + 1))}), p AS (SELECT label, level, dim, max(v) AS v FROM l JOIN embeddings ON vec_id = node GROUP BY 1, 2, 3) "
    "SELECT label AS graph, dim, round(avg(v), 6) AS value FROM p GROUP BY 1, 2"
)
def readout_across_rounds(spark, sf_dir):
    members = graph.load(spark, sf_dir, "embeddings")["embeddings"].select(F.col("vec_id").alias("node"), F.col("label").alias("graph"))
    found = propagation.readout(_propagated(spark, sf_dir), members, ROUNDS, SIZE, propagation.Readout(nodes="max", rounds="mean"))
    return found.select("graph", F.posexplode("state").alias("dim", "value")).select("graph", "dim", F.round("value", 6).alias("value"))


# walks made on access: all places of one epoch over the suppliers

EPOCH, EACH, STEPS = 2, 20, (4, 8)


def _epoch_sql() -> str:
    low, high = STEPS
    number = lambda *x: f"CAST(('0x' || substr(md5('e|' || epoch || '|' || position || '|' || walk || '|' || {' || '.join(x)}), 1, 13)) AS BIGINT)"
    parts = [
        f"{EDGES}, {WAYS}",
        "o AS (SELECT src, dst, list_sort(list(DISTINCT label)) AS labels, CASE WHEN dst LIKE 'nation(%' THEN 5 ELSE 1 END AS w FROM ways GROUP BY src, dst)",
        "t AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY src ORDER BY dst) - w AS low, sum(w) OVER (PARTITION BY src) AS total FROM o)",
        f"p AS (SELECT {EPOCH} AS epoch, row_number() OVER (ORDER BY md5('e|{EPOCH}|' || a), a) - 1 AS position, a FROM (SELECT 'supplier(' || s_suppkey || ')' AS a FROM supplier))",
        f"s0 AS MATERIALIZED (SELECT epoch, position, walk, {low} + {number(repr('length'))} % {high - low + 1} AS length, a AS node, CAST(NULL AS VARCHAR) AS label, CAST([] AS VARCHAR[]) AS used, true AS moved FROM p, (SELECT unnest(range(1, {EACH + 1})) AS walk))",
    ]
    for i in range(1, high + 1):
        parts += [
            f"d{i} AS MATERIALIZED (SELECT s.*, {number(repr(f'{i}|node'))} AS draw, {number(repr(f'{i}|edge'))} AS edge FROM s{i - 1} s WHERE length >= {i})",
            f"n{i} AS (SELECT d.*, dst, labels[edge % len(labels) + 1] AS took FROM d{i} d JOIN (SELECT DISTINCT src, total FROM t) z ON z.src = node JOIN t ON t.src = node AND draw % z.total >= t.low AND draw % z.total < t.low + t.w)",
            f"k{i} AS (SELECT *, least(node, dst) || ' ' || greatest(node, dst) || ' ' || took AS name FROM n{i})",
            f"s{i} AS MATERIALIZED (SELECT epoch, position, walk, length, CASE WHEN list_contains(used, name) THEN node ELSE dst END AS node, took AS label, CASE WHEN list_contains(used, name) THEN used ELSE list_append(used, name) END AS used, NOT list_contains(used, name) AS moved FROM k{i})",
        ]
    union = " UNION ALL ".join(f"SELECT epoch, position, walk, {i} AS step, node, label FROM s{i} WHERE moved" for i in range(high + 1))
    return f"WITH {', '.join(parts)} {union}"


@query(_epoch_sql())
def walks_of_an_epoch(spark, sf_dir):
    anchors = graph.load(spark, sf_dir, "supplier")["supplier"].select(graph.node_label("supplier", F.col("s_suppkey")).alias("anchor"))
    tickets = access.ticket_table(_edges(spark, sf_dir), ("nation",))
    return access.walks_at(tickets, access.epoch_order(anchors, "anchor", EPOCH, "e"), "anchor", EACH, STEPS, "e")


# stores of graphs: a conversation is a graph, its turns are nodes, edges go on to the next turn and back to the role's last

TALK = """t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id, role, length(text) AS size FROM conversations),
e AS (SELECT conv_id, id AS src, id + 1 AS dst, 'next' AS label FROM t QUALIFY lead(id) OVER (PARTITION BY conv_id ORDER BY id) IS NOT NULL
      UNION ALL SELECT conv_id, id, lag(id) OVER (PARTITION BY conv_id, role ORDER BY id), 'role' FROM t QUALIFY lag(id) OVER (PARTITION BY conv_id, role ORDER BY id) IS NOT NULL),
g AS (SELECT conv_id, n.c AS num_nodes, coalesce(m.c, 0) AS num_edges FROM (SELECT conv_id, count(*) AS c FROM t GROUP BY 1) n LEFT JOIN (SELECT conv_id, count(*) AS c FROM e GROUP BY 1) m USING (conv_id)),
i AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS index, num_nodes, num_edges, CAST(sum(num_nodes) OVER (ORDER BY conv_id) - num_nodes AS BIGINT) AS node_offset, CAST(sum(num_edges) OVER (ORDER BY conv_id) - num_edges AS BIGINT) AS edge_offset FROM g)"""
PER_BLOCK = 500


def _talk(spark, sf_dir):
    from pyspark.sql import Window

    rows = graph.load(spark, sf_dir, "conversations")["conversations"]
    turn = Window.partitionBy("conv_id").orderBy("turn")
    nodes = rows.select(F.col("conv_id").alias("graph_id"), F.row_number().over(turn).alias("id"), "role", F.length("text").alias("size"))
    following, role = Window.partitionBy("graph_id").orderBy("id"), Window.partitionBy("graph_id", "role").orderBy("id")
    ends = nodes.select("graph_id", F.col("id").alias("src"), F.lead("id").over(following).alias("next"), F.lag("id").over(role).alias("role"))
    edges = [ends.select("graph_id", "src", F.col(c).alias("dst"), F.lit(c).alias("label")).where("dst is not null") for c in ("next", "role")]
    return nodes.select("graph_id").distinct(), nodes, edges[0].unionByName(edges[1])


@query(f"WITH {TALK} SELECT conv_id AS graph_id, index, num_nodes, num_edges, node_offset, edge_offset FROM i")
def graph_index(spark, sf_dir):
    return graphstore.graph_index(*_talk(spark, sf_dir), PER_BLOCK).select("graph_id", "index", "num_nodes", "num_edges", "node_offset", "edge_offset")


@query(
    f"""WITH {TALK}, w AS (SELECT index AS draw, CAST(('0x' || substr(md5('w|' || index), 1, 7)) AS BIGINT) % (SELECT count(*) FROM i) AS index FROM i),
n AS (SELECT draw, sum(size * (id - 1)) AS node_sum FROM w JOIN i USING (index) JOIN t USING (conv_id) GROUP BY 1), m AS (SELECT draw, sum((src - 1) * 7 + dst - 1) AS edge_sum FROM w JOIN i USING (index) JOIN e USING (conv_id) GROUP BY 1)
SELECT draw, index, conv_id AS graph_id, CAST(node_sum AS BIGINT) AS node_sum, CAST(coalesce(edge_sum, 0) AS BIGINT) AS edge_sum FROM w JOIN i USING (index) JOIN n USING (draw) LEFT JOIN m USING (draw)"""
)
def graphs_by_index(spark, sf_dir):
    """A store is written and as many graphs as it holds are fetched in a drawn order, with replacement."""
    folder = shared_folder(spark, "store")
    graphstore.write_store(*_talk(spark, sf_dir), folder, PER_BLOCK)
    store = graphstore.GraphStore(spark, folder)
    drawn = F.pmod(sampling.draw(F.lit("w"), F.col("draw").cast("string")), F.lit(len(store)))
    wanted = store.index().select(F.col("index").alias("draw")).withColumn("index", drawn)
    found, nodes, edges = store.fetch(wanted)
    n = nodes.groupBy("draw").agg(F.sum(F.col("size") * F.col("id")).alias("node_sum"))
    m = edges.groupBy("draw").agg(F.sum(F.col("src") * 7 + F.col("dst")).alias("edge_sum"))
    return found.join(n, "draw").join(m, "draw", "left").select("draw", "index", "graph_id", "node_sum", F.coalesce("edge_sum", F.lit(0)).alias("edge_sum"))


# tokens: every text is lexed, split by kind, given ids and places, and put together again

SPELLINGS = r"regexp_extract_all(text, '#[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|\n|[ \t\r\f\x0B]+|[0-9]+(?:\.[0-9]+)?|[\pL_][\pL\pM\p{Nd}_]*|(?s:.)')"
RESERVED = ("the", "and", "of", "de", "la", "und", "der")


def _spoken(spark, sf_dir):
    return graph.load(spark, sf_dir, "conversations")["conversations"].select("conv_id", "turn", "text").withColumn("tokens", tokens.lexed(F.col("text")))


@query(f"SELECT conv_id, turn, CAST(len({SPELLINGS}) AS BIGINT) AS n_tokens, CAST(len(list_filter({SPELLINGS}, lambda s: s IN {RESERVED})) AS BIGINT) AS n_reserved, sha256(text) AS digest FROM conversations")
def pieces_by_kind(spark, sf_dir):
    rows = _spoken(spark, sf_dir).withColumn("tokens", tokens.conditioned(F.col("tokens"), reserved=RESERVED))
    rows = rows.withColumn("pieces", tokens.pieces(F.col("tokens")))
    back = F.array_join(tokens.whole_tokens(F.col("pieces").getField("spelling")), "")
    n_reserved = F.size(F.filter("tokens", lambda t: t.kind == "KEYWORD"))
    ended = F.size(F.filter("pieces", lambda p: p["last"])).cast("long").alias("n_tokens")
    return rows.select("conv_id", "turn", ended, n_reserved.cast("long").alias("n_reserved"), F.sha2(back, 256).alias("digest"))


@query("SELECT conv_id, turn, sha256(text) AS digest FROM conversations")
def layout_from_places(spark, sf_dir):
    ended = F.concat("tokens", F.array(F.struct(F.lit("").alias("spelling"), F.lit("EOS").alias("kind"))))
    rows = _spoken(spark, sf_dir).select("conv_id", "turn", F.posexplode(ended).alias("pos", "t")).select("conv_id", "turn", "pos", "t.spelling", "t.kind")
    placed = layout.placed_tokens(rows, ["conv_id", "turn"]).where("kind not in ('WHITESPACE', 'NEWLINE')")
    return layout.laid_out(placed.select("conv_id", "turn", "pos", "spelling", "line", "column"), ["conv_id", "turn"]).select("conv_id", "turn", F.sha2("text", 256).alias("digest"))


@query("SELECT conv_id, turn, sha256(text) AS digest FROM conversations")
def texts_from_wordpieces(spark, sf_dir):
    rows = graph.cut(_spoken(spark, sf_dir).select("conv_id", "turn", tokens.pieces(F.col("tokens")).getField("spelling").alias("pieces")))
    vocabulary = wordpieces.build_vocabulary(rows.select(F.explode("pieces").alias("p")), "p", 2000)
    cut = wordpieces.in_sentences(wordpieces.with_ids(rows, "pieces", vocabulary), ["conv_id", "turn"], "ids", 128)
    found = wordpieces.texts_of_sentences(cut, ["conv_id", "turn"], vocabulary)
    return found.select("conv_id", "turn", F.sha2("text", 256).alias("digest"))


# token graphs, slots and pointers

KEPT, KINDS = "size >= 60", ("role", "next")


@query(
    f"""WITH {TALK}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id) - 1 AS number FROM t WHERE {KEPT}),
f AS (SELECT e.conv_id, CASE e.label WHEN 'role' THEN 0 ELSE 2 END AS type, a.number AS src, b.number AS dst FROM e JOIN k a ON a.conv_id = e.conv_id AND a.id = src JOIN k b ON b.conv_id = e.conv_id AND b.id = dst)
SELECT conv_id AS graph_id, CAST(type AS INT) AS type, CAST(src AS INT) AS src, CAST(dst AS INT) AS dst FROM f UNION ALL SELECT conv_id, CAST(type + 1 AS INT), CAST(dst AS INT), CAST(src AS INT) FROM f"""
)
def pruned_graphs(spark, sf_dir):
    _, nodes, edges = _talk(spark, sf_dir)
    kept = tokengraphs.pruned(nodes.withColumnRenamed("id", "pos"), F.expr(KEPT))
    return tokengraphs.renumbered_edges(edges.withColumnRenamed("label", "name"), kept, list(KINDS))


SLOTS = 40


@query(
    f"""WITH s AS (SELECT DISTINCT user_id, event_type FROM events), first AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2),
slot AS (SELECT user_id, event_type, dense_rank() OVER (PARTITION BY user_id ORDER BY first) - 1 AS slot FROM first),
p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('p|3|' || user_id || '|' || n), n) - 1 AS old, n AS new FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(0, {SLOTS})) AS n))
SELECT event_id, CAST(slot AS INT) AS slot, CAST(new AS INT) AS new_slot FROM events JOIN slot USING (user_id, event_type) JOIN p ON p.user_id = events.user_id AND old = slot"""
)
def permuted_slots(spark, sf_dir):
    slotted = dataflow.first_seen_ids(graph.load(spark, sf_dir, "events")["events"], ["user_id"], "event_id", "event_type")
    new = F.element_at(tokengraphs.slot_permutation(F.col("user_id"), 3, SLOTS, "p"), F.col("slot") + 1)
    return slotted.select("event_id", "slot", new.alias("new_slot"))


@query("SELECT CAST(least(max(n), 100) AS BIGINT) AS n_slots FROM (SELECT count(DISTINCT event_type) AS n FROM events GROUP BY user_id)")
def most_variables(spark, sf_dir):
    e = graph.load(spark, sf_dir, "events")["events"]
    return tokengraphs.most_variables(e.select(F.col("user_id").alias("graph_id"), F.col("event_type").alias("variable"))).select(F.col("n_slots").cast("long").alias("n_slots"))


POINTED = """v AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(unnest(list_reverse(embedding)) AS DOUBLE) AS y, unnest(range(0, len(embedding))) AS i, CASE WHEN vec_id % 4 = 0 THEN 0 ELSE label END AS error, 20 + vec_id % 45 AS size FROM embeddings),
l AS (SELECT vec_id, arg_max(i, (x, -i)) AS best, max(x) AS top FROM v WHERE i < size GROUP BY 1),
e AS (SELECT vec_id, sum(CASE WHEN i = error THEN exp(x - top) ELSE 0 END) / sum(exp(x - top)) AS error_mass FROM v JOIN l USING (vec_id) WHERE i < size GROUP BY 1),
c AS (SELECT vec_id, max(y) AS top FROM v WHERE (vec_id + i) % 3 = 0 AND vec_id % 50 <> 7 GROUP BY 1),
t AS (SELECT vec_id, sum(CASE WHEN (vec_id + i) % 9 < 6 AND vec_id % 10 <> 0 THEN exp(y - top) ELSE 0 END) / sum(exp(y - top)) AS target_mass FROM v JOIN c USING (vec_id) WHERE (vec_id + i) % 3 = 0 GROUP BY 1),
p AS (SELECT vec_id, CAST(error > 0 AS INT) AS buggy, CAST(best = error AS INT) AS hit, error_mass, coalesce(target_mass, 0) AS target_mass FROM (SELECT DISTINCT vec_id, error FROM v) JOIN l USING (vec_id) JOIN e USING (vec_id) LEFT JOIN t USING (vec_id))"""


def _pointed(spark, sf_dir):
    e = graph.load(spark, sf_dir, "embeddings")["embeddings"]
    places = F.transform("embedding", lambda _, i: i)
    rows = e.select(
        "vec_id",
        F.col("embedding").alias("locations"),
        F.reverse("embedding").alias("repairs"),
        (20 + F.col("vec_id") % 45).cast("int").alias("size"),
        F.when(F.col("vec_id") % 4 == 0, 0).otherwise(F.col("label")).alias("error"),
        F.when(F.col("vec_id") % 10 != 0, F.filter(places, lambda i: (F.col("vec_id") + i) % 9 < 6)).alias("targets"),
        F.when(F.col("vec_id") % 50 != 7, F.filter(places, lambda i: (F.col("vec_id") + i) % 3 == 0)).alias("candidates"),
    )
    return pointers.pointed(rows, "locations", "repairs", "size", "error", "targets", "candidates")


@query(f"WITH {POINTED} SELECT vec_id, buggy, hit, round(error_mass, 8) AS error_mass, round(target_mass, 8) AS target_mass FROM p")
def pointer_mass(spark, sf_dir):
    return _pointed(spark, sf_dir).select("vec_id", "buggy", "hit", F.round("error_mass", 8).alias("error_mass"), F.round("target_mass", 8).alias("target_mass"))


@query(
    f"""WITH {POINTED}, q AS (SELECT *, CAST(target_mass >= 0.5 AS INT) AS repaired FROM p)
SELECT round(avg(-ln(error_mass + 1e-9)), 6) AS location_loss, round(sum(-ln(target_mass + 1e-9) * buggy) / (1e-9 + sum(buggy)), 6) AS target_loss, round(sum(hit * (1 - buggy)) / (1e-9 + sum(1 - buggy)), 6) AS sound_accuracy,
       round(sum(hit * buggy) / (1e-9 + sum(buggy)), 6) AS location_accuracy, round(sum(repaired * buggy) / (1e-9 + sum(buggy)), 6) AS repair_accuracy, round(sum(hit * repaired * buggy) / (1e-9 + sum(buggy)), 6) AS joint_accuracy FROM q"""
)
def pointer_metrics(spark, sf_dir):
    found = pointers.pointer_metrics(_pointed(spark, sf_dir))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


# reachability over branching graphs, and batches from buffers


@query(
    f"""WITH RECURSIVE {TALK}, f AS (SELECT conv_id, least(src, dst) AS src, greatest(src, dst) AS dst FROM e),
h AS (SELECT a.conv_id, a.id AS origin, b.id AS node FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.role = b.role AND b.size < a.size),
r(conv_id, origin, node) AS (SELECT conv_id, src, dst FROM f UNION SELECT r.conv_id, origin, dst FROM r JOIN f ON f.conv_id = r.conv_id AND f.src = r.node
   WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.conv_id = r.conv_id AND h.origin = r.origin AND h.node = r.node))
SELECT conv_id AS graph_id, CAST(origin AS INT) AS origin, count(*) AS n_reached FROM r GROUP BY 1, 2"""
)
def reached_before_shorter(spark, sf_dir):
    """Turns that a turn leads to (by the next turn or the role's next) without passing a shorter one of its role."""
    _, nodes, edges = _talk(spark, sf_dir)
    at = lambda c: F.struct("graph_id", F.col(c).alias("id"))
    ahead = edges.select(F.struct("graph_id", F.least("src", "dst").alias("id")).alias("src"), F.struct("graph_id", F.greatest("src", "dst").alias("id")).alias("dst"))
    starts = nodes.select(at("id").alias("origin"), at("id").alias("node"))
    other = nodes.select("graph_id", "role", F.col("id").alias("other"), F.col("size").alias("other_size"))
    stops = nodes.join(other, ["graph_id", "role"]).where("other_size < size").select(at("id").alias("origin"), at("other").alias("node"))
    found = graph.reaches_without(ahead, starts, stops).groupBy("origin").agg(F.count("*").alias("n_reached"))
    return found.select("origin.graph_id", F.col("origin.id").alias("origin"), "n_reached")


@query()
def buffered_batches(spark, sf_dir):
    docs = graph.load(spark, sf_dir, "documents")["documents"].select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), " ")).alias("length"))
    parts = max(8, docs.select("doc_id").count() // 2000)  # buffers grow in number with the table, not in size
    keyed = docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    return batching.buffered_batches(keyed, "part", "doc_id", "doc_id", "length", batching.Rules(longest=None))


@query(f"WITH {EDGES} SELECT src, dst, label, row_number() OVER (ORDER BY dst, src, label) - 1 AS number FROM edges")
def edges_by_target(spark, sf_dir):
    return graph.edges_by_target(_edges(spark, sf_dir))
