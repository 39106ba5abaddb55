"""Registered queries over the test tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import lexing, text
from loomgraph.operators import dataflow, graph, messages, metrics, quantified, sampling, vocabulary, walks
from loomgraph.plans import joinspec
from loomgraph.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
STAR = ("region", "nation", "customer", "supplier", "part", "orders")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _star(spark, sf_dir):
    return graph.load(spark, sf_dir, *STAR)


def _edges(spark, sf_dir, links=joinspec.STAR_LINKS):
    tables = _star(spark, sf_dir)
    return graph.star_edges(tables, joinspec.STAR_KEYS, links)


SMALL = joinspec.STAR_LINKS[:3]

NODES = """nodes AS (SELECT 'region' AS rel, CAST(r_regionkey AS BIGINT) AS key, 'region(' || r_regionkey || ')' AS label FROM region
UNION ALL SELECT 'nation', n_nationkey, 'nation(' || n_nationkey || ')' FROM nation UNION ALL SELECT 'customer', c_custkey, 'customer(' || c_custkey || ')' FROM customer
UNION ALL SELECT 'supplier', s_suppkey, 'supplier(' || s_suppkey || ')' FROM supplier UNION ALL SELECT 'part', p_partkey, 'part(' || p_partkey || ')' FROM part
UNION ALL SELECT 'orders', o_orderkey, 'orders(' || o_orderkey || ')' FROM orders)"""
SMALL_EDGES = """edges AS (SELECT 'nation(' || n_nationkey || ')' AS src, 'region(' || r_regionkey || ')' AS dst, '(nation.n_regionkey,region.r_regionkey)' AS label FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'customer(' || c_custkey || ')', 'nation(' || n_nationkey || ')', '(customer.c_nationkey,nation.n_nationkey)' FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'supplier(' || s_suppkey || ')', 'nation(' || n_nationkey || ')', '(nation.n_nationkey,supplier.s_nationkey)' FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
EDGES = SMALL_EDGES[:-1] + " UNION ALL SELECT 'orders(' || o_orderkey || ')', 'customer(' || c_custkey || ')', '(customer.c_custkey,orders.o_custkey)' FROM orders JOIN customer ON o_custkey = c_custkey)"
WAYS = "ways AS (SELECT src, dst, label FROM edges UNION ALL SELECT dst, src, label FROM edges)"
LEVELS = """RECURSIVE {edges}, {ways}, steps AS (SELECT DISTINCT src, dst FROM ways),
reach(node, level) AS (SELECT '{start}', 0 UNION SELECT dst, level + 1 FROM reach JOIN steps ON src = node WHERE level < {depth}),
levels AS (SELECT node, min(level) AS level FROM reach GROUP BY node)"""


def _levels(start: str, depth: int, edges: str = EDGES) -> str:
    return LEVELS.format(edges=edges, ways=WAYS, start=start, depth=depth)


# tuple graph


@query(f"WITH {NODES} SELECT rel, key, label FROM nodes")
def graph_nodes(spark, sf_dir):
    return graph.star_nodes(_star(spark, sf_dir), joinspec.STAR_KEYS)


@query(f"WITH {EDGES} SELECT src, dst, label FROM edges")
def graph_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(
    f"""WITH {EDGES} SELECT label, count(*) AS n_edges FROM edges GROUP BY label
UNION ALL SELECT '(lineitem.l_orderkey,orders.o_orderkey)', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT '(lineitem.l_partkey,part.p_partkey)', count(*) FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT '(lineitem.l_suppkey,supplier.s_suppkey)', count(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""
)
def graph_edge_counts(spark, sf_dir):
    tables = _star(spark, sf_dir) | graph.load(spark, sf_dir, "lineitem")
    return graph.edge_counts(tables, joinspec.STAR_LINKS + joinspec.LINE_LINKS)


SMALL_COLUMNS = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"]}


def _tuples(spark, sf_dir):
    tables = graph.load(spark, sf_dir, *SMALL_COLUMNS)
    relations = {r: tables[r].select(F.lit(0).alias("graph_id"), *SMALL_COLUMNS[r]) for r in SMALL_COLUMNS}
    nodes = graph.tuple_nodes(relations, SMALL_COLUMNS)
    return nodes, graph.tuple_edges(nodes, joinspec.spec_table(spark, SMALL, SMALL_COLUMNS), SMALL, SMALL_COLUMNS, multiplicity=True)


TUPLES = """n AS (SELECT 'region' AS rel, [CAST(r_regionkey AS VARCHAR)] AS vals FROM region UNION SELECT 'nation', [CAST(n_nationkey AS VARCHAR), CAST(n_regionkey AS VARCHAR)] FROM nation
UNION SELECT 'customer', [CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS VARCHAR)] FROM customer UNION SELECT 'supplier', [CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS VARCHAR)] FROM supplier),
nodes AS (SELECT rel, vals, rel || '(' || array_to_string(vals, ',') || ')' AS label FROM n),
keycol AS (SELECT * FROM (VALUES ('region', 1), ('nation', 1), ('nation', 2), ('customer', 2), ('supplier', 2)) AS t(rel, pos)),
spec AS (SELECT * FROM (VALUES ('nation', 2, 'region', 1, '(nation.n_regionkey,region.r_regionkey)'), ('customer', 2, 'nation', 1, '(customer.c_nationkey,nation.n_nationkey)'),
         ('supplier', 2, 'nation', 1, '(nation.n_nationkey,supplier.s_nationkey)')) AS t(lrel, lpos, rrel, rpos, label)),
kv AS (SELECT label AS node, rel, pos, vals[pos] AS v FROM nodes JOIN keycol USING (rel)),
e AS (SELECT DISTINCT a.node AS x, b.node AS y, s.label FROM kv a JOIN spec s ON a.rel = s.lrel AND a.pos = s.lpos JOIN kv b ON b.rel = s.rrel AND b.pos = s.rpos AND a.v = b.v),
edges AS (SELECT least(x, y) AS a, greatest(x, y) AS b, label, (SELECT count(DISTINCT k.v) FROM kv k JOIN kv l ON k.v = l.v WHERE k.node = x AND l.node = y) AS multiplicity FROM e)"""


@query(f"WITH {TUPLES} SELECT a, b, label, CAST(multiplicity AS BIGINT) AS multiplicity FROM edges")
def tuple_graph_multiplicity(spark, sf_dir):
    nodes, edges = _tuples(spark, sf_dir)
    name = lambda end: nodes.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    both = edges.join(name("src"), "src").join(name("dst"), "dst")
    return both.select(F.least("src_label", "dst_label").alias("a"), F.greatest("src_label", "dst_label").alias("b"), "label", "multiplicity")


@query(f"WITH {EDGES}, {WAYS}, d AS (SELECT src, count(DISTINCT dst) AS degree FROM ways GROUP BY src) SELECT degree, count(*) AS n_nodes FROM d GROUP BY degree")
def degree_histogram(spark, sf_dir):
    return graph.degree_histogram(_edges(spark, sf_dir))


@query(f"WITH {NODES}, {EDGES} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM nodes WHERE contains(label, 'part(')) AS n_variables")
def graph_stats(spark, sf_dir):
    return graph.graph_stats(graph.star_nodes(_star(spark, sf_dir), joinspec.STAR_KEYS), _edges(spark, sf_dir), variable="part(")


@query(f"WITH {_levels('region(0)', 2)} SELECT node, level FROM levels")
def k_hop(spark, sf_dir):
    return graph.bfs_levels(_edges(spark, sf_dir), spark.createDataFrame([("region(0)",)], "node string"), depth=2)


@query(f"WITH {_levels('nation(1)', 4)}, first AS (SELECT node, level, row_number() OVER (ORDER BY level, node) AS number FROM levels) SELECT node, level, CAST(number AS INT) AS number FROM first WHERE number <= 200")
def bfs_sample(spark, sf_dir):
    return graph.bfs_sample(_edges(spark, sf_dir), spark.createDataFrame([("nation(1)",)], "node string"), 200)


@query(
    f"WITH {_levels('nation(1)', 4)}, first AS (SELECT node FROM levels QUALIFY row_number() OVER (ORDER BY level, node) <= 200) "
    "SELECT src, dst, label FROM edges WHERE src IN (SELECT node FROM first) AND dst IN (SELECT node FROM first)"
)
def induced_sample(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.induced(edges, graph.bfs_sample(edges, spark.createDataFrame([("nation(1)",)], "node string"), 200))


@query(f"WITH {_levels('nation(5)', 6)} SELECT CAST(level AS INT) AS length FROM levels WHERE node = 'nation(0)'")
def shortest_path_length(spark, sf_dir):
    return graph.shortest_path(_edges(spark, sf_dir), "nation(0)", "nation(5)").select("length")


@query(f"WITH {EDGES}, l AS (SELECT label, 'e,' || dense_rank() OVER (ORDER BY label) AS code FROM (SELECT DISTINCT label FROM edges)) SELECT code, count(*) AS n FROM edges JOIN l USING (label) GROUP BY code")
def relabelled_edges(spark, sf_dir):
    return graph.relabel_edges(_edges(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES}, d AS (SELECT src AS node, count(*) AS degree FROM edges GROUP BY src) SELECT node, degree, CAST(sum(degree) OVER (ORDER BY node) - degree AS BIGINT) AS \"offset\" FROM d")
def csr_offsets(spark, sf_dir):
    return graph.csr_offsets(_edges(spark, sf_dir))


@query(f"WITH {EDGES}, t AS (SELECT src, dst, dense_rank() OVER (ORDER BY label) - 1 AS k FROM edges) SELECT src, dst, CAST(2 * k AS INT) AS type FROM t UNION ALL SELECT dst, src, CAST(2 * k + 1 AS INT) FROM t")
def reverse_edges(spark, sf_dir):
    edges = graph.relabel_edges(_edges(spark, sf_dir))
    return graph.reverse_typed(edges.select("src", "dst", (F.substring("code", 3, 9).cast("int") - 1).alias("type")))


@query(f"WITH {EDGES}, {WAYS}, s AS (SELECT DISTINCT src, dst FROM ways), w AS (SELECT src, dst, CAST(CASE WHEN dst LIKE 'nation(%' THEN 5 ELSE 1 END AS BIGINT) AS weight FROM s) SELECT src, dst, weight, CAST(sum(weight) OVER (PARTITION BY src) AS BIGINT) AS total_weight FROM w")
def transition_probabilities(spark, sf_dir):
    return walks.transition_probabilities(_edges(spark, sf_dir), ("nation",))


WALKS, STEPS = 20, (4, 8)


def _walks(spark, sf_dir):
    anchors = graph.load(spark, sf_dir, "supplier")["supplier"].select(graph.node_label("supplier", F.col("s_suppkey")).alias("anchor"))
    return walks.random_walks(_edges(spark, sf_dir), anchors, WALKS, STEPS, ("nation",), seed=3)


def _walk_sql() -> str:
    low, high = STEPS
    number = lambda x: f"CAST(('0x' || substr(md5({x}), 1, 7)) AS BIGINT)"
    parts = [f"{EDGES}, {WAYS}", "o AS (SELECT src, dst, list_sort(list(DISTINCT label)) AS labels, CASE WHEN dst LIKE 'nation(%' THEN 5 ELSE 1 END AS w FROM ways GROUP BY src, dst)"]
    parts.append(f"r AS (SELECT 'supplier(' || s_suppkey || ')' AS anchor, CAST(walk AS INT) AS walk FROM supplier, range(1, {WALKS + 1}) t(walk))")
    length = number("'3|' || anchor || '|' || walk || '|length'")
    parts.append(f"s0 AS (SELECT anchor, walk, {low} + {length} % {high - low + 1} AS length, anchor AS node, CAST(NULL AS VARCHAR) AS label, CAST([] AS VARCHAR[]) AS used, true AS moved FROM r)")
    for i in range(1, high + 1):
        parts.append(f"d{i} AS (SELECT anchor, walk, length, node AS origin, used, dst, labels, list_min(list_transform(range(1, w + 1), lambda t: md5('3|' || anchor || '|' || walk || '|{i}|' || dst || '|' || t))) AS draw FROM s{i - 1} JOIN o ON src = node WHERE length >= {i})")
        edge = number(f"'3|' || anchor || '|' || walk || '|{i}|edge'")
        parts.append(f"b{i} AS (SELECT *, labels[{edge} % len(labels) + 1] AS label FROM d{i} QUALIFY row_number() OVER (PARTITION BY anchor, walk ORDER BY draw, dst) = 1)")
        parts.append(f"n{i} AS (SELECT *, least(origin, dst) || ' ' || greatest(origin, dst) || ' ' || label AS name FROM b{i})")
        parts.append(f"s{i} AS (SELECT anchor, walk, length, CASE WHEN list_contains(used, name) THEN origin ELSE dst END AS node, label, CASE WHEN list_contains(used, name) THEN used ELSE list_append(used, name) END AS used, NOT list_contains(used, name) AS moved FROM n{i})")
    union = " UNION ALL ".join(f"SELECT anchor, walk, {i} AS step, node, label FROM s{i} WHERE moved" for i in range(high + 1))
    return f"WITH {', '.join(parts)} {union}"


@query(_walk_sql())
def random_walks(spark, sf_dir):
    return _walks(spark, sf_dir)


PATHS = f"""w AS ({_walk_sql()}),
a AS (SELECT anchor, walk, list(node ORDER BY step) AS nodes, list(label ORDER BY step) FILTER (WHERE label IS NOT NULL) AS labels FROM w GROUP BY 1, 2 HAVING count(*) > 1)"""
SLOTS = 24


@query(
    f"""WITH {PATHS}, f AS (SELECT anchor, nodes, labels, min(walk) AS walk FROM a GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY walk) AS number FROM f QUALIFY number <= {SLOTS}),
h AS (SELECT anchor, count(*) AS held FROM n GROUP BY 1), s AS (SELECT anchor, held, CAST(unnest(range(1, {SLOTS + 1})) AS INT) AS slot FROM h),
c AS (SELECT anchor, slot, CASE WHEN slot <= held THEN slot ELSE CAST(('0x' || substr(md5('0|' || anchor || '|' || slot), 1, 7)) AS BIGINT) % held + 1 END AS number FROM s)
SELECT anchor, slot, walk, array_to_string(nodes, ' ') AS nodes, array_to_string(labels, ' ') AS labels FROM c JOIN n USING (anchor, number)"""
)
def padded_walks(spark, sf_dir):
    padded = walks.padded_walks(walks.as_arrays(_walks(spark, sf_dir)), SLOTS)
    return padded.select("anchor", "slot", "walk", F.array_join("nodes", " ").alias("nodes"), F.array_join("labels", " ").alias("labels"))


@query(
    f"""WITH {PATHS} SELECT anchor, walk, CAST(to_json(struct_pack(node_types := list_transform(nodes, lambda x: split_part(x, '(', 1)), node_values := list_transform(nodes, lambda x: regexp_extract(x, '^[^(]*\\((.*)\\)$', 1)), edges := labels)) AS VARCHAR) AS trajectory FROM a"""
)
def walk_trajectories(spark, sf_dir):
    return walks.trajectories(walks.as_arrays(_walks(spark, sf_dir))).select("anchor", "walk", F.to_json("trajectory").alias("trajectory"))


@query(f"WITH {PATHS} SELECT anchor, node, count(*) AS places FROM (SELECT anchor, unnest(nodes) AS node FROM a) GROUP BY 1, 2 HAVING count(*) >= 2")
def walk_used_nodes(spark, sf_dir):
    return walks.used_nodes(walks.as_arrays(_walks(spark, sf_dir)))


# quantified conditions


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unused_orders(spark, sf_dir):
    t = graph.load(spark, sf_dir, "orders", "lineitem")
    return quantified.having_none(t["orders"].select("o_orderkey"), t["lineitem"].select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def orders_with_large_line(spark, sf_dir):
    t = graph.load(spark, sf_dir, "orders", "lineitem")
    return quantified.having_some(t["orders"].select("o_orderkey"), t["lineitem"].where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R')")
def all_lines_returned(spark, sf_dir):
    t = graph.load(spark, sf_dir, "orders", "lineitem")
    lines = t["lineitem"].select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return quantified.for_all(t["orders"].select("o_orderkey"), lines, ["o_orderkey"], F.col("l_returnflag") == "R")


@query("SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_returnflag = 'R')) ON l_orderkey = o_orderkey")
def some_and_all_lines_returned(spark, sf_dir):
    t = graph.load(spark, sf_dir, "orders", "lineitem")
    lines = t["lineitem"].select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return quantified.for_all_and_some(t["orders"].select("o_orderkey"), lines, ["o_orderkey"], F.col("l_returnflag") == "R")


@query("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def users_of_every_type(spark, sf_dir):
    e = graph.load(spark, sf_dir, "events")["events"]
    return quantified.divided_by(e, e, "user_id", "event_type")


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def maybe_redefined(spark, sf_dir):
    return quantified.more_than_one(graph.load(spark, sf_dir, "lineitem")["lineitem"], ["l_orderkey", "l_partkey"])


@query("SELECT s_nationkey, count(*) AS n FROM supplier JOIN customer ON c_nationkey = s_nationkey AND c_acctbal > s_acctbal GROUP BY 1")
def computed_column_join(spark, sf_dir):
    t = graph.load(spark, sf_dir, "supplier", "customer")
    customers = t["customer"].select(F.col("c_nationkey").alias("s_nationkey"), F.col("c_acctbal").alias("s_acctbal"))
    return quantified.pairs_below(t["supplier"], customers, "s_nationkey", "s_acctbal")


# ordered relations

FLOW = "OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)"
BEFORE = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_token FROM events")
def next_token(spark, sf_dir):
    e = graph.load(spark, sf_dir, "events")["events"]
    return dataflow.next_token(e, ["user_id"], ["ts", "event_id"], "event_id").select("event_id", "next_token")


@query(f"SELECT event_id, lag(event_id) {FLOW} AS last_use FROM events")
def last_use(spark, sf_dir):
    e = graph.load(spark, sf_dir, "events")["events"]
    return dataflow.last_use(e, ["user_id", "event_type"], ["ts", "event_id"], "event_id").select("event_id", "last_use")


@query(f"SELECT event_id, last_value(CASE WHEN value < 50 THEN event_id END IGNORE NULLS) {BEFORE} AS last_read, last_value(CASE WHEN value >= 50 THEN event_id END IGNORE NULLS) {BEFORE} AS last_write FROM events")
def last_read_write(spark, sf_dir):
    e = graph.load(spark, sf_dir, "events")["events"]
    return dataflow.last_read_write(e, ["user_id"], ["ts", "event_id"], "event_id", F.col("value") < 50).select("event_id", "last_read", "last_write")


@query("SELECT event_id, CASE WHEN value < 50 THEN count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS n_last_read FROM events")
def all_pairs_last_read(spark, sf_dir):
    e = graph.load(spark, sf_dir, "events")["events"]
    return dataflow.earlier_or_same_counts(e, ["user_id"], ["ts", "event_id"], F.col("value") < 50).select("event_id", "n_last_read")


@query(f"WITH r AS (SELECT event_id, user_id, event_type, CAST(dense_rank() {FLOW} AS INT) AS rank FROM events) SELECT event_id, rank, rank = 1 AS is_first, rank = max(rank) OVER (PARTITION BY user_id, event_type) AS is_last FROM r")
def rank_in_block(spark, sf_dir):
    e = graph.load(spark, sf_dir, "events")["events"]
    return dataflow.rank_in_block(e, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "rank", "is_first", "is_last")


@query(f"SELECT event_id AS definition, redefinition FROM (SELECT event_id, lead(event_id) {FLOW} AS redefinition FROM events) WHERE redefinition IS NOT NULL")
def redefinitions(spark, sf_dir):
    e = graph.load(spark, sf_dir, "events")["events"]
    return dataflow.redefinitions(e, ["user_id", "event_type"], ["ts", "event_id"], "event_id").select("definition", "redefinition")


@query(
    """WITH n AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
s AS (SELECT a.event_id AS origin, a.user_id, a.p, min(b.p) AS stop FROM n a LEFT JOIN n b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.p > a.p GROUP BY 1, 2, 3)
SELECT origin, count(*) AS n_reached FROM s JOIN n USING (user_id) WHERE n.p > s.p AND n.p <= coalesce(s.stop, 1000000000) GROUP BY origin"""
)
def reaches_without_redefinition(spark, sf_dir):
    e = graph.load(spark, sf_dir, "events")["events"]
    return dataflow.reached_in_order(e, ["user_id"], ["ts", "event_id"], ["event_type"], "event_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(l_linenumber, 0), coalesce(l_suppkey, 0), l_partkey, l_extendedprice) AS INT) AS number FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice FROM lineitem)")
def numbered_by_location(spark, sf_dir):
    rows = graph.load(spark, sf_dir, "lineitem")["lineitem"].select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice").distinct()
    tie = rows.withColumn("tie", F.struct("l_partkey", "l_extendedprice"))
    return dataflow.numbered_by_location(tie, ["l_orderkey"], "l_linenumber", "l_suppkey", "tie").select("l_orderkey", "l_linenumber", "l_partkey", "number")


@query("WITH f AS (SELECT user_id, event_type, event_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS first FROM events) SELECT event_id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY first) - 1 AS INT) AS slot FROM f")
def first_seen_slots(spark, sf_dir):
    return dataflow.first_seen_ids(graph.load(spark, sf_dir, "events")["events"], ["user_id"], "event_id", "event_type").select("event_id", "slot")


# text, dictionaries, features

SPACES = r"[\x{1C}-\x{1F}\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SPLIT = "CASE WHEN doc_id % 10 = 0 THEN 'dev' WHEN doc_id % 10 = 1 THEN 'eval' ELSE 'train' END"
BARE = f"regexp_replace(text, '[\\x0b\\x0c\\x1c-\\x1f\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', '', 'g')"
DIGESTS = f"d AS (SELECT doc_id, {SPLIT} AS phase, sha256({BARE}) AS digest FROM documents)"


def _digests(spark, sf_dir):
    docs = sampling.split_phases(graph.load(spark, sf_dir, "documents")["documents"].select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", "phase", text.content_digest(F.col("text")).alias("digest"))


@query(f"WITH {DIGESTS} SELECT phase, digest, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM d GROUP BY 1, 2 HAVING count(*) > 1")
def digest_repeats(spark, sf_dir):
    return vocabulary.repeated_in_split(_digests(spark, sf_dir), "phase", "doc_id", "digest")


@query(f"WITH {DIGESTS}, g AS (SELECT phase, digest, count(*) AS n FROM d GROUP BY 1, 2) SELECT a.phase AS split_a, b.phase AS split_b, a.digest, a.n AS n_a, b.n AS n_b FROM g a JOIN g b ON a.digest = b.digest AND a.phase < b.phase")
def digest_overlap(spark, sf_dir):
    return vocabulary.shared_digests(_digests(spark, sf_dir), "phase", "doc_id", "digest")


TOKENS = f"""words AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 1 WHEN doc_id % 10 = 1 THEN 2 ELSE 0 END AS phase, string_split(text, ' ') AS w FROM documents),
t AS (SELECT doc_id, phase, CAST(unnest(range(0, len(w))) AS INT) AS pos, unnest(w) AS token FROM words),
f AS (SELECT token, min((phase, doc_id, pos)) AS first FROM t WHERE phase = 0 GROUP BY token),
v AS (SELECT token, row_number() OVER (ORDER BY first) + 1 AS id FROM f UNION ALL SELECT '__pad__', 0 UNION ALL SELECT '__unknown__', 1),
e AS (SELECT doc_id, pos, coalesce(id, 1) AS id FROM t LEFT JOIN v USING (token))"""


def _tokens(spark, sf_dir):
    docs, words = graph.load(spark, sf_dir, "documents")["documents"].select("doc_id", "text"), F.split("text", " ")
    rest = F.pmod("doc_id", F.lit(10))
    found = docs.select("doc_id", F.when(rest == 0, 1).when(rest == 1, 2).otherwise(0).alias("phase"), F.posexplode(words).alias("pos", "token"))
    # a text's distinct words keep the order of their first places; text and place are one number, as numbers are hashed and not sorted to find the least
    train = docs.where(~F.coalesce(rest.isin(0, 1), F.lit(False)))
    firsts = train.select((F.coalesce("doc_id", F.lit(-(2**63))).cast("decimal(19,0)") * F.lit(2**31).cast("decimal(10,0)")).alias("of_text"), F.posexplode(F.array_distinct(words)).alias("pos", "token"))
    return found, vocabulary.vocabulary(firsts.select("token", (F.col("of_text") + F.col("pos")).alias("place")), ["place"])


@query(f"WITH {TOKENS} SELECT token, CAST(id AS BIGINT) AS id FROM v")
def vocabulary_ids(spark, sf_dir):
    return _tokens(spark, sf_dir)[1]


@query(f"WITH {TOKENS} SELECT doc_id AS \"row\", CAST(id AS BIGINT) AS token_id, count(*) AS value FROM e GROUP BY 1, 2")
def token_coo(spark, sf_dir):
    found, vocab = _tokens(spark, sf_dir)
    return vocabulary.coo(vocabulary.encoded(found, vocab), "doc_id")


@query(f"WITH {TOKENS}, s AS (SELECT doc_id, CAST(pos // 32 AS INT) AS block, list(id ORDER BY pos) AS ids FROM e GROUP BY 1, 2) SELECT doc_id, block, array_to_string(list_resize(ids, 32, 0), ' ') AS ids FROM s")
def padded_matrix(spark, sf_dir):
    docs = graph.load(spark, sf_dir, "documents")["documents"]
    return vocabulary.encoded_blocks(docs, "doc_id", "text", _tokens(spark, sf_dir)[1], 32)


@query("SELECT p_partkey, array_to_string(list_transform(range(0, CAST(greatest(ceil(length(p_name) / 15.0), 1) AS BIGINT)), lambda i: substr(p_name, i * 15 + 1, 15)), '|') AS pieces FROM part")
def long_token_split(spark, sf_dir):
    return graph.load(spark, sf_dir, "part")["part"].select("p_partkey", F.array_join(text.long_token_pieces(F.col("p_name")), "|").alias("pieces"))


@query("SELECT doc_id, sha256(replace(replace(replace(text, chr(10), '___NLCHAR___'), chr(13), '___CR___'), '^', '___CARET___')) AS digest FROM documents")
def sanitized(spark, sf_dir):
    return graph.load(spark, sf_dir, "documents")["documents"].select("doc_id", F.sha2(text.sanitize(F.col("text")), 256).alias("digest"))


@query("SELECT doc_id, sha256(replace(replace(replace(text, chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')) AS digest FROM documents")
def escaped_text(spark, sf_dir):
    return graph.load(spark, sf_dir, "documents")["documents"].select("doc_id", F.sha2(text.escaped(F.col("text")), 256).alias("digest"))


@query()
def identifier_split(spark, sf_dir):
    return graph.load(spark, sf_dir, "part")["part"].select("p_partkey", text.identifier_pieces(F.col("p_type")).alias("pieces"))


@query()
def lossless_split(spark, sf_dir):
    return graph.load(spark, sf_dir, "conversations")["conversations"].select("conv_id", "turn", lexing.lossless_tokens("text").alias("pieces"))


@query()
def python_lexer(spark, sf_dir):
    return graph.load(spark, sf_dir, "conversations")["conversations"].select("conv_id", "turn", F.size(lexing.lexed_python("text")).alias("n_tokens"))


@query(f"WITH {NODES} SELECT label, regexp_extract(label, '^([^(]*)\\(', 1) AS rel, regexp_extract(label, '^[^(]*\\((.*)\\)$', 1) AS value FROM nodes")
def parsed_labels(spark, sf_dir):
    nodes = graph.star_nodes(_star(spark, sf_dir), joinspec.STAR_KEYS)
    return nodes.select("label", text.label_relation(F.col("label")).alias("rel"), text.label_values(F.col("label"))[0].alias("value"))


@query(f"WITH {EDGES} SELECT DISTINCT label, string_split(label[2:-2], ',')[1] AS a, string_split(label[2:-2], ',')[2] AS b FROM edges")
def parsed_edge_labels(spark, sf_dir):
    labels = _edges(spark, sf_dir).select("label").distinct()
    halves = text.edge_halves(F.col("label"))
    return labels.select(text.normal_edge_label(F.col("label")).alias("label"), halves[0].alias("a"), halves[1].alias("b"))


@query("SELECT a.conv_id, a.turn, length(a.text) AS n_a, length(b.text) AS n_b, least(length(a.text), greatest(200 - length(b.text), 100)) AS kept_a, least(length(b.text), greatest(200 - length(a.text), 100)) AS kept_b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def pair_truncation(spark, sf_dir):
    c = graph.load(spark, sf_dir, "conversations")["conversations"]
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("n_b"))
    both = c.select("conv_id", "turn", F.length("text").cast("long").alias("n_a")).join(after, ["conv_id", "turn"])
    kept_a, kept_b = text.truncated_pair(F.col("n_a"), F.col("n_b"), 200)
    return both.select("conv_id", "turn", "n_a", "n_b", kept_a.cast("long").alias("kept_a"), kept_b.cast("long").alias("kept_b"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)
SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (WHERE line = '') AS n_empty, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM l GROUP BY 1"""
)
def sentences(spark, sf_dir):
    docs = graph.load(spark, sf_dir, "documents")["documents"].select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.count_if(F.col("line") == "").alias("n_empty"), F.sum(F.length("line")).alias("n_chars"))


@query(
    """WITH p AS (SELECT a.conv_id, a.turn, string_split(a.text, chr(10)) AS x, string_split(b.text, chr(10)) AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
l AS (SELECT conv_id, turn, x, y, list_filter(range(1, greatest(len(x), len(y)) + 1), lambda i: x[i] IS DISTINCT FROM y[i])[1] AS line FROM p)
SELECT conv_id, turn, CAST(line AS INT) AS line, CAST(CASE WHEN line IS NOT NULL THEN coalesce(list_filter(range(1, least(length(coalesce(x[line], '')), length(coalesce(y[line], ''))) + 1), lambda i: coalesce(x[line], '')[i] <> coalesce(y[line], '')[i])[1],
       least(length(coalesce(x[line], '')), length(coalesce(y[line], ''))) + 1) END AS INT) AS "column" FROM l"""
)
def first_difference(spark, sf_dir):
    c = graph.load(spark, sf_dir, "conversations")["conversations"]
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("right"))
    pairs = c.select("conv_id", "turn", F.col("text").alias("left")).join(after, ["conv_id", "turn"])
    return vocabulary.first_difference(pairs, "left", "right").select("conv_id", "turn", "line", "column")


# sampling and batches


@query("SELECT doc_id, quality FROM labels QUALIFY row_number() OVER (PARTITION BY quality ORDER BY md5('0|' || doc_id), doc_id) <= 20")
def stratified_sample(spark, sf_dir):
    return sampling.first_by_hash(graph.load(spark, sf_dir, "labels")["labels"], ["quality"], "doc_id", 20).select("doc_id", "quality")


@query(
    """WITH m AS (SELECT quality AS class, doc_id AS key, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS n FROM labels),
c AS (SELECT class, max(n) AS size, row_number() OVER (ORDER BY class) AS c FROM m GROUP BY 1),
d AS (SELECT draw, CAST(('0x' || substr(md5('0|class|' || draw), 1, 7)) AS BIGINT) % (SELECT count(*) FROM c) + 1 AS c, CAST(('0x' || substr(md5('0|member|' || draw), 1, 7)) AS BIGINT) AS member FROM (SELECT unnest(range(1, 51)) AS draw))
SELECT draw, class, key FROM d JOIN c USING (c) JOIN m USING (class) WHERE n = member % size + 1"""
)
def class_draws(spark, sf_dir):
    return sampling.class_draws(graph.load(spark, sf_dir, "labels")["labels"], "quality", "doc_id", 50)


@query(f"SELECT {SPLIT} AS phase, count(*) AS n FROM documents GROUP BY 1")
def phases(spark, sf_dir):
    return sampling.split_phases(graph.load(spark, sf_dir, "documents")["documents"], "doc_id").groupBy("phase").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 64 AS BIGINT) AS batch FROM labels QUALIFY count(*) OVER (PARTITION BY (SELECT 1)) >= 0 AND (row_number() OVER (ORDER BY doc_id) - 1) // 64 < count(*) OVER () // 64")
def full_batches(spark, sf_dir):
    return sampling.batches(graph.load(spark, sf_dir, "labels")["labels"], "doc_id", 64, drop_last=True).select("doc_id", "batch")


@query()
def length_bucketed_batches(spark, sf_dir):
    docs = graph.load(spark, sf_dir, "documents")["documents"].select("doc_id", "n_chars")
    return sampling.length_bucketed_batches(docs, "doc_id", "n_chars", 100_000, parts=max(8, docs.count() // 2000))


@query("SELECT event_type AS label, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT event_type FROM events)")
def label_map(spark, sf_dir):
    return vocabulary.label_map(graph.load(spark, sf_dir, "events")["events"], "event_type")


# metrics

SCORED = "s AS (SELECT doc_id, quality, toxic, CAST(crc32 AS DOUBLE) / 1000.0 AS score FROM (SELECT doc_id, quality, toxic, (n_chars * 7919 + doc_id) % 1000 AS crc32 FROM labels JOIN documents USING (doc_id)))"


def _scored(spark, sf_dir):
    t = graph.load(spark, sf_dir, "labels", "documents")
    both = t["labels"].join(t["documents"].select("doc_id", "n_chars"), "doc_id")
    return both.select("doc_id", "quality", "toxic", (((F.col("n_chars") * 7919 + F.col("doc_id")) % 1000).cast("double") / 1000.0).alias("score"))


@query(f"WITH {SCORED} SELECT round(avg(CASE WHEN (score > 0.5) = (quality = 1) THEN 1 ELSE 0 END), 9) AS accuracy FROM s")
def accuracy(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumn("predicted", (F.col("score") > 0.5).cast("int"))
    return metrics.accuracy(scored, "predicted", "quality").select(F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH {SCORED} SELECT quality AS truth, CAST(score > 0.5 AS INT) AS predicted, count(*) AS n FROM s GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return metrics.confusion(_scored(spark, sf_dir).withColumn("predicted", (F.col("score") > 0.5).cast("int")), "predicted", "quality")


@query(f"WITH {SCORED}, r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s) SELECT round((sum(r) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2.0) / (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality = 0)), 9) AS auc FROM r")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_scored(spark, sf_dir), "score", "quality").select(F.round("auc", 9).alias("auc"))


@query(f"WITH {SCORED} SELECT round(avg(-quality * ln(score + 1e-18) - (1 - quality) * ln(1 - score + 1e-18)), 6) AS log_loss FROM s")
def log_loss(spark, sf_dir):
    return metrics.log_loss(_scored(spark, sf_dir), "score", "quality").select(F.round("log_loss", 6).alias("log_loss"))


@query(f"WITH {SCORED} SELECT round(sum(CAST(score > 0.5 AS INT) * toxic) / (1e-9 + sum(toxic)), 6) AS toxic_accuracy, round(sum(CAST(score > 0.5 AS INT) * (1 - toxic)) / (1e-9 + sum(1 - toxic)), 6) AS other_accuracy FROM s")
def conditional_accuracy(spark, sf_dir):
    hit = (F.col("score") > 0.5).cast("int")
    return _scored(spark, sf_dir).agg(F.round(metrics.conditional_mean(hit, F.col("toxic")), 6).alias("toxic_accuracy"), F.round(metrics.conditional_mean(hit, 1 - F.col("toxic")), 6).alias("other_accuracy"))


@query(f"WITH {SCORED}, w AS (SELECT doc_id % 10 AS g, exp(score - max(score) OVER (PARTITION BY doc_id % 10)) AS e, toxic FROM s) SELECT g, round(sum(e * toxic) / sum(e), 6) AS vote FROM w GROUP BY g")
def weighted_vote(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumn("g", F.col("doc_id") % 10)
    return metrics.weighted_vote(scored, ["g"], "score", F.col("toxic")).select("g", F.round("vote", 6).alias("vote"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS predicted FROM embeddings")
def argmax(spark, sf_dir):
    return graph.load(spark, sf_dir, "embeddings")["embeddings"].select("vec_id", metrics.argmax(F.col("embedding")).alias("predicted"))


@query("SELECT label, CAST(i - 1 AS INT) AS dim, round(CAST(max(x) AS DOUBLE), 5) AS value FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2")
def max_pooling(spark, sf_dir):
    pooled = metrics.pooled(graph.load(spark, sf_dir, "embeddings")["embeddings"], ["label"], "embedding", "max")
    return pooled.select("label", "dim", F.round(F.col("value").cast("double"), 5).alias("value"))


@query("SELECT event_type, arg_max(event_id, (value, event_id)) AS best_event_id, max(value) AS best_value FROM events GROUP BY 1")
def best_event(spark, sf_dir):
    return metrics.best_by(graph.load(spark, sf_dir, "events")["events"], ["event_type"], "event_id", "value")


# message passing

VECTORS = "x AS (SELECT vec_id AS node, CAST(unnest(range(0, len(embedding))) AS INT) AS dim, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings), m AS (SELECT vec_id AS src, vec_id // 3 AS dst, CAST(vec_id % 2 AS INT) AS type FROM embeddings)"


def _vectors(spark, sf_dir):
    e = graph.load(spark, sf_dir, "embeddings")["embeddings"]
    features = e.select(F.col("vec_id").alias("node"), F.posexplode(F.transform("embedding", lambda v: v.cast("double"))).alias("dim", "value"))
    edges = e.select(F.col("vec_id").alias("src"), F.floor(F.col("vec_id") / 3).alias("dst"), F.pmod("vec_id", F.lit(2)).cast("int").alias("type"))
    return features, edges, e.select(F.col("vec_id").alias("node"))


def _message_sql(how: str) -> str:
    return f"""WITH {VECTORS}, g AS (SELECT dst, type, dim, {how}(value) AS value FROM m JOIN x ON node = src GROUP BY 1, 2, 3)
SELECT vec_id AS dst, t.type, d.dim, round(coalesce(g.value, 0), 5) AS value FROM embeddings CROSS JOIN (SELECT DISTINCT type FROM m) t CROSS JOIN (SELECT DISTINCT dim FROM x) d LEFT JOIN g ON g.dst = vec_id AND g.type = t.type AND g.dim = d.dim"""


def _messages(how: str):
    def run(spark, sf_dir):
        features, edges, nodes = _vectors(spark, sf_dir)
        return messages.aggregate_messages(edges, features, nodes, how).select("dst", "type", "dim", F.round("value", 5).alias("value"))

    run.__name__ = f"messages_{how}"
    return query(_message_sql(how))(run)


for _how in ("sum", "avg", "max", "min"):
    _messages(_how)


@query(f"WITH {VECTORS} SELECT src, dst, type, round(1.0 / count(*) OVER (PARTITION BY dst, type), 9) AS weight FROM m")
def in_degree_weights(spark, sf_dir):
    return messages.mean_by_in_degree(_vectors(spark, sf_dir)[1]).select("src", "dst", "type", F.round("weight", 9).alias("weight"))


@query(f"WITH {VECTORS} SELECT m.dst AS \"row\", dim, round(sum(value), 5) AS value FROM m JOIN x ON node = src GROUP BY 1, 2")
def sparse_times_dense(spark, sf_dir):
    features, edges, _ = _vectors(spark, sf_dir)
    return messages.sparse_times_dense(edges.select(F.col("dst").alias("row"), F.col("src").alias("token")), features.withColumnRenamed("node", "token")).select("row", "dim", F.round("value", 5).alias("value"))


@query(f"WITH {VECTORS} SELECT label AS graph, dim, round(sum(value), 5) AS value FROM x JOIN embeddings ON vec_id = node GROUP BY 1, 2")
def graph_readout(spark, sf_dir):
    features, _, _ = _vectors(spark, sf_dir)
    labels = graph.load(spark, sf_dir, "embeddings")["embeddings"].select(F.col("vec_id").alias("node"), F.col("label").alias("graph"))
    return messages.readout(features.join(labels, "node"), "graph").select("graph", "dim", F.round("value", 5).alias("value"))


@query(f"WITH {NODES} SELECT rel, count(*) AS n FROM nodes GROUP BY ROLLUP (rel)")
def relation_rollup(spark, sf_dir):
    return graph.star_nodes(_star(spark, sf_dir), joinspec.STAR_KEYS).rollup("rel").agg(F.count("*").alias("n"))


# set operations


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def nations_of_both(spark, sf_dir):
    t = graph.load(spark, sf_dir, "customer", "supplier")
    return t["customer"].select(F.col("c_nationkey").alias("k")).intersect(t["supplier"].select(F.col("s_nationkey").alias("k")))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def parts_never_bulk(spark, sf_dir):
    t = graph.load(spark, sf_dir, "part", "lineitem")
    return t["part"].select(F.col("p_partkey").alias("k")).subtract(t["lineitem"].where("l_quantity > 49").select(F.col("l_partkey").alias("k")))


# windows on events (extra)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    return streams.windowed(graph.load(spark, sf_dir, "events")["events"], "1 day").withColumn("total", F.round("total", 4))


@query("SELECT time_bucket(INTERVAL 12 HOUR, ts) - k * INTERVAL 12 HOUR AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(0, 2) t(k) GROUP BY 1, 2")
def sliding_windows(spark, sf_dir):
    return streams.windowed(graph.load(spark, sf_dir, "events")["events"], "1 day", "12 hours").withColumn("total", F.round("total", 4))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_windows(spark, sf_dir):
    return streams.sessions(graph.load(spark, sf_dir, "events")["events"], "6 hours")
