"""Data points of program tasks: anchors of each task in the programs' graphs, walks from them, labels.

Nodes and edges are those of :mod:`loomgraph.operators.graph` (graph_id, id, rel, vals, label and
graph_id, src, dst, label); all programs are worked on at once, and nothing is made for a program but
its anchors, its walks and one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import access
from loomgraph.operators.graph import cut
from loomgraph.operators.walks import FAVOURED, relation_of

#: Stands between a node's label and its graph; labels of two graphs may be equal.
APART = "\x1f"


def access_anchors(nodes: DataFrame, accesses: DataFrame, exprs: DataFrame) -> DataFrame:
    """(graph_id, anchor): labels of the nodes of expressions that access a variable; ``accesses`` has (graph_id, id)."""
    ids = exprs.join(accesses.select("graph_id", "id"), ["graph_id", "id"], "left_semi")
    return node_anchors(nodes, ids, "py_exprs", ["id", "kind", "parent", "idx"])


def node_anchors(nodes: DataFrame, rows: DataFrame, rel: str, columns: list[str]) -> DataFrame:
    """(graph_id, anchor): labels of the nodes of a relation's rows; rows that are no node find nothing."""
    wanted = rows.select("graph_id", F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("vals")).distinct()
    return nodes.where(F.col("rel") == rel).join(wanted, ["graph_id", "vals"], "left_semi").select("graph_id", F.col("label").alias("anchor")).distinct()


def stored_and_read(names: DataFrame, contexts: DataFrame, store_kinds: tuple[int, ...]) -> DataFrame:
    """(graph_id, id, role): names (graph_id, id) with the role their context (graph_id, kind, parent) gives them: write or read; without a context, read."""
    kinds = contexts.groupBy("graph_id", F.col("parent").alias("id")).agg(F.bool_or(F.col("kind").isin(*store_kinds)).alias("stores"))
    found = names.select("graph_id", "id").join(kinds, ["graph_id", "id"], "left")
    return found.select("graph_id", "id", F.when(F.coalesce("stores", F.lit(False)), "write").otherwise("read").alias("role"))


def data_points(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, labels: DataFrame, walks: int, steps: tuple[int, int], favoured: tuple[str, ...] = FAVOURED, seed: str = "0") -> DataFrame:
    """(graph_id, anchors, trajectories, hints, label, source): one data point for each program of ``labels`` (graph_id, label).

    A program's ``walks`` are shared evenly by its anchors (rounded down, one at least), equal walks
    count once, and places that stay are filled by drawing from those it has. Hints are the labels
    that stand at two or more places of its walks. Anchors that are no node, and programs without a
    walk, have empty lists. Nothing depends on how rows are partitioned.
    """
    there = F.concat("label", F.lit(APART), F.col("graph_id").cast("string"))
    named = nodes.select("graph_id", "id", there.alias("name"))
    end = lambda c: named.select("graph_id", F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    whole = edges.join(end("src"), ["graph_id", "src"]).join(end("dst"), ["graph_id", "dst"]).select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "label")
    tickets = access.ticket_table(whole, favoured)
    order = Window.partitionBy("graph_id")
    known = anchors.join(labels.select("graph_id"), "graph_id", "left_semi").distinct()
    places = known.withColumns({"share": F.greatest(F.floor(F.lit(walks) / F.count("*").over(order)), F.lit(1)), "number": F.row_number().over(order.orderBy("anchor")) - 1})
    places = cut(places.withColumn("name", F.concat("anchor", F.lit(APART), F.col("graph_id").cast("string"))))
    # a walk's seed is its graph and the anchor's number there
    asked = places.select(F.col("graph_id").alias("epoch"), F.col("number").alias("position"), "name", "share")
    steps_of = access.walks_at(tickets, asked, "name", walks, steps, seed).join(asked.select("epoch", "position", "share"), ["epoch", "position"]).where("walk <= share")
    shown = F.substring_index("node", APART, 1)
    rows = steps_of.groupBy("epoch", "position", "walk").agg(F.array_sort(F.collect_list(F.struct("step", shown.alias("node"), "label"))).alias("s")).where(F.size("s") > 1)
    parts = rows.select(F.col("epoch").alias("graph_id"), "position", "walk", F.transform("s", lambda x: x.node).alias("nodes"), F.filter(F.transform("s", lambda x: x.label), lambda x: x.isNotNull()).alias("edges"))
    first = parts.groupBy("graph_id", "nodes", "edges").agg(F.min(F.struct("position", "walk")).alias("first"))
    held = first.withColumns({"number": F.row_number().over(order.orderBy("first")), "held": F.count("*").over(order)}).where(F.col("number") <= walks)
    value = F.struct(F.transform("nodes", relation_of).alias("node_types"), F.transform("nodes", _inside).alias("node_values"), "edges")
    lists = held.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("number", value.alias("t"), "nodes"))).alias("own"))

    def draw(slot: Column) -> Column:
        size = F.size("own")
        return F.when(slot <= size, slot).otherwise(F.pmod(access.number(F.lit(seed), F.col("graph_id").cast("string"), slot.cast("string")), size) + 1).cast("int")

    padded = F.transform(F.sequence(F.lit(1), F.lit(walks)), lambda slot: F.element_at("own", draw(slot)).getField("t"))
    seen = F.flatten(F.transform("own", lambda x: x.nodes))
    lists = lists.select("graph_id", padded.alias("trajectories"), seen.alias("seen"))
    twice = lists.select("graph_id", F.explode("seen").alias("node")).groupBy("graph_id", "node").agg(F.count("*").alias("n")).where("n > 1")
    hints = twice.groupBy("graph_id").agg(F.array_sort(F.collect_list("node")).alias("hints"))
    mine = places.groupBy("graph_id").agg(F.array_sort(F.collect_list("anchor")).alias("anchors"))
    out = labels.join(mine, "graph_id", "left").join(lists.drop("seen"), "graph_id", "left").join(hints, "graph_id", "left")
    none = F.array().cast("array<string>")
    empty = F.array().cast(out.schema["trajectories"].dataType)
    return out.select("graph_id", F.coalesce("anchors", none).alias("anchors"), F.coalesce("trajectories", empty).alias("trajectories"), F.coalesce("hints", none).alias("hints"), "label", F.col("graph_id").cast("string").alias("source"))


def _inside(label: Column) -> Column:
    """What stands between a label's parentheses."""
    return F.regexp_extract(label, r"(?s)^[^(]*\((.*)\)$", 1)


def nth_occurrence(text: Column, word: Column, n: int) -> Column:
    """Place (from 0) of the n-th occurrence (from 0) of a word, -1 if there are fewer; they may overlap."""
    before = F.call_function("substring_index", text, word, F.lit(n + 1))
    return F.when((F.length(word) > 0) & (F.length(before) < F.length(text)), F.length(before)).otherwise(-1)
