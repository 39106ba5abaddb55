"""A store of many graphs with random access by index.

Graphs are numbered in the order of their keys. Nodes and edges are laid out in blocks of
consecutive graphs, one folder a block and sorted within, beside an index that holds for each graph
its block, its numbers of nodes and edges, and where they begin in the whole store. Fetching a graph
reads the folder of its block and no other; a set of wanted graphs prunes blocks by the same column.
Several stores read as one: their graphs follow each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import cut, running_offsets


def graph_index(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, per_block: int) -> DataFrame:
    """``graphs`` (graph_id and what describes a graph) with index, block, num_nodes, num_edges, node_offset and edge_offset.

    Numbers and offsets are counted range by range. A graph without nodes or edges has none.
    """
    sized = graphs
    for rows, name in ((nodes, "num_nodes"), (edges, "num_edges")):
        sized = sized.join(rows.groupBy("graph_id").agg(F.count("*").alias(name)), "graph_id", "left")
    sized = sized.fillna(0, ["num_nodes", "num_edges"]).withColumn("__one", F.lit(1))
    numbered = running_offsets(cut(sized), "graph_id", "__one", "index")
    for size, name in (("num_nodes", "node_offset"), ("num_edges", "edge_offset")):
        numbered = running_offsets(numbered, "index", size, name)
    return numbered.drop("__one").withColumn("block", F.expr(f"index div {per_block}"))


def write_store(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, folder: str, per_block: int = 5000, base: int = 1) -> None:
    """Write a store. ``nodes`` has (graph_id, id, ...), ``edges`` (graph_id, src, dst, ...); ids from ``base`` become numbers from 0."""
    index = cut(graph_index(graphs, nodes, edges, per_block))
    index.repartitionByRange("index").sortWithinPartitions("index").write.mode("overwrite").parquet(f"{folder}/index")
    place = index.select("graph_id", "index", "block")
    for name, rows, numbers in (("nodes", nodes, ["id"]), ("edges", edges, ["src", "dst"])):
        placed = rows.join(place, "graph_id").withColumns({c: F.col(c) - base for c in numbers})
        laid = placed.drop("graph_id").repartition("block").sortWithinPartitions("block", "index", *numbers)
        laid.write.mode("overwrite").partitionBy("block").parquet(f"{folder}/{name}")


class GraphStore:
    """One or more written stores, read as one."""

    def __init__(self, spark: SparkSession, *folders: str):
        self.spark, self.folders = spark, folders
        self.sizes = [spark.read.parquet(f"{f}/index").count() for f in folders]  # one number a store
        self.firsts = [sum(self.sizes[:i]) for i in range(len(folders))]

    def __len__(self) -> int:
        return sum(self.sizes)

    def _all(self, name: str) -> DataFrame:
        """Rows of all stores; store is the number of the folder, index counts on over all."""
        parts = [self.spark.read.parquet(f"{f}/{name}").withColumns({"store": F.lit(i), "index": F.col("index") + first}) for i, (f, first) in enumerate(zip(self.folders, self.firsts, strict=True))]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def index(self) -> DataFrame:
        return self._all("index")

    def at(self, number: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Index row, nodes and edges of one graph; reads one block."""
        if not 0 <= number < len(self):
            raise IndexError(f"no graph {number} among {len(self)}")
        store = max(i for i, first in enumerate(self.firsts) if first <= number and self.sizes[i])
        folder, own = self.folders[store], number - self.firsts[store]
        found = self.spark.read.parquet(f"{folder}/index").where(F.col("index") == own)
        block = found.first().block
        rows = lambda name: self.spark.read.parquet(f"{folder}/{name}").where((F.col("block") == block) & (F.col("index") == own)).drop("block")
        return found, rows("nodes"), rows("edges")

    def fetch(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Index rows, nodes and edges for each row of ``wanted`` (index, ...); a graph wanted twice is there twice. Indexes that don't exist find nothing."""
        found = wanted.join(self.index(), "index")
        place = found.select(*wanted.columns, "store", "block")
        return found, *[place.join(self._all(name), ["store", "block", "index"]) for name in ("nodes", "edges")]

    def by_class(self, label: str, draws: int, seed: str = "0") -> DataFrame:
        """(draw, class, index): draws with replacement, first of a class (each as likely) and then of one of its graphs."""
        from loomgraph.operators.sampling import class_draws

        return class_draws(self.index(), label, "index", draws, seed).withColumnRenamed("key", "index")


def anchor_numbers(graphs: DataFrame, nodes: DataFrame, base: int = 1) -> DataFrame:
    """(graph_id, anchors, numbers): the nodes that a graph's anchors name, by place in the list of anchors and then by node.

    ``graphs`` has (graph_id, anchors, anchor_index, num_nodes); all nodes with an anchor's label
    count. A graph none of whose anchors is found falls back to its anchor_index (from ``base``),
    and without one to the number after its last node; its anchors are then these numbers.
    """
    named = graphs.select("graph_id", F.posexplode("anchors").alias("place", "label"))
    hits = named.join(nodes.select("graph_id", "label", "id"), ["graph_id", "label"])
    found = hits.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("place", (F.col("id") - base).alias("number")))).alias("hits"))
    given = F.transform("anchor_index", lambda i: i.cast("long") - base)
    other = F.when(F.size("anchor_index") > 0, given).otherwise(F.array(F.col("num_nodes").cast("long")))
    out = graphs.join(found, "graph_id", "left").withColumn("numbers", F.coalesce(F.transform("hits", lambda h: h.number.cast("long")), other))
    return out.select("graph_id", F.when(F.col("hits").isNull(), F.transform("numbers", lambda n: n.cast("string"))).otherwise(F.col("anchors")).alias("anchors"), "numbers")


def labelled_nodes(nodes: DataFrame, wanted: DataFrame, strict: bool = True) -> DataFrame:
    """(graph_id, label, id) of wanted labels (graph_id, label). ``strict`` fails, when the result is read, on a label that no node has; else it is left out."""
    found = wanted.join(nodes.select("graph_id", "label", "id"), ["graph_id", "label"], "left" if strict else "inner")
    if strict:
        message = F.concat(F.lit("no node is labelled "), F.col("label"))
        found = found.withColumn("id", F.when(F.col("id").isNull(), F.raise_error(message).cast(nodes.schema["id"].dataType)).otherwise(F.col("id")))
    return found.select("graph_id", "label", "id")
