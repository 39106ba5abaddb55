"""Token graphs cut down and numbered anew, and variables given other slots.

Nodes are rows (graph_id, pos, ...), edges (graph_id, src, dst, name), pointers (graph_id, role, pos)
such as error locations, repair targets and candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pruned(nodes: DataFrame, keep: Column, longest: int | None = None, first: int | None = None) -> DataFrame:
    """Nodes that ``keep`` holds for, with number, their place from 0 among those left of the graph.

    With ``first`` only so many of a graph stay; with ``longest``, graphs of which more are left go altogether.
    """
    order = Window.partitionBy("graph_id").orderBy("pos")
    kept = nodes.where(keep).withColumn("number", F.row_number().over(order) - 1)
    if first is not None:
        kept = kept.where(F.col("number") < first)
    if longest is not None:
        kept = kept.withColumn("__size", F.count("*").over(Window.partitionBy("graph_id"))).where(F.col("__size") <= longest).drop("__size")
    return kept


def renumbered_edges(edges: DataFrame, kept: DataFrame, kinds: list[str], reverse: bool = True) -> DataFrame:
    """(graph_id, type, src, dst) of edges of the given kinds whose ends are both kept, by the ends' new numbers.

    The type is twice the kind's place in the list; with ``reverse`` each edge is there backwards too, with one more.
    """
    kind = F.coalesce(*[F.when(F.col("name") == name, F.lit(2 * i)) for i, name in enumerate(kinds)])
    number = kept.select("graph_id", "pos", "number")
    known = edges.where(F.col("name").isin(*kinds)).withColumn("type", kind)
    for end in ("src", "dst"):
        known = known.join(number.select("graph_id", F.col("pos").alias(end), F.col("number").alias(f"__{end}")), ["graph_id", end])
    ahead = known.select("graph_id", "type", F.col("__src").alias("src"), F.col("__dst").alias("dst"))
    return ahead.unionByName(ahead.select("graph_id", (F.col("type") + 1).alias("type"), F.col("dst").alias("src"), F.col("src").alias("dst"))) if reverse else ahead


def renumbered_pointers(pointers: DataFrame, kept: DataFrame) -> DataFrame:
    """(graph_id, role, number) of pointers at nodes that are kept."""
    return pointers.join(kept.select("graph_id", "pos", "number"), ["graph_id", "pos"]).select("graph_id", "role", "number")


def slot_permutation(graph: Column, epoch: int, slots: int, seed: str = "0") -> Column:
    """An array whose entry s is the slot that variable s of the graph has in an epoch: slots in the order of their hashes.

    Made within the row, so any partitioning gives the same; a bijection for each graph and epoch.
    """
    drawn = lambda s: F.struct(F.md5(F.concat_ws("|", F.lit(seed), F.lit(str(epoch)), graph.cast("string"), s.cast("string"))).alias("h"), s.alias("s"))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), drawn))
    return F.transform(order, lambda x: x.s)


def shuffled_slots(tokens: Column, permutation: Column, slot_tokens: list[int]) -> Column:
    """Tokens with those that stand for a variable's slot (``slot_tokens`` by slot) replaced by those of its new slot; others stay."""
    slots = F.array(*map(F.lit, slot_tokens))

    def one(token: Column) -> Column:
        old = F.array_position(slots, token).cast("int")
        return F.when(old > 0, F.element_at(slots, F.element_at(permutation, old) + 1)).otherwise(token)

    return F.transform(tokens, one)


def most_variables(slots: DataFrame, most: int = 100) -> DataFrame:
    """(n_slots): the largest number of distinct variables (graph_id, variable) of a graph, at most ``most``: how many slots a dictionary needs."""
    sizes = slots.groupBy("graph_id").agg(F.count_distinct("variable").alias("n"))
    return sizes.agg(F.least(F.coalesce(F.max("n"), F.lit(0)), F.lit(most)).alias("n_slots"))
