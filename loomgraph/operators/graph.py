"""Tuple graphs: nodes and edges from tables and a join specification, and queries on them.

A graph is two DataFrames: nodes (id, rel, ...) and undirected edges (src, dst, label). Iterations
keep their frontier as a DataFrame and write it to a checkpoint between rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.joinspec import Link, key_columns
from loomgraph.tables import settle


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder, written once."""
    return settle(df, "graph")


def unsent(df: DataFrame) -> DataFrame:
    """For a side of a join: neither side goes whole through the driver, however small its files make it look.

    Repeated texts take next to nothing in files, so a broadcast planned by their size may hold a hundred times as much.
    """
    return df.hint("merge")


def likely(rows: DataFrame, wanted: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """The rows with the keys of ``wanted`` and a few others: a bitmap of the keys' hashes, of at most ``bits`` bits, spares the rest a join."""
    place = lambda df: df.withColumn("__bit", F.pmod(F.xxhash64(*keys), F.lit(bits)))
    marks = place(wanted.select(keys)).groupBy(F.bitmap_bucket_number("__bit").alias("__bucket"))
    marks = marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("__bit")).alias("__marks"))
    marked = place(rows).withColumn("__bucket", F.bitmap_bucket_number("__bit")).join(F.broadcast(marks), "__bucket")
    byte = F.conv(F.hex(F.substring("__marks", F.floor(F.bitmap_bit_position("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return marked.where(F.getbit(byte.cast("long"), F.pmod(F.bitmap_bit_position("__bit"), F.lit(8)).cast("int")) == 1).select(rows.columns)


def node_label(rel: str, key: Column) -> Column:
    return F.concat(F.lit(f"{rel}("), key.cast("string"), F.lit(")"))


def star_nodes(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """(rel, key, label) of every row of tables that have a key."""
    parts = [tables[rel].select(F.lit(rel).alias("rel"), F.col(key).cast("long").alias("key"), node_label(rel, F.col(key)).alias("label")) for rel, key in keys.items()]
    return reduce(DataFrame.unionByName, parts)


def star_edges(tables: dict[str, DataFrame], keys: dict[str, str], links: list[Link]) -> DataFrame:
    """(src, dst, label) for each pair of rows that a link joins; one equi-join for each link, so only linked relations meet."""
    parts = []
    for x in links:
        left = tables[x.left].select(F.col(x.left_column).cast("long").alias("v"), node_label(x.left, F.col(keys[x.left])).alias("src"))
        right = tables[x.right].select(F.col(x.right_column).cast("long").alias("v"), node_label(x.right, F.col(keys[x.right])).alias("dst"))
        parts.append(left.join(right, "v").select("src", "dst", F.lit(x.label).alias("label")))
    return reduce(DataFrame.unionByName, parts)


def edge_counts(tables: dict[str, DataFrame], links: list[Link]) -> DataFrame:
    """(label, n_edges) by counting the rows of each side of a link for each value first, so no edge is made."""
    parts = []
    for x in links:
        left = tables[x.left].groupBy(F.col(x.left_column).cast("long").alias("v")).agg(F.count("*").alias("n"))
        right = tables[x.right].groupBy(F.col(x.right_column).cast("long").alias("v")).agg(F.count("*").alias("m"))
        parts.append(left.join(right, "v").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("n_edges")).select(F.lit(x.label).alias("label"), "n_edges"))
    return reduce(DataFrame.unionByName, parts)


def tuple_nodes(relations: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """(graph_id, id, rel, vals, label, dup_count): distinct rows of all relations, numbered from 1 within a graph.

    Relations have a column graph_id beside those of ``columns``; values are text, null is empty.
    """
    parts = []
    for rel, df in relations.items():
        vals = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns[rel]])
        parts.append(df.select("graph_id", F.lit(rel).alias("rel"), vals.alias("vals")))
    rows = reduce(DataFrame.unionByName, parts).groupBy("graph_id", "rel", "vals").agg(F.count("*").alias("dup_count"))
    ordered = rows.withColumns({"__order": F.struct("rel", "vals"), "__one": F.lit(1)})
    numbered = running_within(ordered, "graph_id", "__order", "__one")  # one graph may hold all rows
    return numbered.select("graph_id", (F.col("low") + 1).cast("long").alias("id"), "rel", "vals", F.concat("rel", F.lit("("), F.array_join("vals", ","), F.lit(")")).alias("label"), "dup_count")


def tuple_edges(nodes: DataFrame, spec: DataFrame, links: list[Link], columns: dict[str, list[str]], multiplicity: bool = False) -> DataFrame:
    """(graph_id, src, dst, label[, multiplicity]) with src < dst.

    Rows meet through the specification, so values shared by unrelated relations join nothing. The
    specification has a row or two for each link and is broadcast. With ``multiplicity`` each edge
    also gets the number of distinct key values its ends share.
    """
    positions = [(rel, columns[rel].index(c)) for rel, names in key_columns(links).items() for c in names]
    keys = nodes.sparkSession.createDataFrame(sorted(positions), "rel string, pos int")
    kv = nodes.join(F.broadcast(keys), "rel").select("graph_id", "id", "rel", "pos", F.element_at("vals", F.col("pos") + 1).alias("v"))
    left = kv.select("graph_id", F.col("id").alias("src"), F.col("rel").alias("lrel"), F.col("pos").alias("lpos"), "v").join(F.broadcast(spec), ["lrel", "lpos"])
    right = kv.select("graph_id", F.col("id").alias("dst"), F.col("rel").alias("rrel"), F.col("pos").alias("rpos"), "v")
    edges = left.join(right, ["graph_id", "rrel", "rpos", "v"]).where("src < dst").select("graph_id", "src", "dst", "label").distinct()
    if not multiplicity:
        return edges
    own = nodes.join(F.broadcast(keys), "rel").groupBy("graph_id", "id").agg(F.collect_set(F.element_at("vals", F.col("pos") + 1)).alias("values"))
    ends = lambda name: own.select("graph_id", F.col("id").alias(name), F.col("values").alias(f"{name}_values"))
    both = edges.join(ends("src"), ["graph_id", "src"]).join(ends("dst"), ["graph_id", "dst"])
    return both.select("graph_id", "src", "dst", "label", F.size(F.array_intersect("src_values", "dst_values")).cast("long").alias("multiplicity"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))


def reverse_typed(edges: DataFrame, kind: str = "type") -> DataFrame:
    """Edge types doubled: 2t forward, 2t + 1 backward."""
    forward = edges.withColumn(kind, F.col(kind) * 2)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col(kind) * 2 + 1).alias(kind), *[c for c in edges.columns if c not in ("src", "dst", kind)])
    return forward.unionByName(back.select(forward.columns))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): distinct neighbours, direction ignored."""
    return both_ways(edges.select("src", "dst")).distinct().groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("n_nodes"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(edges.columns)


def bfs_levels(edges: DataFrame, start: DataFrame, depth: int | None = None, enough: int | None = None) -> DataFrame:
    """(node, level) of nodes within ``depth`` steps of ``start`` (node), by frontier rounds.

    Rounds end when nothing new is found, at ``depth``, or once ``enough`` nodes are reached.
    """
    steps = both_ways(edges.select("src", "dst")).distinct()
    steps = cut(steps)
    seen = frontier = cut(start.select("node").distinct().withColumn("level", F.lit(0)))
    level, reached = 0, seen.count()
    while (depth is None or level < depth) and (enough is None or reached < enough):
        level += 1
        found = frontier.select(F.col("node").alias("src")).join(steps, "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        new = frontier.count()
        if not new:
            break
        reached += new
        seen = seen.unionByName(frontier)
    return seen


def bfs_sample(edges: DataFrame, start: DataFrame, size: int) -> DataFrame:
    """(node, level, number): the first ``size`` nodes by level and node, numbered from 1 (in one task, as ``size`` bounds them)."""
    levels = bfs_levels(edges, start, enough=size)
    first = levels.orderBy("level", "node").limit(size)
    return first.withColumn("number", F.row_number().over(Window.orderBy("level", "node")))


def shortest_path(edges: DataFrame, source: str, target: str, longest: int | None = None) -> DataFrame:
    """(length, path): one shortest path between two nodes, the smallest by node order; empty if there is none (of at most ``longest`` steps, where given).

    Searched from the target, level by level; the path then takes the smallest neighbour one level
    nearer at each step.
    """
    spark = edges.sparkSession
    steps = both_ways(edges.select("src", "dst")).distinct()
    goal = spark.createDataFrame([(target,)], "node string")
    levels = goal.withColumn("level", F.lit(0))
    seen = frontier = cut(levels)
    level = 0
    while seen.where(F.col("node") == source).isEmpty():
        level += 1
        if longest is not None and level > longest:
            return spark.createDataFrame([], "length int, path array<string>")
        found = frontier.select(F.col("node").alias("src")).join(steps, "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            return spark.createDataFrame([], "length int, path array<string>")
        seen = seen.unionByName(frontier)
    path = spark.createDataFrame([(source, [source])], "node string, path array<string>")
    for left in range(level - 1, -1, -1):
        near = seen.where(F.col("level") == left).select(F.col("node").alias("dst"))
        step = path.join(steps.withColumnRenamed("src", "node"), "node").join(near, "dst")
        path = cut(step.groupBy("path").agg(F.min("dst").alias("node")).select("node", F.concat("path", F.array("node")).alias("path")))
    return path.select((F.size("path") - 1).alias("length"), "path")


def graph_stats(nodes: DataFrame, edges: DataFrame, variable: str = "variable(") -> DataFrame:
    """(n_nodes, n_edges, n_variables), variables being nodes whose label contains the given text."""
    n = nodes.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("label").contains(variable)).alias("n_variables"))
    return n.join(edges.agg(F.count("*").alias("n_edges"))).select("n_nodes", "n_edges", "n_variables")


def relabel_edges(edges: DataFrame) -> DataFrame:
    """Add code ``e,<n>`` by the order of labels; the map of labels is small and broadcast by its size."""
    labels = edges.select("label").distinct().withColumn("code", F.concat(F.lit("e,"), F.dense_rank().over(Window.orderBy("label")).cast("string")))
    return edges.join(labels, "label")


def grouped_edges(edges: DataFrame, by: str = "graph_id") -> DataFrame:
    """(graph, edges map<label, array<array<long>>>)."""
    lists = edges.groupBy(by, "label").agg(F.array_sort(F.collect_list(F.array(F.col("src"), F.col("dst")))).alias("pairs"))
    return lists.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "pairs")))).alias("edges"))


def edges_by_target(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, label) with number, their place from 0 by (dst, src, label); equal ones follow each other. Numbered range by range."""
    ordered = edges.withColumns({"__order": F.struct("dst", "src", "label"), "__one": F.lit(1)}).groupBy("src", "dst", "label", "__order").agg(F.sum("__one").alias("__n"))
    placed = running_offsets(ordered, "__order", "__n", "__first")
    each = F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__n") - 1)).alias("number")
    return placed.select("src", "dst", "label", each)


def csr_offsets(edges: DataFrame) -> DataFrame:
    """(node, degree, offset) for nodes with outgoing edges, offsets in node order.

    Running sums are taken within ranges of nodes and shifted by the ranges' totals.
    """
    counts = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return running_offsets(counts, "node", "degree").select("node", "degree", "offset")


def running_offsets(df: DataFrame, order: str, size: str, name: str = "offset") -> DataFrame:
    """Exclusive running sum over a whole table, range by range instead of in one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy("__part").agg(F.sum(size).alias("__total"))
    before = totals.select("__part", (F.sum("__total").over(Window.orderBy("__part")) - F.col("__total")).alias("__before"))
    within = F.sum(size).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    return ranged.withColumn("__within", within).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__within")).drop("__part", "__before", "__within")


def running_within(df: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """Add low, the sum of ``size`` over the rows of the group before this one, and total, that of the group.

    Ranges of (group, order) are summed up apart and shifted by the sums before them, so a group may hold most rows.
    """
    ranged = cut(df.repartitionByRange(group, order).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy("__range", group).agg(F.sum(size).alias("__sum"))
    whole = Window.partitionBy(group)
    before = F.sum("__sum").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sum")
    sums = sums.select("__range", group, before.alias("__before"), F.sum("__sum").over(whole).alias("total"))
    within = F.sum(size).over(Window.partitionBy("__range", group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    return ranged.withColumn("__within", within).join(unsent(sums), ["__range", group]).withColumn("low", F.col("__before") + F.col("__within")).drop("__range", "__within", "__before")


def ancestors(parents: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, ancestor, distance) closure of (node, parent), by rounds until nothing is added, or up to ``depth``."""
    step = parents.select(F.col("node").alias("ancestor"), F.col("parent").alias("next"))
    found = frontier = cut(parents.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    distance = 1
    while depth is None or distance < depth:
        distance += 1
        frontier = cut(frontier.join(step, "ancestor").select("node", F.col("next").alias("ancestor"), F.lit(distance).alias("distance")))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


#: Most nodes of a path of reaches_without; rounds after which the table of what it has seen is made one.
STRIDE, TOGETHER = 64, 16


def reaches_without(edges: DataFrame, starts: DataFrame, stops: DataFrame) -> DataFrame:
    """(origin, node): nodes reached from an origin over directed edges without passing through one of its stops.

    ``starts`` has (origin, node), ``stops`` (origin, node); a stop is reached but not passed. Rounds
    go on until nothing new is found, at any distance. A round walks a path from each open node: an
    edge and the nodes after it as long as there is one way on; paths double from round to round, to
    ``STRIDE`` nodes.
    """
    step = edges.select("src", "dst").distinct()
    single = step.groupBy("src").agg((F.count("*") == 1).alias("one"))
    paths = cut(step.join(single, "src").select("src", "dst", "one", F.array("dst").alias("path")))
    frontier, seen = starts.select("origin", F.col("node").alias("src")).distinct(), None
    length, rounds = 1, 0
    while True:
        walked = frontier.join(paths, "src").select("origin", "src", "dst", F.size("path").alias("size"), F.posexplode("path").alias("pos", "node"))
        halts = walked.join(stops.select("origin", "node"), ["origin", "node"]).groupBy("origin", "src", "dst").agg(F.min("pos").alias("halt"))
        kept = walked.join(halts, ["origin", "src", "dst"], "left").where("halt is null or pos <= halt")
        found = kept.groupBy("origin", "node").agg(F.bool_or(F.col("halt").isNull() & (F.col("pos") == F.col("size") - 1)).alias("open"))
        new = cut(found if seen is None else found.join(seen, ["origin", "node"], "left_anti"))
        frontier = new.where("open").select("origin", F.col("node").alias("src"))
        rounds += 1
        seen = new.select("origin", "node") if seen is None else seen.unionByName(new.select("origin", "node"))
        if frontier.isEmpty():
            return seen
        if rounds % TOGETHER == 0:
            seen = cut(seen)
        if length < STRIDE:
            length *= 2
            more = paths.where("one").select(F.col("src").alias("last"), F.col("path").alias("more"))
            longer = paths.withColumn("last", F.element_at("path", -1)).join(more, "last", "left")
            paths = cut(longer.select("src", "dst", "one", F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path")))


def load(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
