"""Merkle manifests of a table, with proofs for every row.

Each row is a leaf: the digest of its fields. The leaves of a part (a source) stand in the order of
their keys; every ``ARITY`` consecutive nodes become the digest of their hex digests, also in a last
and shorter run, until one node is left, the part's subroot. Subroots in the order of their parts
(null first, then by bytes) become the root in the same way.

Leaves are cut into buckets of ``ARITY ** LEVELS`` places, aligned so that a bucket is a whole
subtree. DuckDB computes the levels of buckets inside the executors, many buckets at a time, as
ordered string_agg and sha256 over an Arrow table; Spark combines the buckets' roots level by level
and joins the steps above a bucket to its leaves. Only digests and keys are ever shuffled: texts are
read once, where they lie. Places come from ranges of rows that are counted apart, so a part that
holds most rows is spread like any other, and every table is bounded: a bucket by its size, a run
by ``ARITY``.

Defined results: a null field is ``-``, any other its UTF-8 byte count, ``:`` and its value; a null
part is a part of its own and the first; null keys come first; rows with the same key stand in the
order of their leaves, and rows that repeat whole are leaves each; a part of one row has its leaf as
subroot; a text of any length is one digest; an empty table gives an empty result. Columns that are
neither key, part nor field play no part and aren't returned, so their names can't clash; key and
part keep their own names, and if one of them is named like a new column the new one wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import trimmed, whole_groups
from loomgraph.tables import settle

ARITY, LEVELS = 3, 8
#: Leaves that DuckDB takes at once, as whole buckets.
GROUP_ROWS = 1 << 14
LIMIT = "512MB"


def digest(*fields: Column) -> Column:
    """Hex digest of a row's fields."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(one, fields)), 256)


def folded(node: Column, steps: Column) -> Column:
    """The root that a node leads to over steps (array of left, right): what verifies a claim against a manifest."""
    return F.aggregate(steps, node, lambda held, step: F.sha2(F.concat(step["left"], held, step["right"]), 256))


def siblings_digest(steps: Column) -> Column:
    """Digest of the siblings on the way to the root, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def placed(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Add place, a row's number from 0 in its group, and n, the rows of the group.

    Ranges of rows are sorted and counted apart and shifted by the counts before them.
    """
    tie = rows.withColumn("__tie", F.monotonically_increasing_id())  # of rows that are alike, so any order will do
    ranged = tie.repartitionByRange(group, *order, "__tie").sortWithinPartitions(group, *order, "__tie").drop("__tie")
    ranged = settle(ranged.withColumn("__row", F.monotonically_increasing_id()), "places").withColumn("__range", F.shiftright("__row", 33))
    counts = ranged.groupBy("__range", group).agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    whole = Window.partitionBy(group)
    before = F.sum("__n").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n") - F.col("__first")
    shift = counts.select(F.col("__range").alias("__r"), F.col(group).alias("__g"), before.alias("__shift"), F.sum("__n").over(whole).alias("n"))
    out = ranged.join(shift, (F.col("__range") == F.col("__r")) & F.col(group).eqNullSafe(F.col("__g")))
    return out.select(*rows.columns, (F.col("__row") + F.col("__shift")).alias("place"), "n")


def numbered_parts(rows: DataFrame, part: str) -> DataFrame:
    """(part, tree, n): the parts numbered from 0 in their order, with their numbers of rows."""
    sizes = rows.groupBy(part).agg(F.count("*").alias("size")).withColumn("all", F.lit(0))
    return placed(sizes, "all", part).select(F.col(part).alias("part"), F.col("place").alias("tree"), F.col("size").alias("n"))


def height(n: Column, levels: int = LEVELS) -> Column:
    """Levels that the buckets of a tree of ``n`` leaves climb: all, or as many as leave one node."""
    out = F.lit(levels)
    for k in range(levels, -1, -1):
        out = F.when(n <= ARITY**k, F.lit(k)).otherwise(out)
    return out


class Buckets:
    """The levels of whole buckets in DuckDB: leaves (tree, bucket, spot, node, height) as an Arrow table."""

    def __init__(self, leaves: pa.Table):
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": LIMIT, "temp_directory": ""})
        self.con.register("leaves", leaves)
        self.con.execute("CREATE TABLE nodes AS SELECT tree, bucket, height, spot AS i, node FROM leaves")
        self.top = self.con.execute("SELECT coalesce(max(height), 0) FROM nodes").fetchall()[0][0]

    def climb(self, level: int) -> None:
        """Replace the nodes by those of the next level; buckets that have reached theirs stay."""
        self.con.execute(
            f"""CREATE OR REPLACE TABLE nodes AS SELECT tree, bucket, height, i // {ARITY} AS i,
                CASE WHEN height >= {level} THEN sha256(string_agg(node, '' ORDER BY i)) ELSE any_value(node) END AS node
                FROM nodes GROUP BY tree, bucket, height, i // {ARITY}"""
        )

    def roots(self) -> pa.Table:
        """(tree, bucket, node)."""
        for level in range(1, self.top + 1):
            self.climb(level)
        return self.con.sql("SELECT tree, bucket, node FROM nodes").to_arrow_table()

    def steps(self) -> pa.Table:
        """(tree, bucket, spot, lefts, rights): for each leaf the siblings before and after its node, level by level."""
        self.con.execute("CREATE TABLE paths AS SELECT tree, bucket, spot, CAST([] AS VARCHAR[]) AS lefts, CAST([] AS VARCHAR[]) AS rights FROM leaves")
        for level in range(1, self.top + 1):
            self.con.execute(
                f"""CREATE OR REPLACE TABLE sides AS SELECT tree, bucket, i, coalesce(string_agg(node, '') OVER before, '') AS l, coalesce(string_agg(node, '') OVER after, '') AS r
                    FROM nodes WHERE height >= {level}
                    WINDOW before AS (PARTITION BY tree, bucket, i // {ARITY} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                           after AS (PARTITION BY tree, bucket, i // {ARITY} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"""
            )
            self.con.execute(
                f"""CREATE OR REPLACE TABLE paths AS SELECT p.tree, p.bucket, spot, CASE WHEN l IS NULL THEN lefts ELSE list_append(lefts, l) END AS lefts,
                    CASE WHEN r IS NULL THEN rights ELSE list_append(rights, r) END AS rights
                    FROM paths p LEFT JOIN sides s ON p.tree = s.tree AND p.bucket = s.bucket AND spot // {ARITY ** (level - 1)} = s.i"""
            )
            self.climb(level)
        return self.con.sql("SELECT tree, bucket, spot, lefts, rights FROM paths ORDER BY tree, bucket, spot").to_arrow_table()


def by_bucket(leaves: DataFrame) -> DataFrame:
    return leaves.repartition("tree", "bucket").sortWithinPartitions("tree", "bucket", "spot")


def bucket_roots(leaves: DataFrame) -> DataFrame:
    """(tree, bucket, node) of leaves (tree, bucket, spot, height, leaf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["tree", "bucket"], GROUP_ROWS):
            yield from Buckets(group).roots().to_batches()

    return by_bucket(leaves.select("tree", "bucket", "spot", "height", F.col("leaf").alias("node"))).mapInArrow(trimmed(run), "tree long, bucket long, node string")


def bucket_steps(leaves: DataFrame) -> DataFrame:
    """``leaves`` with the steps inside their buckets as lefts and rights (arrays of hex digests)."""
    rest = [f for f in leaves.schema.fields if f.name not in ("spot", "height")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", lefts array<string>, rights array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["tree", "bucket"], GROUP_ROWS):  # rows are in the order of the result
            found = Buckets(group.select(["tree", "bucket", "spot", "height", "leaf"]).rename_columns(["tree", "bucket", "spot", "height", "node"])).steps()
            out = group.select([f.name for f in rest])
            for name in ("lefts", "rights"):
                out = out.append_column(name, found[name])
            yield from out.to_batches(max_chunksize=4096)

    return by_bucket(leaves).mapInArrow(trimmed(run), schema)


def combine(nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Tops (tree, node) of trees and the steps of their lowest nodes (tree, i, steps), from nodes (tree, i, n, node); ``most``: largest n.

    One small grouping for each level up, and one join for each level down.
    """
    levels, held = [], nodes
    while most > 1:
        runs = held.groupBy("tree", "n", F.expr(f"i div {ARITY}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("i", "node"))).alias("run"))
        runs = settle(runs, "manifest-level")
        levels.append(runs)
        node = F.when(F.col("n") > 1, F.sha2(F.array_join("run.node", ""), 256)).otherwise(F.col("run")[0]["node"])
        held = runs.select("tree", F.col("up").alias("i"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), node.alias("node"))
        most = -(-most // ARITY)
    none = F.array().cast("array<struct<left:string,right:string>>")
    paths = held.select("tree", "i", none.alias("steps"))
    for runs in reversed(levels):
        around = lambda run, p: F.struct(F.array_join(F.slice(run, 1, p), "").alias("left"), F.array_join(F.slice(run, p + 2, ARITY), "").alias("right"))
        child = runs.select("tree", "up", "n", F.col("run.node").alias("row"), F.posexplode("run").alias("p", "at"))
        child = child.select("tree", "up", F.col("at.i").alias("i"), F.when(F.col("n") > 1, F.array(around(F.col("row"), F.col("p")))).otherwise(none).alias("own"))
        above = paths.select("tree", F.col("i").alias("up"), "steps")
        paths = child.join(above, ["tree", "up"]).select("tree", "i", F.concat("own", "steps").alias("steps"))
    return held.select("tree", "node"), paths


def manifest(docs: DataFrame, key: str, part: str, fields: list[str], claimed: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """(key, part, leaf, claimed, subroot, root, steps): the leaf of each row and its steps (array of left, right) to the root.

    ``claimed`` gives other values for some fields, as a copy of the data claims; the digest of the row with
    these is returned as claimed, to be verified by :func:`folded`. Without, it is the leaf.
    """
    changed = claimed or {}
    leaf, claim = digest(*map(F.col, fields)), digest(*[changed.get(f, F.col(f)) for f in fields])
    rows = settle(docs.select(F.col(key).alias("key"), F.col(part).alias("part"), leaf.alias("leaf"), claim.alias("claimed")), "leaves")
    parts = settle(numbered_parts(rows, "part"), "parts")
    total = parts.agg(F.count("*").alias("trees"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    size = ARITY**levels
    # the order of trees is that of their parts, and tells a null part without comparing nulls
    tree = parts.select("tree", F.col("part").alias("__part"), F.col("n").alias("__size"))
    leaves = placed(rows, "part", "key", "leaf").join(tree, F.col("part").eqNullSafe(F.col("__part"))).select(
        "key", "part", "tree", F.expr(f"place div {size}").alias("bucket"), (F.col("place") % size).alias("spot"), height(F.col("__size"), levels).alias("height"), "leaf", "claimed"
    )
    leaves = settle(leaves, "placed-leaves")
    buckets = bucket_roots(leaves).join(parts.select("tree", F.expr(f"(n + {size - 1}) div {size}").alias("n")), "tree")
    subroots, inner = combine(buckets.select("tree", F.col("bucket").alias("i"), "n", "node"), -(-total.most // size))
    subroots = settle(subroots, "subroots")
    tops, outer = combine(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("i"), F.lit(total.trees).alias("n"), "node"), total.trees)
    above = outer.join(tops.withColumnRenamed("node", "root"), "tree").select(F.col("i").alias("tree"), F.col("steps").alias("last"), "root")
    above = above.join(subroots.select("tree", F.col("node").alias("subroot")), "tree")
    paths = settle(inner.join(above, "tree").select("tree", F.col("i").alias("bucket"), F.concat("steps", "last").alias("outer"), "subroot", "root"), "outer-steps")
    within = F.zip_with("lefts", "rights", lambda left, right: F.struct(left.alias("left"), right.alias("right")))
    out = bucket_steps(leaves).join(paths, ["tree", "bucket"])
    named = {key: F.col("key"), part: F.col("part")} | {c: F.col(c) for c in ("leaf", "claimed", "subroot", "root")} | {"steps": F.concat(within, F.col("outer"))}
    return out.select(*[c.alias(name) for name, c in named.items()])


def verified(found: DataFrame) -> DataFrame:
    """Add proof_sha256, folded_root (from what is claimed) and verified to a manifest, in place of its steps."""
    out = found.withColumns({"proof_sha256": siblings_digest(F.col("steps")), "folded_root": folded(F.col("claimed"), F.col("steps"))})
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).drop("steps")
