"""Program relations from CSV, graphs as DOT text, and data points as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans import relations as R

NUL = "**NULLBYTE**"
POINT = (
    "struct<anchors:array<string>,anchor:string,trajectories:array<struct<node_types:array<string>,node_values:array<string>,edges:array<string>>>,hints:array<string>,label:string,source:string,"
    "candidates:array<string>,errors:array<string>,targets:array<string>>"
)
TOKEN_GRAPH = (
    "has_bug boolean, bug_kind int, bug_kind_name string, source_tokens array<string>, edges array<array<string>>, label string, error_location int, repair_targets array<int>, repair_candidates array<int>"
)


def read_relation(spark: SparkSession, paths: str | list[str], relation: str, graph_id: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """Rows of one relation with graph_id from the path; header ignored by name, columns by position, zero bytes replaced."""
    df = spark.read.csv(paths, schema=R.schema(relation), header=True, enforceSchema=True, multiLine=True, quote='"', escape='"')
    texts = {f.name: F.replace(f.name, F.lit("\0"), F.lit(NUL)) for f in R.schema(relation).fields if f.dataType.typeName() == "string"}
    return df.withColumns({"graph_id": F.regexp_extract(F.input_file_name(), graph_id, 1), **texts})


def read_program(spark: SparkSession, folder: str, suffix: str = "*.csv", wanted: list[str] | None = None) -> dict[str, DataFrame]:
    """The relations of a folder that the schema knows; other files are ignored."""
    known = wanted or [r for r in R.COLUMNS if r not in R.AUXILIARY]
    listing = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in listing.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(listing)]
    found = {n.split(".")[0]: f"{folder}/{n}" for n in names if n.endswith(suffix.lstrip("*"))}
    return {r: read_relation(spark, found[r], r) for r in known if r in found}


def write_relations(relations: dict[str, DataFrame], folder: str) -> None:
    for name, df in relations.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, line): DOT statements of graphs, labels quoted."""
    quoted = lambda c: F.concat(F.lit('[label="'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"]'))
    n = nodes.select("graph_id", F.concat_ws(" ", F.col("id").cast("string"), quoted(F.col("label"))).alias("line"))
    e = edges.select("graph_id", F.concat(F.col("src").cast("string"), F.lit(" -- "), F.col("dst").cast("string"), F.lit(" "), quoted(F.col("label"))).alias("line"))
    return n.unionByName(e)


def write_dot(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """One folder of statements for each graph; a graph's statements need no order."""
    dot_lines(nodes, edges).write.mode("overwrite").partitionBy("graph_id").text(folder)


def parse_dot(lines: DataFrame, text: str = "value", others: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label) and edges (src, dst, label) of DOT statements."""
    keep = others or []
    label = r'\[label=(?:"((?:[^"\\]|\\.)*)"|([^\]"]*))\]\s*;?\s*$'
    plain = F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(text, label, 1), F.lit("")), F.regexp_extract(text, label, 2)), r'\\(["\\])', "$1")
    edge = r"^\s*(\d+)\s*--\s*(\d+)\s*\["
    node = r"^\s*(\d+)\s*\["
    nodes = lines.where(F.col(text).rlike(node)).select(*keep, F.regexp_extract(text, node, 1).cast("long").alias("id"), plain.alias("label"))
    edges = lines.where(F.col(text).rlike(edge)).select(*keep, F.regexp_extract(text, edge, 1).cast("long").alias("src"), F.regexp_extract(text, edge, 2).cast("long").alias("dst"), plain.alias("label"))
    return nodes, edges


def read_dot(spark: SparkSession, paths: str) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.text(paths).select("value", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("graph_id"))
    return parse_dot(lines, others=["graph_id"])


def read_points(spark: SparkSession, paths: str) -> DataFrame:
    """Data points of JSON files that hold a list each; a single anchor becomes a list of one."""
    texts = spark.read.text(paths, wholetext=True).select(F.explode(F.from_json("value", f"array<{POINT}>")).alias("p")).select("p.*")
    return texts.withColumn("anchors", F.coalesce("anchors", F.when(F.col("anchor").isNotNull(), F.array("anchor")))).drop("anchor")


def read_token_graphs(spark: SparkSession, paths: str) -> DataFrame:
    """Token graphs of JSON lines; edges as (src, dst, type, name)."""
    df = spark.read.schema(TOKEN_GRAPH).json(paths)
    edge = lambda e: F.struct(e[0].try_cast("int").alias("src"), e[1].try_cast("int").alias("dst"), e[2].try_cast("int").alias("type"), e[3].alias("name"))
    return df.withColumn("edges", F.transform("edges", edge))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(label, id) by line of a label file, from 0; a repeated label is an error in the result's ``repeated``."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("id", "label"))
    return lines.groupBy("label").agg(F.min("id").alias("id"), (F.count("*") > 1).alias("repeated"))


def paired_key(name):
    """The common key of a graph file and its stub or walks file."""
    return F.regexp_replace(name, r"^(graph|stubs|stub|walks)[_-](.*?)(\.py)?\.(gv|gvb|json)$", "$2")
