"""Anchors and labels of the program tasks, and graphs of Python syntax trees."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import ancestors

#: The kind of a name expression, and of contexts that store.
NAME_KIND, STORE_KINDS = 18, (1, 4, 5)
#: Classes of exceptions.
EXCEPTIONS = (
    "ArithmeticError",
    "AssertionError",
    "AttributeError",
    "Exception",
    "HTTPError",
    "IOError",
    "ImportError",
    "IndexError",
    "KeyError",
    "KeyboardInterrupt",
    "NameError",
    "NotImplementedError",
    "OSError",
    "ObjectDoesNotExist",
    "RuntimeError",
    "StopIteration",
    "TypeError",
    "UnicodeDecodeError",
    "ValidationError",
    "ValueError",
)


def stored_names(exprs: DataFrame, contexts: DataFrame) -> DataFrame:
    """Name expressions that some context stores."""
    stores = contexts.where(F.col("kind").isin(*STORE_KINDS)).select("graph_id", F.col("parent").alias("id")).distinct()
    return exprs.where(F.col("kind") == NAME_KIND).join(stores, ["graph_id", "id"], "left_semi")


def definition_labels(exprs: DataFrame, contexts: DataFrame, unused: DataFrame) -> DataFrame:
    """(graph_id, id, label): each definition is used or unused; ``unused`` has (graph_id, id)."""
    found = unused.select("graph_id", "id").distinct().withColumn("hit", F.lit(True))
    return stored_names(exprs, contexts).join(found, ["graph_id", "id"], "left").select("graph_id", "id", F.when(F.col("hit"), "unused").otherwise("used").alias("label"))


def program_labels(definitions: DataFrame) -> DataFrame:
    """(graph_id, anchors, label): a program is unused if any of its definitions is."""
    return definitions.groupBy("graph_id").agg(F.array_sort(F.collect_list("id")).alias("anchors"), F.when(F.bool_or(F.col("label") == "unused"), "unused").otherwise("used").alias("label"))


def exception_anchors(stmts: DataFrame, holes: DataFrame) -> DataFrame:
    """Statements that are holes in all four columns."""
    return stmts.join(holes, ["graph_id", "id", "kind", "parent", "idx"], "left_semi")


def handler_holes(handlers: DataFrame, types: DataFrame, names: DataFrame, name: str = "HoleException") -> DataFrame:
    """Handlers (id, type) whose type expression is, or holds at any depth, a name; ``types`` is (node, parent), ``names`` (node, name)."""
    named = names.where(F.col("name") == name).select("node")
    above = ancestors(types).select("node", F.col("ancestor").alias("type")).join(named, "node", "left_semi").select("type")
    return handlers.join(above.unionByName(named.select(F.col("node").alias("type"))).distinct(), "type", "left_semi")


def shadowing(local: DataFrame, outer: DataFrame, limit: int = 10) -> DataFrame:
    """Local variables with the name of an outer one, at most ``limit`` in each graph."""
    hit = local.join(outer.select("graph_id", "name").distinct(), ["graph_id", "name"], "left_semi")
    return hit.withColumn("__n", F.row_number().over(Window.partitionBy("graph_id").orderBy("id"))).where(F.col("__n") <= limit).drop("__n")


def misuse_anchors(places: DataFrame, locations: DataFrame, owners: DataFrame, exprs: DataFrame) -> DataFrame:
    """(graph_id, id): the smallest expression at a place (four coordinates), over locations and their owners."""
    at = ["graph_id", "beginLine", "beginColumn", "endLine", "endColumn"]
    found = places.join(locations, at).select("graph_id", F.col("id").alias("location"))
    held = found.join(owners.select("graph_id", F.col("id").alias("location"), F.col("parent").alias("id")), ["graph_id", "location"])
    return held.join(exprs.select("graph_id", "id"), ["graph_id", "id"]).groupBy("graph_id").agg(F.min("id").alias("id"))


def syntax_graph(sources: DataFrame, key: str, code: str) -> DataFrame:
    """(key, kind, a, b, name, line, column): 'node' rows (a its number from 0, name its type), 'edge' rows (a to child b) and one 'error' row for source that can't be parsed."""

    def rows(source: str) -> list[tuple]:
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError):
            return [("error", 0, 0, "", 0, 0)]
        out, numbers, todo = [], {}, [(tree, None)]
        while todo:
            node, parent = todo.pop()
            numbers[id(node)] = number = len(numbers)
            out.append(("node", number, 0, type(node).__name__, getattr(node, "lineno", 0), getattr(node, "col_offset", 0)))
            if parent is not None:
                out.append(("edge", parent, number, "Child", 0, 0))
            for name in ("id", "attr", "arg", "name"):
                if isinstance(value := getattr(node, name, None), str):
                    out.append(("value", number, 0, value, getattr(node, "lineno", 0), getattr(node, "col_offset", 0)))
                    break
            todo += [(child, number) for child in reversed([*ast.iter_child_nodes(node)]) if not isinstance(child, ast.expr_context)]
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(k, *row) for k, text in zip(frame[key], frame[code], strict=True) for row in rows(text or "")]
            yield pd.DataFrame(found, columns=[key, "kind", "a", "b", "name", "line", "column"])

    kind = sources.schema[key].dataType.simpleString()
    return sources.select(key, code).mapInPandas(run, f"{key} {kind}, kind string, a int, b int, name string, line int, column int")


def leaves(children: DataFrame) -> DataFrame:
    """(node) that are no parent, of (node, parent)."""
    return children.select("node").join(children.select(F.col("parent").alias("node")), "node", "left_anti")


def leaf_paths(paths_up: DataFrame, longest: int, seed: str = "0") -> DataFrame:
    """(graph_id, path): between two leaves of each graph drawn by hash, up to the root and down; a window of ``longest`` steps drawn likewise.

    ``paths_up`` has (graph_id, leaf, path) with paths from a leaf to the root.
    """
    order = F.md5(F.concat_ws("|", F.lit(seed), "graph_id", F.col("leaf").cast("string")))
    ranked = paths_up.withColumn("n", F.row_number().over(Window.partitionBy("graph_id").orderBy(order, "leaf"))).where("n <= 2")
    pair = ranked.groupBy("graph_id").agg(F.min_by("path", "n").alias("up"), F.max_by("path", "n").alias("down"), F.count("*").alias("c")).where("c = 2")
    whole = pair.select("graph_id", F.concat(F.slice("up", F.lit(1), F.size("up") - 1), F.reverse("down")).alias("whole"))
    room = F.greatest(F.size("whole") - longest, F.lit(0))
    start = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "graph_id")), 1, 7), 16, 10).cast("long"), room + 1).cast("int")
    return whole.select("graph_id", F.slice("whole", start + 1, F.lit(longest)).alias("path"))


# relations of syntax trees: nodes have (graph_id, node, name, line, column), children (graph_id, node, parent)


def subtree(children: DataFrame, depth: int | None = None) -> DataFrame:
    """(graph_id, root, node, distance) of all nodes below each node, at most ``depth`` levels down."""
    keyed = children.select(F.struct("graph_id", "node").alias("node"), F.struct("graph_id", "parent").alias("parent"))
    found = ancestors(keyed, depth)
    return found.select(F.col("node.graph_id").alias("graph_id"), F.col("ancestor.parent").alias("root"), F.col("node.node").alias("node"), "distance")


def returns_to(nodes: DataFrame, children: DataFrame, depth: int | None = None) -> DataFrame:
    """(graph_id, src, dst): from each return to the nearest function around it (within ``depth`` levels)."""
    above = subtree(children, depth)
    functions = nodes.where(F.col("name").isin("FunctionDef", "AsyncFunctionDef", "Lambda")).select("graph_id", F.col("node").alias("root"))
    returns = nodes.where(F.col("name") == "Return").select("graph_id", "node")
    held = above.join(functions, ["graph_id", "root"], "left_semi").join(returns, ["graph_id", "node"], "left_semi")
    return held.groupBy("graph_id", F.col("node").alias("src")).agg(F.min_by("root", "distance").alias("dst"))


def computed_from(assigned: DataFrame, names: DataFrame) -> DataFrame:
    """(graph_id, src, dst): from each assigned variable to the variables its value names; both sides carry the assignment's node (statement)."""
    right = names.select("graph_id", "statement", F.col("node").alias("dst"))
    return assigned.select("graph_id", "statement", F.col("node").alias("src")).join(right, ["graph_id", "statement"]).select("graph_id", "src", "dst")


def guarded_by(branch_names: DataFrame, guard_names: DataFrame, negated: bool = False) -> DataFrame:
    """(graph_id, src, dst, label): from each variable in a branch to the guard (condition) that names it too."""
    guards = guard_names.select("graph_id", "branch", "name", F.col("condition").alias("dst")).distinct()
    label = "GuardedByNegation" if negated else "GuardedBy"
    return branch_names.select("graph_id", "branch", "name", F.col("node").alias("src")).join(guards, ["graph_id", "branch", "name"]).select("graph_id", "src", "dst", F.lit(label).alias("label"))


def categories(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """(graph_id, label, pairs) for every graph and kind, empty where a graph has no such edge."""
    spark = edges.sparkSession
    frame = edges.select("graph_id").distinct().join(F.broadcast(spark.createDataFrame([(k,) for k in kinds], "label string")))
    lists = edges.groupBy("graph_id", "label").agg(F.array_sort(F.collect_list(F.array(F.col("src"), F.col("dst")))).alias("pairs"))
    empty = F.array().cast(lists.schema["pairs"].dataType)
    return frame.join(lists, ["graph_id", "label"], "left").select("graph_id", "label", F.coalesce("pairs", empty).alias("pairs"))


def neighbouring_files(files: DataFrame, number: str, label: str, other: str) -> DataFrame:
    """Each file with the file of the other label that has the next or the previous number."""
    there = files.where(F.col(label) == other).select(F.explode(F.array(F.col(number) - 1, F.col(number) + 1)).alias(number), F.struct(*files.columns).alias("partner"))
    return files.where(F.col(label) != other).join(there, number)


#: Operators by the names of their syntax nodes.
OPERATORS = {
    "Add": "+", "Sub": "-", "Mult": "*", "Div": "/", "Mod": "%", "Pow": "**", "LShift": "<<", "RShift": ">>", "BitOr": "|", "BitXor": "^", "BitAnd": "&", "FloorDiv": "//",
    "Eq": "==", "NotEq": "!=", "Lt": "<", "LtE": "<=", "Gt": ">", "GtE": ">=", "Not": "not",
}


def operator_symbol(name):
    """Column: the symbol of an operator node, null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in OPERATORS.items() for x in pair]), name)


def masked(code, column, word, mask: str = "___CURR___"):
    """Column: the first occurrence of a word at or after a column (from 0) replaced by a mask."""
    rest = F.substring(code, column + 1, F.length(code))
    at = F.instr(rest, word)
    return F.when(at > 0, F.concat(F.substring(code, F.lit(1), column + at - 1), F.lit(mask), F.substring(rest, at + F.length(word), F.length(code)))).otherwise(code)


def sentences(tokens: DataFrame, group: str = "doc") -> DataFrame:
    """(group, sentence, tokens): tokens (group, pos, kind, spelling) cut after each NEWLINE; a NEWLINE alone is a sentence of its own."""
    before = Window.partitionBy(group).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    numbered = tokens.withColumn("sentence", F.coalesce(F.count_if(F.col("kind") == "NEWLINE").over(before), F.lit(0)))
    lists = numbered.groupBy(group, "sentence").agg(F.array_sort(F.collect_list(F.struct("pos", "spelling"))).alias("s"))
    return lists.select(group, "sentence", F.transform("s", lambda x: x.spelling).alias("tokens"))
