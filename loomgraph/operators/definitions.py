"""Definitions of variables in control flow: redefinition inside and across basic blocks, and definitions nobody reads.

Definitions are rows (graph_id, node, variable, block, position): a node that gives a variable a
value, at a position of its basic block. Blocks are linked by rows (graph_id, block, next).
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.dataflow import rank_in_block, redefinitions
from loomgraph.operators.graph import cut, reaches_without
from loomgraph.operators.quantified import ignorable_name

PLACE = ["graph_id", "variable", "block"]
#: Kinds of statements and expressions whose names count as assignments.
ASSIGNING = ("Assign", "AugAssign", "Tuple")
#: Most rows (definitions by block, links of blocks) of a graph that is searched in one group.
AT_ONCE = 100_000
#: Rounds after which the table of what was reached is made one.
TOGETHER = 16


def reached_blocks(definitions: DataFrame, successors: DataFrame, defining_only: bool = False) -> DataFrame:
    """(graph_id, variable, origin, block): blocks that control reaches from a defining block without another definition on the way.

    Only variables with two or more definitions take part. A block that defines the variable is
    reached but not passed, so a search never goes beyond the nearest definitions, and only the
    first and last definition of a block matter to it; loops end as nothing is reached twice. With
    ``defining_only`` blocks that don't define the variable are left out.

    Graphs of up to ``AT_ONCE`` rows are searched where their rows meet, in one shuffle; larger ones
    in rounds of joins.
    """
    defining = cut(definitions.groupBy(*PLACE).agg(F.count("*").alias("n")))
    steps = cut(successors.select("graph_id", "block", "next").distinct())
    rows = defining.select("graph_id").unionByName(steps.select("graph_id")).groupBy("graph_id").agg(F.count("*").alias("rows"))
    large = cut(rows.where(F.col("rows") > AT_ONCE).select("graph_id"))
    if large.isEmpty():
        return _searched_at_once(defining, steps, defining_only)
    rest = lambda df, how: df.join(F.broadcast(large), "graph_id", how)
    found = _searched_in_rounds(rest(defining, "left_semi"), rest(steps, "left_semi"))
    if defining_only:
        found = found.join(rest(defining, "left_semi").select(*PLACE), PLACE, "left_semi")
    return _searched_at_once(rest(defining, "left_anti"), rest(steps, "left_anti"), defining_only).unionByName(found)


def _searched_at_once(defining: DataFrame, steps: DataFrame, defining_only: bool) -> DataFrame:
    """The search of :func:`reached_blocks` in graphs that are whole in a group."""
    kinds = dict(defining.dtypes)
    schema = f"graph_id {kinds['graph_id']}, variable {kinds['variable']}, origin {kinds['block']}, block {kinds['block']}"

    def search(defined: pa.Table, flow: pa.Table) -> pa.Table:
        onward, holds, several = defaultdict(list), defaultdict(set), Counter()
        for block, after in zip(flow["block"].to_pylist(), flow["next"].to_pylist(), strict=True):
            if after is not None:
                onward[block].append(after)
        for variable, block, n in zip(defined["variable"].to_pylist(), defined["block"].to_pylist(), defined["n"].to_pylist(), strict=True):
            several[variable] += n
            if block is not None:
                holds[variable].add(block)
        out: list[tuple] = []
        for variable, halts in holds.items():
            for origin in halts if variable is not None and several[variable] > 1 else ():
                seen, ahead = set(), [origin]
                while ahead:
                    for block in onward.get(ahead.pop(), ()):
                        if block not in seen:
                            seen.add(block)
                            if block not in halts:
                                ahead.append(block)
                out += [(variable, origin, block) for block in (seen & halts if defining_only else seen)]
        graph = defined["graph_id"].slice(0, 1).to_pylist() * len(out)
        columns = [graph, *map(list, zip(*out, strict=True))] if out else [[]] * 4
        types = [defined.schema.field(c).type if defined.num_columns else pa.null() for c in ("graph_id", "variable", "block", "block")]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["graph_id", "variable", "origin", "block"])

    known = defining.where("graph_id is not null").groupBy("graph_id")
    return known.cogroup(steps.where("graph_id is not null").groupBy("graph_id")).applyInArrow(search, schema)


def _searched_in_rounds(defining: DataFrame, steps: DataFrame) -> DataFrame:
    """The search of :func:`reached_blocks`, a step of all open blocks in each round."""
    several = defining.groupBy("graph_id", "variable").agg(F.sum("n").alias("n")).where("n > 1")
    starts = defining.join(several.select("graph_id", "variable"), ["graph_id", "variable"], "left_semi")
    halts = defining.select(*PLACE)
    frontier = starts.select("graph_id", "variable", F.col("block").alias("origin"), "block")
    seen, rounds, keys = None, 0, ["graph_id", "variable", "origin", "block"]
    while True:
        found = frontier.join(steps, ["graph_id", "block"]).select("graph_id", "variable", "origin", F.col("next").alias("block")).distinct()
        new = cut(found if seen is None else found.join(seen, keys, "left_anti"))
        seen = new if seen is None else seen.unionByName(new)
        frontier = new.join(halts, PLACE, "left_anti")
        rounds += 1
        if frontier.isEmpty():
            return seen
        if rounds % TOGETHER == 0:
            seen = cut(seen)


def all_redefinitions(definitions: DataFrame, successors: DataFrame) -> DataFrame:
    """(graph_id, definition, redefinition): the definitions that may be next to replace a definition's value.

    Inside a block that is the next one by position; from the last of a block, the first of each
    block reached. A definition is never its own redefinition, even in a loop.
    """
    inside = redefinitions(definitions, PLACE, ["position"], "node").select("graph_id", "definition", "redefinition")
    ranked = rank_in_block(definitions, PLACE, ["position"]).select(*PLACE, "node", "is_first", "is_last")
    last = ranked.where("is_last").select("graph_id", "variable", F.col("block").alias("origin"), F.col("node").alias("definition"))
    first = ranked.where("is_first").select(*PLACE, F.col("node").alias("redefinition"))
    across = last.join(reached_blocks(definitions, successors, defining_only=True), ["graph_id", "variable", "origin"]).join(first, PLACE)
    return inside.unionByName(across.where("definition <> redefinition").select("graph_id", "definition", "redefinition")).distinct()


def unreplaced_definitions(definitions: DataFrame, successors: DataFrame) -> DataFrame:
    """Definitions (with all columns) whose node is no definition in :func:`all_redefinitions`; rows without graph_id are left out.

    A graph of up to ``AT_ONCE`` rows is searched where its rows meet, each definition until it meets
    another one, so only what is never replaced leaves the group and no pair does. Larger graphs are
    searched as in :func:`reached_blocks`.
    """
    known = definitions.where("graph_id is not null")
    steps = cut(successors.select("graph_id", "block", "next").distinct())
    rows = known.select("graph_id").unionByName(steps.select("graph_id")).groupBy("graph_id").agg(F.count("*").alias("rows"))
    large = cut(rows.where(F.col("rows") > AT_ONCE).select("graph_id"))
    if large.isEmpty():
        return _unreplaced_at_once(known, steps)
    rest = lambda df, how: df.join(F.broadcast(large), "graph_id", how)
    replaced = all_redefinitions(rest(known, "left_semi"), rest(steps, "left_semi")).select("graph_id", F.col("definition").alias("node")).distinct()
    found = rest(known, "left_semi").join(replaced, ["graph_id", "node"], "left_anti").select(*definitions.columns)
    return _unreplaced_at_once(rest(known, "left_anti").select(*definitions.columns), rest(steps, "left_anti")).unionByName(found)


def _unreplaced_at_once(definitions: DataFrame, steps: DataFrame) -> DataFrame:
    """The search of :func:`unreplaced_definitions` in graphs that are whole in a group."""
    names, of_block = definitions.columns, Window.partitionBy(*PLACE)
    ranked = definitions.withColumn("__rank", F.rank().over(of_block.orderBy("position")))
    ranked = ranked.withColumns({"__first": F.col("__rank") == 1, "__last": F.col("__rank") == F.max("__rank").over(of_block)}).drop("__rank")

    def search(defined: pa.Table, flow: pa.Table) -> pa.Table:
        onward, firsts, others, replaced = defaultdict(list), defaultdict(set), defaultdict(set), set()
        for block, after in zip(flow["block"].to_pylist(), flow["next"].to_pylist(), strict=True):
            if after is not None:
                onward[block].append(after)
        nodes = defined["node"].to_pylist()
        rows = list(zip(defined["variable"].to_pylist(), defined["block"].to_pylist(), nodes, defined["__first"].to_pylist(), defined["__last"].to_pylist(), strict=True))
        rows = [r for r in rows if r[0] is not None and r[1] is not None]
        for variable, block, node, first, last in rows:
            if first:
                firsts[variable, block].add(node)
                others[variable].add(node)
            if not last:
                replaced.add(node)

        def meets_another(variable, block, node) -> bool:
            seen, ahead = set(), [block]
            while ahead:
                for after in onward.get(ahead.pop(), ()):
                    if after not in seen:
                        seen.add(after)
                        halts = firsts.get((variable, after))
                        if halts is None:
                            ahead.append(after)
                        elif not halts <= {node, None}:
                            return True
            return False

        for variable, block, node, _, last in rows:
            if last and node not in replaced and not others[variable] <= {node, None} and meets_another(variable, block, node):
                replaced.add(node)
        return defined.select(names).filter(pa.array([node is None or node not in replaced for node in nodes], pa.bool_()))

    return ranked.groupBy("graph_id").cogroup(steps.where("graph_id is not null").groupBy("graph_id")).applyInArrow(search, definitions.schema)


def unread_definitions(definitions: DataFrame, variables: DataFrame, read: DataFrame, dumping: DataFrame) -> DataFrame:
    """Definitions (with their scope) whose value is read nowhere.

    ``read`` has the nodes (graph_id, node) of definitions with a use; ``variables`` (graph_id,
    variable, own_scope, escapes); ``dumping`` the scopes (graph_id, scope) that read all their
    variables at once. A definition outside its variable's scope, or of a variable that escapes,
    may be read elsewhere and doesn't count.
    """
    own = variables.where(~F.coalesce(F.col("escapes"), F.lit(False))).select("graph_id", "variable", F.col("own_scope").alias("scope"))
    out = definitions.join(read.select("graph_id", "node"), ["graph_id", "node"], "left_anti")
    return out.join(own, ["graph_id", "variable", "scope"], "left_semi").join(dumping.select("graph_id", "scope"), ["graph_id", "scope"], "left_anti")


def relevant_definitions(definitions: DataFrame) -> DataFrame:
    """Definitions (with name, parent_kind, decorated) that are assignments to a name not meant to be unused."""
    return definitions.where(_relevant())


def _relevant():
    return F.col("parent_kind").isin(*ASSIGNING) & ~ignorable_name(F.col("name")) & ~F.coalesce(F.col("decorated"), F.lit(False))


def unused_names(definitions: DataFrame, successors: DataFrame, variables: DataFrame, read: DataFrame, dumping: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """(graph_id, expr, variable): names whose every definition is relevant, unread and never replaced.

    A name has the definitions of its expression (expr); ``shared`` has variables (graph_id, variable)
    that other scopes rebind. A name in a tuple (parent_kind Tuple, parent) counts only if all names
    of the tuple do.
    """
    lean = definitions.select(*PLACE, "node", "position", "scope", _relevant().alias("relevant"))
    good = unread_definitions(unreplaced_definitions(lean, successors).where("relevant"), variables, read, dumping)
    if shared is not None:
        good = good.join(shared.select("graph_id", "variable"), ["graph_id", "variable"], "left_anti")
    marked = definitions.join(good.select("graph_id", "node", F.lit(True).alias("good")), ["graph_id", "node"], "left")
    tuple_ = F.max(F.when(F.col("parent_kind") == "Tuple", F.col("parent")))
    names = marked.groupBy("graph_id", "expr").agg(F.bool_and(F.coalesce("good", F.lit(False))).alias("unused"), F.min("variable").alias("variable"), tuple_.alias("tuple"))
    names = cut(names.where("unused or tuple is not null"))  # read twice
    broken = names.where("not unused and tuple is not null").select("graph_id", "tuple").distinct()
    return names.where("unused").join(broken, ["graph_id", "tuple"], "left_anti").select("graph_id", "expr", "variable")


def leaked_uses(iterations: DataFrame, uses: DataFrame, flow: DataFrame) -> DataFrame:
    """(graph_id, node, use): uses of a comprehension's variable outside it, which control reaches after the comprehension.

    ``iterations`` and ``uses`` have (graph_id, name, scope, node); a use counts if name and scope are
    the same and its node is reached from the comprehension's over one or more steps of ``flow`` (graph_id, src, dst).
    """
    at = lambda c: F.struct("graph_id", F.col(c).alias("node"))
    pairs = iterations.join(uses.select("graph_id", "name", "scope", F.col("node").alias("use")), ["graph_id", "name", "scope"])
    starts = pairs.select(at("node").alias("origin"), at("node").alias("node")).distinct()
    reached = reaches_without(flow.select(at("src").alias("src"), at("dst").alias("dst")), starts, starts.limit(0))
    reached = reached.select("origin.graph_id", F.col("origin.node").alias("node"), F.col("node.node").alias("use"))
    return pairs.join(reached, ["graph_id", "node", "use"], "left_semi").select("graph_id", "node", "use").distinct()
