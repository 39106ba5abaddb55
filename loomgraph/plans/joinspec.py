"""Join specifications: which columns of which relations link rows of a database into a tuple graph."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Link:
    """One predicate: a row of ``left`` and a row of ``right`` are linked if the two columns are equal."""

    left: str
    left_column: str
    right: str
    right_column: str

    @property
    def label(self) -> str:
        return "({},{})".format(*sorted([f"{self.left}.{self.left_column}", f"{self.right}.{self.right_column}"]))


def link(text: str) -> Link:
    """``"a.x <-> b.y"`` (any number of dashes) as a Link."""
    found = re.fullmatch(r"\s*(\w+)\.(\w+)\s*<-+>\s*(\w+)\.(\w+)\s*", text)
    if not found:
        raise ValueError(f"not a link: {text!r}")
    return Link(*found.groups())


def by_position(links: list[Link], columns: dict[str, list[str]]) -> list[Link]:
    """Links whose columns are positions, with the names the relations give them."""
    name = lambda rel, at: columns[rel][int(at)]
    return [Link(x.left, name(x.left, x.left_column), x.right, name(x.right, x.right_column)) for x in links]


def key_columns(links: list[Link]) -> dict[str, list[str]]:
    """Columns of each relation that any link mentions."""
    found: dict[str, set[str]] = {}
    for x in links:
        found.setdefault(x.left, set()).add(x.left_column)
        found.setdefault(x.right, set()).add(x.right_column)
    return {rel: sorted(names) for rel, names in found.items()}


def spec_table(spark: SparkSession, links: list[Link], columns: dict[str, list[str]]) -> DataFrame:
    """(lrel, lpos, rrel, rpos, label) in both directions; one row for each link and direction, so always small."""
    rows = set()
    for x in links:
        left = (x.left, columns[x.left].index(x.left_column))
        right = (x.right, columns[x.right].index(x.right_column))
        rows |= {(*left, *right, x.label), (*right, *left, x.label)}
    return spark.createDataFrame(sorted(rows), "lrel string, lpos int, rrel string, rpos int, label string")


#: The star schema of the test tables as a tuple graph: key columns, and links.
STAR_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
STAR_LINKS = [
    link("nation.n_regionkey <-> region.r_regionkey"),
    link("customer.c_nationkey <-> nation.n_nationkey"),
    link("supplier.s_nationkey <-> nation.n_nationkey"),
    link("orders.o_custkey <-> customer.c_custkey"),
]
LINE_LINKS = [
    link("lineitem.l_orderkey <-> orders.o_orderkey"),
    link("lineitem.l_partkey <-> part.p_partkey"),
    link("lineitem.l_suppkey <-> supplier.s_suppkey"),
]
