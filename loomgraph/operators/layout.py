"""Places of tokens in their text, and texts laid out again from tokens with places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def placed_tokens(tokens: DataFrame, group: list[str]) -> DataFrame:
    """Tokens (group, pos, spelling) that join to a text, with line (from 1), column (from 0), end_line and end_column.

    Lines are running sums of line feeds; a column counts from behind the last line feed before it,
    which is the largest offset after one so far.
    """
    before = Window.partitionBy(*group).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    feeds = F.length("spelling") - F.length(F.replace("spelling", F.lit("\n"), F.lit("")))
    tail = F.length(F.substring_index("spelling", "\n", -1))
    rows = tokens.withColumns({"__feeds": feeds, "__offset": F.coalesce(F.sum(F.length("spelling")).over(before), F.lit(0))})
    fresh = F.when(F.col("__feeds") > 0, F.col("__offset") + F.length("spelling") - tail)  # where a line begins inside the token, if one does
    rows = rows.withColumn("__fresh", fresh)
    start = F.coalesce(F.max("__fresh").over(before), F.lit(0))
    rows = rows.withColumns({"line": (F.coalesce(F.sum("__feeds").over(before), F.lit(0)) + 1).cast("int"), "column": (F.col("__offset") - start).cast("int")})
    ends = {"end_line": (F.col("line") + F.col("__feeds")).cast("int"), "end_column": F.when(F.col("__feeds") > 0, tail).otherwise(F.col("column") + F.length("spelling")).cast("int")}
    return rows.withColumns(ends).drop("__feeds", "__offset", "__fresh")


def laid_out(tokens: DataFrame, group: list[str]) -> DataFrame:
    """(group, text): the text that tokens (group, pos, spelling, line, column) had, whatever white space between them was dropped.

    What lies between the end of a token and the next is line feeds for the lines between, then
    blanks up to its column. An end token with an empty spelling brings back what follows the last
    one. Tabs come back as blanks, blanks before a line feed don't, and a token that begins before
    the end of the one before follows it directly.
    """
    order = Window.partitionBy(*group).orderBy("pos")
    feeds = F.length("spelling") - F.length(F.replace("spelling", F.lit("\n"), F.lit("")))
    tail = F.length(F.substring_index("spelling", "\n", -1))
    ends = tokens.withColumns({"__line": F.col("line") + feeds, "__column": F.when(feeds > 0, tail).otherwise(F.col("column") + F.length("spelling"))})
    lines = F.greatest(F.col("line") - F.coalesce(F.lag("__line").over(order), F.lit(1)), F.lit(0))
    blanks = F.col("column") - F.when(F.col("__lines") > 0, F.lit(0)).otherwise(F.coalesce(F.lag("__column").over(order), F.lit(0)))
    rows = ends.withColumn("__lines", lines.cast("int")).withColumn("__blanks", F.greatest(blanks, F.lit(0)).cast("int"))
    shown = F.concat(F.repeat(F.lit("\n"), F.col("__lines")), F.repeat(F.lit(" "), F.col("__blanks")), "spelling")
    parts = rows.select(*group, F.struct("pos", shown.alias("shown")).alias("part"))
    return parts.groupBy(*group).agg(F.array_sort(F.collect_list("part")).alias("parts")).select(*group, F.array_join("parts.shown", "").alias("text"))
