"""Ids of word pieces for tokens, and tokens and texts from ids, whole or cut into sentences.

A vocabulary is a bounded list of strings that holds every character it may need, so every piece of
a token has ids: always the longest entry that the rest begins with. A piece is escaped so that an
underscore is only ever its end; a piece of a token that goes on has the sentinel before it. Thus
the strings of consecutive ids, whatever sentences they were cut into, join to a text in which an
underscore behind a sentinel is nothing, and one alone is the end of a token.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.text import MAPPINGS, SENTINEL, unsanitize
from loomgraph.operators.graph import cut

END = "_"
#: What escaping itself needs.
OWN = "\\_u;0123456789"
CACHE = 50_000


def escape_piece(piece: str, alphabet: frozenset[str]) -> str:
    """A piece as the vocabulary spells it; characters that it lacks by their numbers."""
    plain = piece.replace("\\", "\\\\").replace(END, "\\u")
    return "".join(c if c in alphabet else f"\\{ord(c)};" for c in plain) + END


def unescaped(text: Column) -> Column:
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\\u|\\\\|\\[0-9]+;|[^\\]+|\\"), F.lit(0))
    number = lambda x: F.decode(F.unhex(F.lpad(F.hex(F.substring(x, F.lit(2), F.length(x) - 2).try_cast("bigint")), 8, "0")), "UTF-32")
    one = lambda x: F.when(x == "\\u", F.lit(END)).when(x == "\\\\", F.lit("\\")).when(x.rlike(r"^\\[0-9]+;$"), number(x)).otherwise(x)
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def build_vocabulary(pieces: DataFrame, column: str, size: int, characters: int = 4000) -> list[str]:
    """At most ``characters`` most frequent characters, then at most ``size`` most frequent pieces of two or more characters, both by count and spelling.

    What comes to the driver is bounded by the two numbers. Characters that are left out are spelled by their numbers.
    """
    counts = pieces.groupBy(F.col(column).alias("piece")).agg(F.count("*").alias("n")).where(F.length("piece") > 0)
    counts = cut(counts)
    letters = counts.select(F.explode(F.split("piece", "")).alias("c"), "n").where("c <> ''").groupBy("c").agg(F.sum("n").alias("n"))
    alphabet = [r.c for r in letters.orderBy(F.desc("n"), "c").limit(characters).collect()]
    own = [*OWN, *[c for c in alphabet if c not in OWN]]
    known = frozenset(own)
    common = [escape_piece(r.piece, known) for r in counts.where(F.length("piece") > 1).orderBy(F.desc("n"), "piece").limit(size).collect()]
    return own + list(dict.fromkeys(c for c in common if c not in known))


def with_ids(df: DataFrame, pieces: str, vocabulary: list[str], name: str = "ids") -> DataFrame:
    """Add the ids (places in the vocabulary) of an array of pieces, by longest prefixes from the left; null has none."""
    ids = {token: i for i, token in enumerate(vocabulary)}
    alphabet = frozenset(t for t in vocabulary if len(t) == 1)
    lengths = sorted({len(t) for t in vocabulary}, reverse=True)
    at = df.columns.index(pieces)

    def encode(piece: str) -> list[int]:
        rest, start, out = escape_piece(piece, alphabet), 0, []
        while start < len(rest):
            size = next(n for n in lengths if start + n <= len(rest) and rest[start : start + n] in ids)
            out.append(ids[rest[start : start + size]])
            start += size
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        for batch in batches:
            made = []
            for found in batch.column(at).to_pylist():
                row: list[int] = []
                for p in found or ():
                    if (known := cache.get(p)) is None:
                        if len(cache) >= CACHE:
                            cache.clear()
                        known = cache[p] = encode(p)
                    row += known
                made.append(row)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.int32()))], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def in_sentences(df: DataFrame, group: list[str], ids: str, length: int) -> DataFrame:
    """(group, sentence, ids): ids cut into sentences of ``length``, wherever tokens end; no ids are one empty sentence."""
    count = F.greatest(F.ceil(F.size(ids) / F.lit(length)).cast("int"), F.lit(1))
    cuts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(ids, i * length + 1, F.lit(length)))
    return df.select(*group, F.posexplode(cuts).alias("sentence", "ids"))


def spelled(ids: Column, vocabulary: list[str]) -> Column:
    """The strings of ids, joined; an id that the vocabulary lacks is an error."""
    known = F.array(*map(F.lit, vocabulary))
    return F.array_join(F.transform(ids, lambda i: F.element_at(known, i + 1)), "")


def _text(joined: Column, mappings: dict[str, str]) -> Column:
    """What joined strings spell, without the ends of pieces and tokens."""
    whole = F.replace(F.replace(joined, F.lit(SENTINEL + END), F.lit("")), F.lit(END), F.lit(""))
    return unsanitize(unescaped(F.regexp_replace(whole, rf"\{SENTINEL}\z", "")), mappings)


def texts_of_sentences(sentences: DataFrame, group: list[str], vocabulary: list[str], mappings: dict[str, str] = MAPPINGS) -> DataFrame:
    """(group, text) of sentences (group, sentence, ids), in which a token may go on in the next sentence."""
    rows = sentences.select(*group, F.struct("sentence", spelled(F.col("ids"), vocabulary).alias("s")).alias("part"))
    joined = rows.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_list("part")).getField("s"), "").alias("joined"))
    return joined.select(*group, _text(F.col("joined"), mappings).alias("text"))


def tokens_of_sentences(sentences: DataFrame, group: list[str], vocabulary: list[str], mappings: dict[str, str] = MAPPINGS) -> DataFrame:
    """(group, number, token, first, ids, complete): whole tokens of sentences (group, sentence, ids) with where their ids begin and how many they are.

    A token closes with the id that brings an end without a sentinel before it; what stays open at
    the end, as in a sequence that was cut off, is a token that isn't complete. The first row of a
    group is its next whole token, and ``ids`` the length of the prefix that spells it.
    """
    known = sentences.sparkSession.createDataFrame(list(enumerate(vocabulary)), "id int, piece string")
    rows = sentences.select(*group, "sentence", F.posexplode("ids").alias("at", "id")).join(known, "id")
    order = Window.partitionBy(*group).orderBy("sentence", "at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.concat(F.coalesce(F.lag("piece").over(order), F.lit("")), "piece").endswith(SENTINEL + END)
    rows = rows.withColumns({"closes": F.col("piece").endswith(END) & ~goes_on, "place": F.row_number().over(order) - 1})
    rows = rows.withColumn("number", F.coalesce(F.count_if("closes").over(before), F.lit(0)))
    parts = rows.groupBy(*group, "number").agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", "piece"))).getField("piece"), "").alias("joined"), F.min("place").alias("first"), F.count("*").alias("ids"), F.bool_or("closes").alias("complete"))
    return parts.select(*group, "number", _text(F.col("joined"), mappings).alias("token"), "first", "ids", "complete")
