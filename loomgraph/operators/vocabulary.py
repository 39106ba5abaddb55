"""Dictionaries with deterministic ids, encoding, and feature assembly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import running_offsets

PAD, UNKNOWN = 0, 1
RESERVED = ["__pad__", "__unknown__"]
#: Characters of texts that are encoded in one group, on average.
GROUP = 4_000_000


def token_positions(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, pos, token) of an array column."""
    return docs.select(key, F.posexplode(words).alias("pos", "token"))


def vocabulary(tokens: DataFrame, order: list[str], reserved: list[str] = RESERVED) -> DataFrame:
    """(token, id): reserved tokens first, then tokens in the order (``order``) they are first seen.

    The first place of each token is one aggregation; numbering is by ranges of places, not in one task.
    """
    first = tokens.groupBy("token").agg(F.min(F.struct(*order) if len(order) > 1 else order[0]).alias("first"), F.lit(1).alias("one"))
    numbered = running_offsets(first, "first", "one", "n").select("token", (F.col("n") + len(reserved)).cast("long").alias("id"))
    fixed = tokens.sparkSession.createDataFrame(list(zip(reserved, range(len(reserved)), strict=True)), "token string, id long")
    return fixed.unionByName(numbered)


def encoded(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Tokens with ids, UNKNOWN for those not in the vocabulary."""
    return tokens.join(vocab, "token", "left").withColumn("id", F.coalesce("id", F.lit(UNKNOWN).cast("long")))


def padded_ids(tokens: DataFrame, key: str, length: int) -> DataFrame:
    """(key, ids): the first ``length`` ids by position, padded."""
    rows = tokens.where(F.col("pos") < length).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("s"))
    ids = F.transform("s", lambda x: x.id)
    return rows.select(key, F.concat(ids, F.array_repeat(F.lit(PAD).cast("long"), F.greatest(F.lit(length) - F.size("s"), F.lit(0)))).alias("ids"))


def padded_blocks(tokens: DataFrame, key: str, width: int) -> DataFrame:
    """(key, block, ids): all ids by position in rows of ``width``, the last one padded; a long text has many rows and no task holds it whole."""
    placed = tokens.withColumn("block", F.floor(F.col("pos") / width).cast("int")).groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("s"))
    ids = F.transform("s", lambda x: x.id)
    return placed.select(key, "block", F.concat(ids, F.array_repeat(F.lit(PAD).cast("long"), F.lit(width) - F.size("s"))).alias("ids"))


def encoded_blocks(docs: DataFrame, key: str, text: str, vocab: DataFrame, width: int) -> DataFrame:
    """(key, block, ids): the ids of all words between blanks in rows of ``width``, as text with a blank between them.

    What :func:`padded_blocks` gives, without a row for each token: texts are dealt to groups by a hash of
    their key, a group asks once for the id of each of its distinct words, and encodes its texts where the
    answers meet them. Each row of ``docs`` is a text of its own; of several ids of a word the smallest counts.
    """
    known = docs.select(key, text).where(F.col(text).isNotNull())
    characters = known.agg(F.sum(F.length(text))).first()[0] or 0
    dealt = known.withColumn("group", F.pmod(F.xxhash64(key), F.lit(1 + characters // GROUP)))
    asked = dealt.select("group", text).repartition("group").select("group", F.explode(F.split(text, " ")).alias("token")).distinct()
    answers = encoded(asked, vocab).select(F.col("group").alias("asking"), "token", "id")

    def encode(texts: pa.Table, ids: pa.Table) -> pa.Table:
        ids = ids.sort_by("id")
        words = pc.split_pattern(texts[text].combine_chunks(), " ")
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        found = pc.index_in(pc.list_flatten(words), value_set=ids["token"].combine_chunks())
        spelled = pc.take(ids["id"].combine_chunks().cast(pa.string()), found)
        blocks = -(-counts // width)
        of_text = np.repeat(np.arange(len(counts)), blocks)
        number = np.arange(len(of_text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        size = np.minimum(width, counts[of_text] - number * width)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), spelled), " ")
        pads = pc.binary_repeat(f" {PAD}", pa.array(width - size))
        return pa.table({key: texts[key].take(pa.array(of_text)), "block": pa.array(number, pa.int32()), "ids": pc.binary_join_element_wise(joined, pads, "")})

    schema = f"`{key}` {dict(docs.dtypes)[key]}, block int, ids string"
    return dealt.groupBy("group").cogroup(answers.groupBy("asking")).applyInArrow(encode, schema)


def coo(tokens: DataFrame, key: str) -> DataFrame:
    """(row, token_id, value): counts of ids in a row as coordinates."""
    return tokens.groupBy(F.col(key).alias("row"), F.col("id").alias("token_id")).agg(F.count("*").alias("value"))


def variable_slots(count: int, limit: int = 100) -> list[str]:
    return [f"var_{i}" for i in range(min(count, limit))]


def label_map(labels: DataFrame, label: str) -> DataFrame:
    """(label, id) by label order; repeated labels count once."""
    return labels.select(F.col(label).alias("label")).distinct().withColumn("id", (F.row_number().over(Window.orderBy("label")) - 1).cast("long"))


def shared_digests(texts: DataFrame, split: str, key: str, digest: str) -> DataFrame:
    """(split_a, split_b, digest, n_a, n_b): digests found in two splits."""
    each = texts.groupBy(F.col(split).alias("s"), F.col(digest).alias("digest")).agg(F.count(key).alias("n"))
    a = each.select(F.col("s").alias("split_a"), "digest", F.col("n").alias("n_a"))
    b = each.select(F.col("s").alias("split_b"), "digest", F.col("n").alias("n_b"))
    return a.join(b, "digest").where("split_a < split_b").select("split_a", "split_b", "digest", "n_a", "n_b")


def repeated_in_split(texts: DataFrame, split: str, key: str, digest: str) -> DataFrame:
    """(split, digest, n, first, last) of digests that a split holds more than once."""
    return texts.groupBy(split, digest).agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last")).where("n > 1")


def first_difference(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Add line and column (from 1) of the first difference of two texts, and the words there; null where equal.

    Lines are compared as arrays, so a pair stays in one row.
    """
    a, b = F.split(left, "\n"), F.split(right, "\n")
    lines = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))
    out = pairs.withColumn("line", F.get(lines, F.lit(0)) + 1)
    x, y = F.coalesce(F.get(a, F.col("line") - 1), F.lit("")), F.coalesce(F.get(b, F.col("line") - 1), F.lit(""))
    out = out.withColumns({"__x": x, "__y": y})
    same = F.filter(F.sequence(F.lit(1), F.least(F.length("__x"), F.length("__y")) + 1), lambda i: F.substring(F.col("__x"), i, F.lit(1)) != F.substring(F.col("__y"), i, F.lit(1)))
    place = F.coalesce(F.get(same, F.lit(0)), F.least(F.length("__x"), F.length("__y")) + 1)
    out = out.withColumn("column", F.when(F.col("line").isNotNull(), place))
    word = lambda text: F.concat(F.regexp_extract(F.substring(F.col(text), F.lit(1), F.col("column") - 1), r"(\w*)$", 1), F.regexp_extract(F.substring(F.col(text), F.col("column"), F.length(text)), r"^(\w*)", 1))
    return out.withColumns({"left_word": word("__x"), "right_word": word("__y")}).drop("__x", "__y")
