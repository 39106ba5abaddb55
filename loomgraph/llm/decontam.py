"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of 13 consecutive words of the benchmark items (an item of fewer words is
one window). For each pattern length the words' blocks give a shift table: the pair of words under
the end of the search window tells how far no occurrence can end, so most of a text is skipped.
Where the shift is nothing, the bucket of that suffix block holds the patterns to compare with.

The tables are built on the executors from the benchmark's texts, which are sent in blocks of at
most ``block_bytes``; each block is one pass that adds its matches, so a large benchmark needs more
passes, never more memory.

Defined results: null texts and texts without words have no words and no hits; null item texts give
no window; an item repeated under one item_id counts once; a null item_id hits words but names no
item; empty tables give empty results; an input column named like a new one gives way to it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import with_columns

WINDOW = 13
BLOCK_BYTES = 16 << 20
#: Bytes to words: A-Z in lower case, other ASCII that is no digit or letter to a space.
_FOLD = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else ord(chr(b).lower()) if chr(b).isupper() else 32 for b in range(256))
_tables: dict[str, list[WuManber]] = {}


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class WuManber:
    """Occurrences of patterns of one length, which are tuples of words with the ids of their items."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], frozenset]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(dict)
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = self.key(pattern, end)
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.bucket[self.key(pattern, length)][pattern] = items

    def key(self, words, end: int):
        return (words[end - 2], words[end - 1]) if self.block == 2 else words[end - 1]

    def find(self, words: list[bytes]) -> Iterator[tuple[int, frozenset]]:
        end, n, shift, far, length = self.length, len(words), self.shift.get, self.far, self.length
        if self.block == 1:
            for at, word in enumerate(words):
                if (items := self.bucket.get(word, {}).get((word,))) is not None:
                    yield at, items
            return
        while end <= n:
            step = shift((words[end - 2], words[end - 1]), far)
            if step:
                end += step
                continue
            items = self.bucket[words[end - 2], words[end - 1]].get(tuple(words[end - length : end]))
            if items is not None:
                yield end - length, items
            end += 1


def windows(items: list[tuple[object, bytes | None]], window: int = WINDOW) -> list[WuManber]:
    """One searcher for each length of window."""
    patterns: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        words = words_of(text)
        n = min(window, len(words))
        for at in range(len(words) - n + 1 if n else 0):
            patterns[n][tuple(words[at : at + n])].add(item_id)
    return [WuManber(n, {p: frozenset(i) for p, i in found.items()}) for n, found in sorted(patterns.items(), reverse=True)]


def search(searchers: list[WuManber], words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """Merged ranges of words inside an occurrence, and the items with an occurrence."""
    found, items = [], set()
    for searcher in searchers:
        for at, ids in searcher.find(words):
            found.append((at, at + searcher.length))
            items |= ids
    return merged(found), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def item_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[object, bytes | None]]]:
    """The benchmark in blocks of bounded size; partitions come to the driver one after another."""
    block, held = [], 0
    for row in benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).toLocalIterator():
        b = None if row.t is None else row.t.encode()
        if block and held + len(b or b"") > block_bytes:
            yield block
            block, held = [], 0
        block.append((row.i, b))
        held += len(b or b"")
    if block:
        yield block


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, clean_only: bool = False
) -> DataFrame:
    """Add n_words, n_hit, n_items, items_sha256 and contaminated; with ``clean_only`` drop contaminated rows and the new columns."""
    send = docs.sparkSession.sparkContext.broadcast
    blocks = [send((uuid.uuid4().hex, b)) for b in item_blocks(benchmark, item, item_text, block_bytes)]
    fields = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())]

    def tables(block) -> list[WuManber]:
        key, items = block.value
        if key not in _tables:
            _tables.clear()
            _tables[key] = windows(items, window)
        return _tables[key]

    if len(blocks) > 1:  # one pass for each block; its ranges and items are carried along
        ranges, ids = "__hit_ranges", "__hit_items"
        out = docs.withColumn(ranges, F.array().cast("array<struct<s:int,e:int>>")).withColumn(ids, F.array().cast("array<string>"))
        for block in blocks:

            def one(texts: list, block=block) -> list[list]:
                got = [search(tables(block), words_of(t)) for t in texts]
                return [[[{"s": s, "e": e} for s, e in r] for r, _ in got], [[str(i) for i in found if i is not None] for _, found in got]]

            kinds = [(ranges + "1", out.schema[ranges].dataType), (ids + "1", out.schema[ids].dataType)]
            out = with_columns(out, text, kinds, one, as_bytes=True).withColumn(ranges, F.concat(ranges, ranges + "1")).withColumn(ids, F.array_union(ids, ids + "1")).drop(ranges + "1", ids + "1")
        covered = F.aggregate(
            F.array_sort(ranges),
            F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto")),
            lambda a, r: F.struct((a.hit + F.greatest(F.lit(0), r.e - F.greatest(a.upto, r.s))).alias("hit"), F.greatest(a.upto, r.e).alias("upto")),
        ).hit.cast("long")
        out = with_columns(out, text, [("n_words", T.LongType())], lambda texts: [[len(words_of(t)) for t in texts]], as_bytes=True)
        out = out.withColumns({"n_hit": covered, "n_items": F.size(ids).cast("long"), "items_sha256": F.sha2(F.array_join(F.array_sort(ids), ","), 256)})
        out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).drop(ranges, ids)
        return out.where(~F.col("contaminated")).select(docs.columns) if clean_only else out

    def work(texts: list[bytes | None]) -> list[list]:
        searchers = tables(blocks[0]) if blocks else []
        out = []
        for t in texts:
            words = words_of(t)
            ranges, items = search(searchers, words)
            hit = sum(end - start for start, end in ranges)
            names = sorted(str(i) for i in items if i is not None)
            out.append((len(words), hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and 20 * hit >= len(words)))
        return [list(x) for x in zip(*out, strict=True)] or [[] for _ in fields]

    if not clean_only:
        return with_columns(docs, text, fields, work, as_bytes=True)
    dirty = "__contaminated"
    return with_columns(docs, text, [(dirty, T.BooleanType())], lambda texts: [work(texts)[4]], as_bytes=True, keep=lambda made: [not x for x in made[dirty]]).drop(dirty)
