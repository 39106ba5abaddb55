"""Audit of how the sources of a language differ in their words, by mergeable radix tries.

Terms are runs of ASCII letters (lower-cased) and of characters beyond ASCII. Each task counts the
terms of its documents in one byte trie a language, whose leaves hold, for each source, the number
of occurrences and of documents. A trie is kept as its leaves in depth-first order, which is UTF-8
order, with the lengths of the prefixes that neighbours share: these are its inner nodes. Tries are
cut into the subtrees below ``DEPTH`` bytes, and the subtrees of a prefix, from all tasks, meet in
one task that merges them; a prefix with too many leaves is cut deeper first. Terms in too few
documents go as the merged subtree is walked.

A second walk over the terms that are left, again range by range, compares the sources. Each range
gets the totals of its languages' sources as the first rows of a language, so nothing is broadcast.
The walk streams the partial sums of each pair of sources and, for each source, its ``top`` terms by
value; as terms come in UTF-8 order, a term never displaces an earlier one of the same value. Sums
and candidates of the ranges are then combined. All numbers are exact: 64 bits in a range, decimals above.

Memory: a task's tries are handed on at ``TRIE_ENTRIES`` counters, merging folds as many at a time, a
prefix has at most ``PREFIX_ENTRIES`` counters unless it is a single term, and a walk holds one block
of terms and one square of sources, as large as the result for its language. A text is held whole, with its words.

Defined results: null text, language and source are empty strings; a group (language, source) counts
even if it has no term; a language without terms that are kept has value 0 for all its pairs; ties
are ordered by the UTF-8 bytes of the item; repeated rows and ids count each, so do texts of any
length; an empty table gives an empty result; columns other than the three don't matter.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import by_bytes, in_parts, trimmed
from loomgraph.tables import discard, settle

MIN_DOCS, TOP = 30, 50
SCALE, EXTRA = 1_000_000_000, 5
#: Bytes of the prefixes that subtrees are dealt by at first.
DEPTH = 2
TRIE_ENTRIES, PREFIX_ENTRIES = 1 << 21, 1 << 22
#: Terms of a walk that are compared at once, by the number of their counters.
BLOCK_COUNTERS = 1 << 20
#: Parts that candidates are sifted in before the last ranking.
SIEVES = 16
_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def _sorted_distinct(terms: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct terms in byte order, and the place there of each term."""
    coded = terms.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy(zero_copy_only=False)]


class Trie:
    """A byte trie as its leaves in depth-first order.

    ``terms`` (binary, distinct, in byte order) are the paths to the leaves; the counters of leaf i
    are entries ``starts[i]`` to ``starts[i + 1]`` of ``source`` (numbers into ``sources``), ``n`` and ``docs``.
    """

    def __init__(self, terms: pa.Array, starts: np.ndarray, sources: list[str], source: np.ndarray, n: np.ndarray, docs: np.ndarray):
        self.terms, self.starts, self.sources, self.source, self.n, self.docs = terms, starts, sources, source, n, docs

    @staticmethod
    def of_texts(texts: pa.Array, owners: np.ndarray, sources: list[str]) -> Trie:
        """Counts of the terms of texts; ``owners`` are the numbers of the texts' sources, ascending."""
        words = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=_BETWEEN)
        doc = np.repeat(np.arange(len(texts)), words.value_lengths().to_numpy(zero_copy_only=False))
        found = words.flatten()
        real = pc.greater(pc.binary_length(found), 0)
        doc, found = doc[real.to_numpy(zero_copy_only=False)], found.filter(real)
        terms, place = _sorted_distinct(found.cast(pa.binary()))
        pairs, times = np.unique(place * len(texts) + doc, return_counts=True)  # each term in each text
        place, owner = pairs // max(len(texts), 1), owners[pairs % max(len(texts), 1)]
        first = np.flatnonzero(np.diff(place, prepend=-1) | np.diff(owner, prepend=-1))
        n = np.add.reduceat(times, first) if len(first) else times
        return Trie(terms, np.searchsorted(place[first], np.arange(len(terms) + 1)), sources, owner[first], n.astype(np.int64), np.diff(first, append=len(pairs)))

    @staticmethod
    def merged(tries: list[Trie]) -> Trie:
        """One trie with the sums of the counters."""
        if len(tries) == 1:
            return tries[0]
        sources = sorted({s for t in tries for s in t.sources})
        number = {s: i for i, s in enumerate(sources)}
        terms, place = _sorted_distinct(pa.concat_arrays([t.terms for t in tries]))
        lengths = np.concatenate([np.diff(t.starts) for t in tries])
        source = np.concatenate([np.array([number[s] for s in t.sources], np.int64)[t.source] for t in tries])
        key = np.repeat(place, lengths) * max(len(sources), 1) + source
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        total = lambda x: np.add.reduceat(np.concatenate(x)[order], first) if len(first) else np.zeros(0, np.int64)
        place, source = key[first] // max(len(sources), 1), key[first] % max(len(sources), 1)
        return Trie(terms, np.searchsorted(place, np.arange(len(terms) + 1)), sources, source, total([t.n for t in tries]), total([t.docs for t in tries]))

    def shared(self, depth: int) -> np.ndarray:
        """Bytes, up to ``depth``, that each leaf's path shares with the leaf before: where it branches off."""
        offsets = np.frombuffer(self.terms.buffers()[1], np.int32)[self.terms.offset : self.terms.offset + len(self.terms) + 1]
        data = np.frombuffer(self.terms.buffers()[2], np.uint8) if self.terms.buffers()[2] else np.zeros(0, np.uint8)
        out = np.zeros(len(self.terms), np.int64)
        at = np.arange(1, len(self.terms))
        for k in range(depth):
            at = at[(offsets[at + 1] - offsets[at] > k) & (offsets[at] - offsets[at - 1] > k)]
            at = at[data[offsets[at] + k] == data[offsets[at - 1] + k]]
            out[at] = k + 1
        return out

    def subtrees(self, depth: int) -> Iterator[tuple[bytes, bool, Trie]]:
        """The subtrees below the first ``depth`` bytes: prefix, whether the prefix is all of a single term, and the subtree."""
        lengths = pc.binary_length(self.terms).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((self.shared(depth) < np.minimum(lengths, depth)) | (lengths < depth))
        for low, high in zip(cuts, np.append(cuts[1:], len(self.terms)), strict=True):
            a, b = self.starts[low], self.starts[high]
            prefix = self.terms[int(low)].as_py()[:depth]
            yield prefix, lengths[low] < depth, Trie(self.terms.slice(low, high - low), self.starts[low : high + 1] - a, self.sources, self.source[a:b], self.n[a:b], self.docs[a:b])

    def pack(self) -> bytes:
        """Sizes, then lengths and bytes of the terms, numbers of counters, counters, and the names of their sources."""
        used, source = np.unique(self.source, return_inverse=True)
        names = json.dumps([self.sources[i] for i in used]).encode()
        lengths = pc.binary_length(self.terms).to_numpy(zero_copy_only=False).astype(np.int32)
        text = b"".join(self.terms.to_pylist()) if len(self.terms) < 32 else _bytes_of(self.terms)
        sizes = np.array([len(lengths), len(source), len(text)], np.int64)
        return b"".join([sizes.tobytes(), lengths.tobytes(), np.diff(self.starts).astype(np.int32).tobytes(), source.astype(np.int32).tobytes(), self.n.astype(np.int64).tobytes(), self.docs.astype(np.int64).tobytes(), text, names])

    @staticmethod
    def unpack(data: bytes) -> Trie:
        leaves, entries, size = np.frombuffer(data, np.int64, 3)
        at = 24

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        lengths, counts, source, n, docs = take(np.int32, leaves), take(np.int32, leaves), take(np.int32, entries), take(np.int64, entries), take(np.int64, entries)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        terms = pa.Array.from_buffers(pa.binary(), int(leaves), [None, pa.py_buffer(offsets), pa.py_buffer(data[at : at + size])])
        return Trie(terms, np.concatenate([[0], np.cumsum(counts)]), json.loads(data[at + size :]), source.astype(np.int64), n, docs)

    def walk(self) -> Iterator[tuple[str, list[str], list[int], list[int]]]:
        """Terms in UTF-8 order with the sources, occurrences and documents of their counters."""
        names = [self.sources[i] for i in self.source]
        n, docs = self.n.tolist(), self.docs.tolist()
        for term, a, b in zip(self.terms.cast(pa.string()).to_pylist(), self.starts.tolist(), self.starts[1:].tolist(), strict=False):
            yield term, names[a:b], n[a:b], docs[a:b]

    def at_least(self, docs: int) -> Trie:
        """The leaves whose counters add up to so many documents."""
        total = np.add.reduceat(self.docs, self.starts[:-1]) if len(self.terms) else self.docs
        keep = total >= docs
        inside = np.repeat(keep, np.diff(self.starts))
        starts = np.concatenate([[0], np.cumsum(np.diff(self.starts)[keep])])
        return Trie(self.terms.filter(pa.array(keep)), starts, self.sources, self.source[inside], self.n[inside], self.docs[inside])


def _bytes_of(terms: pa.Array) -> bytes:
    offsets = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1]
    return terms.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes()


class Pile:
    """Tries to be merged, folded into one whenever they hold ``most`` counters more than the one they were last folded into."""

    def __init__(self, most: int):
        self.most, self.tries, self.held = most, [], 0

    def add(self, trie: Trie) -> None:
        self.tries.append(trie)
        self.held += len(trie.n)
        if self.held > self.most:
            self.tries, self.held = [Trie.merged(self.tries)], 0

    def merged(self) -> Trie:
        return Trie.merged(self.tries)


#: A subtree of a task's trie; depth is null where the prefix can't be cut deeper. Rows without prefix name the group (lang, pack).
SUBTREE = "lang string, prefix binary, depth int, entries long, pack binary"
SUBTREE_ARROW = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("depth", pa.int32()), ("entries", pa.int64()), ("pack", pa.binary())])


def _cut(lang: str, trie: Trie, depth: int) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for prefix, single, part in trie.subtrees(depth):
        rows.append((lang, prefix, None if single else depth, len(part.n), part.pack()))
        size += len(rows[-1][-1])
        if size > 1 << 22:
            yield _batch(rows, SUBTREE_ARROW)
            rows, size = [], 0
    yield _batch(rows, SUBTREE_ARROW)


def count_terms(docs: DataFrame, text: str, lang: str, source: str, depth: int = DEPTH, most: int = TRIE_ENTRIES) -> DataFrame:
    """The subtrees (:data:`SUBTREE`) of the tasks' tries, and a row without prefix for each group (lang, source) of a task."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c2) for c, c2 in ((text, "text"), (lang, "lang"), (source, "source"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piles: dict[str, Pile] = defaultdict(lambda: Pile(most // 4))
        held, groups = 0, set()
        for part in (p for batch in batches for p in in_parts(batch, 0)):
            langs, sources = (np.array(c.to_pylist(), dtype=object) for c in part.columns[1:])
            groups |= set(zip(langs, sources, strict=True))
            for name in sorted(set(langs)):
                of = np.flatnonzero(langs == name)
                names, owners = np.unique(sources[of].astype(str), return_inverse=True)
                order = np.argsort(owners, kind="stable")
                trie = Trie.of_texts(part.column(0).take(pa.array(of[order])), owners[order], [str(s) for s in names])
                piles[name].add(trie)
                held += len(trie.n)
            if held >= most:
                for name in sorted(piles):
                    yield from _cut(name, piles[name].merged(), depth)
                piles.clear()
                held = 0
        for name in sorted(piles):
            yield from _cut(name, piles[name].merged(), depth)
        yield _batch([(name, None, None, 0, s.encode()) for name, s in sorted(groups)], SUBTREE_ARROW)

    return rows.mapInArrow(trimmed(run), SUBTREE)


def cut_deeper(subtrees: DataFrame, most: int = PREFIX_ENTRIES) -> DataFrame:
    """Subtrees whose prefixes hold at most ``most`` counters each, unless a prefix is a single term: others are cut at twice the depth, again and again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, _, depth, _, pack in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _cut(lang, Trie.unpack(pack), 2 * depth)

    done, names = None, ["lang", "prefix", "depth"]
    while True:
        crowded = settle(subtrees.where("depth is not null").groupBy(*names).agg(F.sum("entries").alias("n")).where(F.col("n") > most).select(*names), "crowded")
        if crowded.isEmpty():
            discard(crowded)
            return subtrees if done is None else done.unionByName(subtrees)
        same = [subtrees[c].eqNullSafe(crowded[c]) for c in names]
        rest = subtrees.join(crowded, same, "left_anti")
        done = rest if done is None else done.unionByName(rest)
        subtrees = settle(subtrees.join(crowded, same, "left_semi").mapInArrow(trimmed(run), SUBTREE), "deeper")


def merged_terms(subtrees: DataFrame, min_docs: int = MIN_DOCS, most: int = TRIE_ENTRIES) -> DataFrame:
    """(lang, term, sources, counts, part): the terms in at least ``min_docs`` documents of their language, one row each.

    ``part`` is the task, which holds whole prefixes of its languages.
    """
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def kept(lang: str, pile: Pile) -> pa.RecordBatch:
        return _batch([(lang, term, sources, n) for term, sources, n, _ in pile.merged().at_least(min_docs).walk()], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pile = None, Pile(most)
        for batch in batches:
            for lang, prefix, pack in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, prefix) != now:
                    if now is not None:
                        yield kept(now[0], pile)
                    now, pile = (lang, prefix), Pile(most)
                pile.add(Trie.unpack(pack))
        if now is not None:
            yield kept(now[0], pile)

    dealt = subtrees.select("lang", "prefix", "pack").repartition("lang", "prefix").sortWithinPartitions("lang", "prefix")
    return dealt.mapInArrow(trimmed(run), "lang string, term string, sources array<string>, counts array<long>").withColumn("part", F.spark_partition_id())


class Walk:
    """Comparison of the sources of one language over terms in UTF-8 order."""

    def __init__(self, lang: str, sources: list[str], totals: list[int], terms: int, top: int):
        self.lang, self.sources, self.top = lang, sources, top
        self.place = {s: i for i, s in enumerate(sources)}
        self.below = [n + EXTRA * terms for n in totals]
        self.all_below = sum(totals) + EXTRA * terms
        self.sums = np.zeros((len(sources), len(sources)), np.int64)
        self.best: list[tuple[np.ndarray, list[str]]] = [(np.zeros(0, np.int64), []) for _ in sources]
        self.terms: list[str] = []
        self.counts: list[tuple[list[str], list[int]]] = []
        self.spilled: list[list[tuple]] = []

    def add(self, term: str, sources: list[str], counts: list[int]) -> None:
        self.terms.append(term)
        self.counts.append((sources, counts))
        if len(self.terms) * len(self.sources) >= BLOCK_COUNTERS:
            self.compare()

    def compare(self) -> None:
        """Add the block to the sums and candidates."""
        if not self.terms:
            return
        n = np.zeros((len(self.terms), len(self.sources)), np.int64)
        for row, (sources, counts) in enumerate(self.counts):
            n[row, [self.place[s] for s in sources]] = counts
        p = np.stack([_share(n[:, i], self.below[i]) for i in range(len(self.sources))], axis=1)
        q = _share(n.sum(1), self.all_below)
        for i in range(len(self.sources)):
            self.sums[i] += np.abs(p - p[:, i : i + 1]).sum(0)
            over = np.flatnonzero((n[:, i] > 0) & (p[:, i] > q))
            values, names = self.best[i]
            values = np.concatenate([values, p[over, i] - q[over]])
            names = names + [self.terms[j] for j in over]
            first = np.argsort(-values, kind="stable")[: self.top]  # earlier terms first among equals
            first.sort()
            self.best[i] = values[first], [names[j] for j in first]
        # differences are at most SCALE, so sums of 2 ** 32 terms fit; they are handed on long before
        if self.sums.max(initial=0) > 1 << 61:
            self.hand_on()
        self.terms, self.counts = [], []

    def hand_on(self) -> None:
        rows = [(self.lang, s, "pair", o, int(self.sums[i, j])) for i, s in enumerate(self.sources) for j, o in enumerate(self.sources) if i != j]
        self.spilled.append(rows)
        self.sums[:] = 0

    def rows(self) -> list[tuple]:
        self.compare()
        self.hand_on()
        found = [(self.lang, s, "term", t, int(v)) for s, (values, names) in zip(self.sources, self.best, strict=True) for v, t in zip(values, names, strict=True)]
        return [r for rows in self.spilled for r in rows] + found


def _share(counts: np.ndarray, below: int) -> np.ndarray:
    """1 + floor(SCALE * (count + EXTRA) / below), exactly; in Python's integers where 64 bits don't hold the product."""
    if (int(counts.max(initial=0)) + EXTRA) * SCALE < 1 << 63:
        return 1 + (counts + EXTRA) * SCALE // below if below < 1 << 63 else np.ones(len(counts), np.int64)
    return np.array([1 + SCALE * (int(c) + EXTRA) // below for c in counts], np.int64)


def compared(terms: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value) of all ranges: partial sums of pairs, and each range's first ``top`` terms of each source.

    ``groups`` has (lang, source, n, terms): a group's occurrences of kept terms and the number of the language's kept terms.
    """
    whole = groups.groupBy("lang", "terms").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("s"))
    heads = terms.select("part", "lang").distinct().join(whole, "lang")
    heads = heads.select("part", "lang", F.lit(None).cast("string").alias("term"), F.col("s.source").alias("sources"), F.col("s.n").alias("counts"), "terms")
    rows = terms.select("part", "lang", "term", "sources", "counts", F.lit(None).cast("long").alias("terms")).unionByName(heads)
    ordered = rows.repartition("part", "lang").sortWithinPartitions("part", "lang", "term")  # null first: the totals
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in batches:
            for _, lang, term, sources, counts, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if term is None:
                    if walk is not None:
                        yield from _batches(walk.rows(), schema)
                    walk = Walk(lang, sources, counts, n, top)
                else:
                    walk.add(term, sources, counts)
        if walk is not None:
            yield from _batches(walk.rows(), schema)

    return ordered.mapInArrow(trimmed(run), "lang string, source string, part string, item string, value long")


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each pair of sources is apart (part pair), and the terms each uses more than its language (part term)."""
    found = settle(count_terms(docs, text, lang, source), "subtrees")
    present = found.where("prefix is null").select("lang", F.col("pack").cast("string").alias("source")).distinct()
    terms = settle(merged_terms(cut_deeper(found.where("prefix is not null")), min_docs), "kept-terms")
    each = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = present.join(each, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("terms", F.lit(0)).alias("terms"))
    groups = settle(groups, "groups")
    partial = settle(compared(terms, groups, top), "partial-values")
    sums = partial.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")  # the result's own rows
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    order = [F.desc("value"), "item"]
    sieve = F.row_number().over(Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(SIEVES))).orderBy(*order))
    candidates = partial.where("part = 'term'").withColumn("n", sieve).where(F.col("n") <= top).drop("n")
    both = pairs.unionByName(candidates)
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*order))
    return both.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _batches(rows: list[tuple], schema: pa.Schema, size: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    for start, end in by_bytes([1] * len(rows), size):
        yield _batch(rows[start:end], schema)
