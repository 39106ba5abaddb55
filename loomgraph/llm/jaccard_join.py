"""Exact n-gram Jaccard join by count-vector R-trees, reduced to connected components.

A text's set holds its distinct shingles of five words (hashed to 64 bits). Shingles are hashed
into groups, and the counts of a set in the groups are a point; the sum of the coordinate minima of
two points bounds the overlap of their sets, and likewise of a point and a box of points.

1. *Classes.* Texts with equal sets are one class, named by the sets' digest; only classes go on.
2. *Meeting.* Two sets with a similarity of 0.8 share k of the first ``n - ceil(0.8 n) + k``
   shingles of each in any one order; k grows with n, so long texts need many. The order here puts shingles that are frequent in a sample
   last, which changes what is cheap and never what is found. Classes meet at shared keys.
3. *Leaders.* At every key each class is first tried against the class there that shares most of its
   own keys with others; most copies of one text are linked so, with as many tries as copies.
4. *R-trees.* Keys at which classes of different components still meet are indexed (large ones in
   blocks, so no task holds a whole hot key); searches skip boxes whose bound is too small or whose
   points are all of the searching class's own component. Pairs that survive at k keys are verified.
5. Links of both rounds give the components; labels spread over tables in the shared folder.

Defined results: null or empty texts and texts without words have empty sets, are linked with
nothing and are their own component; rows that share a doc_id count as linked; a null doc_id never
names a component (alone, its component is null); texts of fewer than five words have one shingle;
very long texts are taken whole; an empty table gives an empty result; other input columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import by_bytes, text_bytes, trimmed, with_columns
from loomgraph.tables import discard, settle

SHINGLE = 5
#: Coordinates of a point and their ceiling; points in a leaf of a tree; classes in one block of a hot key.
GROUPS, CEILING = 96, 65535
LEAF, BLOCK = 32, 2000
#: Keys of at most so many classes are not searched but give their pairs as they are.
FEW = 8
#: Bits of the bitmap that selects texts (8 MB).
FILTER_BITS = 1 << 26
#: Bytes of texts whose sets are made at once.
TEXT_BYTES = 1 << 20
#: Sample that tells frequent shingles: texts, texts it takes to be frequent, and most shingles kept.
SAMPLE, FREQUENT, MOST_FREQUENT = 4000, 8, 100_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_P = np.uint64(0x100000001B3)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        up, down = np.full(size, _P), np.full(size, inverse)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def shingle_sets(texts: list[bytes | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    lengths = np.array([len(t or b"") + 1 for t in texts], np.int64)
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    starts, ends = edges[0::2], edges[1::2]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M2)
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    whole = np.zeros(max(0, len(words) - shingle + 1), np.uint64)
    for i in range(shingle):
        whole = mix(whole * _M1 + words[i : len(whole) + i])
    out = []
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        if last - first >= shingle:
            out.append(np.unique(whole[first : last - shingle + 1]))
        elif last > first:
            h = np.array([last - first], np.uint64)
            for i in range(first, last):
                h = mix(h * _M1 + words[i])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(found: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    if not len(found):
        return 0
    spread = mix(found ^ _M2)
    both = np.array([np.add.reduce(spread), np.bitwise_xor.reduce(mix(spread))], np.uint64) * np.array([1, _M1], np.uint64)
    return int(mix(both[:1] + both[1:] + np.array([len(found)], np.uint64)).view(np.int64)[0])


def point(found: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Counts in the groups; one at the ceiling stands for any larger one."""
    return np.minimum(np.bincount((found % np.uint64(groups)).astype(np.int64), minlength=groups), CEILING).astype(np.uint16)


def points_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, GROUPS)


def bound(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Largest overlap that the points allow; without limit where both are at the ceiling."""
    low = np.minimum(p, q)
    total = low.sum(1, dtype=np.int64)
    return np.where(low.max(1, initial=0) == CEILING, 1 << 60, total)


def sizes_fit(n_a, n_b):
    """Column condition: sets of these sizes can be similar."""
    return (5 * F.least(n_a, n_b)) >= (4 * F.greatest(n_a, n_b))


def needed_keys(n):
    """Keys that a similar pair shares at least, for its smaller need; from 1 up with the size of a set."""
    return 1 + n // 40


def prefix(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + k shingles, frequent ones last: similar sets share k of them, k being the smaller need of both."""
    n = len(found)
    size = n - (4 * n + 4) // 5 + needed_keys(n) if n else 0
    if len(frequent) and n:
        at = np.searchsorted(frequent, found)
        late = frequent[np.minimum(at, len(frequent) - 1)] == found
        found = np.concatenate([found[~late], found[late]])
    return found[:size]


def may_link(overlap: np.ndarray, n_a, n_b) -> np.ndarray:
    """Whether an overlap of at most ``overlap`` allows a similarity of 0.8."""
    return overlap >= (4 * (n_a + n_b) + 8) // 9


class CountTree:
    """R-tree over count vectors, packed by sorting; nodes hold coordinate maxima, smallest size and one component or -1."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, components: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((points[:, 1], points[:, 0], sizes))
        self.order, self.points, self.components, self.sizes = order, points[order], components[order], sizes[order]
        self.levels = [self._pack(self.points, self.sizes, self.components, leaf)]
        while len(self.levels[-1][0]) > leaf:
            self.levels.append(self._pack(*self.levels[-1][:3], leaf))
        self.leaf = leaf

    @staticmethod
    def _pack(high: np.ndarray, small: np.ndarray, components: np.ndarray, leaf: int):
        at = np.arange(0, len(high), leaf)
        low_c, high_c = np.minimum.reduceat(components, at), np.maximum.reduceat(components, at)
        mixed = (low_c != high_c) | (np.minimum.reduceat(components, at) < 0)
        return np.maximum.reduceat(high, at), np.minimum.reduceat(small, at), np.where(mixed, -1, low_c)

    def search(self, p: np.ndarray, n: int, component: int) -> np.ndarray:
        """Numbers of points of other components that the bound leaves."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, small, owner = self.levels[depth]
            fits = may_link(bound(high[nodes], p), n, small[nodes]) & (owner[nodes] != component)
            below = len(self.points) if depth == 0 else len(self.levels[depth - 1][0])
            nodes = (nodes[fits][:, None] * self.leaf + np.arange(self.leaf)).ravel()
            nodes = nodes[nodes < below]
        fits = may_link(bound(self.points[nodes], p), n, self.sizes[nodes]) & (self.components[nodes] != component)
        return self.order[nodes[fits]]


def _each_set(docs: DataFrame, columns: str, rows) -> DataFrame:
    """``rows(ids, sets)`` yields a record batch for the texts of (id, text) in about TEXT_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for start, end in by_bytes((len(t or b"") for t in texts), TEXT_BYTES):
                yield rows(batch.column(0).slice(start, end - start), shingle_sets(texts[start:end]))

    return docs.mapInArrow(trimmed(run), columns)


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n, class, point) of (doc_id, text)."""

    def rows(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        arrays = [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.int64()), pa.array([point(s).tobytes() for s in sets], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "class", "point"])

    return _each_set(docs, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, class long, point binary", rows)


def frequent_shingles(docs: DataFrame, count: int) -> np.ndarray:
    """Shingles of many texts of a bounded sample, sorted; at most MOST_FREQUENT reach the driver."""
    share = min(1 << 20, (SAMPLE << 20) // max(1, count) + 1)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share)
    each = _each_set(sample, "s long", lambda ids, sets: pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["s"]))
    top = each.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).select("s").toArrow()
    return np.sort(top["s"].to_numpy().view(np.uint64))


def meeting_keys(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(key, class, n) for the prefix of each set; a task sends a class once, however many copies it reads."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for start, end in by_bytes((len(t or b"") for t in texts), TEXT_BYTES):
                unique = {d: s for s in shingle_sets(texts[start:end]) if len(s) and (d := digest(s)) not in seen}
                seen.update(unique)
                if not unique:
                    continue
                keys = [prefix(s, sent.value) for s in unique.values()]
                each = [len(k) for k in keys]
                names, sizes = np.fromiter(unique, np.int64, len(unique)), np.array([len(s) for s in unique.values()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(names, each)), pa.array(np.repeat(sizes, each))], names=["key", "class", "n"])

    return docs.mapInArrow(trimmed(run), "key long, class long, n long")


def among(docs: DataFrame, chosen: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``docs`` whose doc_id may be one of ``chosen``: a bitmap of id hashes drops most others before texts travel.

    The bitmap has a fixed size; with more ids it lets more rows through, and the join that follows decides.
    """
    place = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    one = F.expr("shiftleft(1L, cast(h % 64 as int))")
    words = chosen.where("doc_id is not null").select(place().alias("h")).groupBy(F.floor(F.col("h") / 64).cast("int").alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(2).to_numpy()
            hit = (sent.value[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1)
            yield batch.select([0, 1]).filter(pa.array(hit.astype(bool)))

    return docs.select("doc_id", "text", place().alias("h")).mapInArrow(run, docs.schema)


def bounded_pairs(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (a, b) that the bound leaves."""
    named = lambda x: points.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("point").alias(f"p{x}"))
    both = pairs.join(named("a"), "a").join(named("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left = may_link(bound(points_of(batch.column("pa")), points_of(batch.column("pb"))), batch.column("na").to_numpy(), batch.column("nb").to_numpy())
                yield batch.select(["a", "b"]).filter(pa.array(left))

    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, homes: DataFrame, purpose: str, block: int = BLOCK // 4) -> DataFrame:
    """A table of the pairs of classes with a similarity of 0.8 or more, compared by their whole sets.

    ``members`` has (doc_id, class) with one text of each class; sets are made anew for the classes
    in question only, and found by their digests where all texts of a class have null ids. Pairs are compared in cells: classes near the same leader (``homes``: class,
    home) are dealt into blocks, and a cell holds the sets of two blocks, so a set travels once for
    each block that its class meets, not once for each pair.
    """
    wanted = settle(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "wanted")
    placed = wanted.join(homes, "class", "left").select("class", F.coalesce("home", "class").alias("home"))
    blocks = placed.groupBy("home").agg(F.ceil(F.count("*") / block).alias("blocks"))
    placed = settle(placed.join(blocks, "home").select("class", F.xxhash64("home", F.pmod(F.xxhash64("class"), F.col("blocks"))).alias("block")), "placed")
    at = lambda x: placed.select(F.col("class").alias(x), F.col("block").alias(f"block_{x}"))
    cell = F.xxhash64(F.least("block_a", "block_b"), F.greatest("block_a", "block_b"))
    dealt = settle(pairs.join(at("a"), "a").join(at("b"), "b").select(cell.alias("cell"), "a", "b"), "dealt")

    chosen = settle(wanted.join(members, "class").select("doc_id", "class"), "chosen")
    texts = among(docs, chosen).join(chosen, "doc_id").select("class", "text")

    def rows(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array([digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "own", "set"])

    made = _each_set(texts, "class long, own long, set binary", rows).where("class = own").drop("own")
    nameless = wanted.join(members.where("doc_id is null"), "class", "left_semi")
    if not nameless.isEmpty():
        lone = _each_set(docs.where("doc_id is null").select(F.lit(None).cast("long"), "text"), "class long, own long, set binary", rows).select(F.col("own").alias("class"), "set")
        made = made.unionByName(lone.join(nameless, "class", "left_semi").dropDuplicates(["class"]))
    sets = settle(made, purpose)
    held = dealt.select("cell", F.explode(F.array("a", "b")).alias("class")).distinct().join(sets, "class").select("cell", F.col("class").alias("a"), F.lit(None).cast("long").alias("b"), "set")
    both = held.unionByName(dealt.select("cell", "a", "b", F.lit(None).cast("binary").alias("set")))
    ordered = both.repartition("cell").sortWithinPartitions("cell", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, {}
        for batch in batches:
            found: list[tuple[int, int]] = []
            for c, a, b, blob in zip(batch.column("cell").to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("set"), strict=True):
                if c != now:
                    now, own = c, {}
                if b is None:
                    own[a] = np.frombuffer(blob.as_py(), np.uint64)
                    continue
                p, q = own[a], own[b]
                merged = np.sort(np.concatenate([p, q]), kind="stable")
                same = int(np.count_nonzero(merged[1:] == merged[:-1]))
                if 100 * same >= 80 * (len(p) + len(q) - same):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    links = settle(ordered.mapInArrow(trimmed(run), "a long, b long"), "links")
    discard(wanted, placed, dealt, chosen, sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """(class, component): the smallest class reachable over links (a, b), for classes with a link.

    Each round takes the smallest label among neighbours and then the label of that label; labels
    are written after each round, and rounds end when none changes.
    """
    edges = settle(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = settle(edges.groupBy(F.col("a").alias("class")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("class").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("class")).agg(F.min("c").alias("c"))
        taken = labels.join(near, "class", "left").select("class", F.col("component").alias("old"), F.least("component", F.coalesce("c", "component")).alias("new"))
        jumps = labels.select(F.col("class").alias("new"), F.col("component").alias("further"))
        step = settle(taken.join(jumps, "new", "left").select("class", "old", F.least("new", F.coalesce("further", "new")).alias("component")), "labels")
        done = step.where("old <> component").isEmpty()
        discard(labels, *([edges] if done else []))
        labels = step.drop("old")
        labels.folder = step.folder
        if done:
            return labels


def remaining_pairs(keys: DataFrame, labels: DataFrame, points: DataFrame, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """Pairs of classes of different components that meet at the keys they need and that the bound leaves.

    ``keys`` has (key, class, n). Keys of at most ``few`` classes give their pairs as they are, which
    is at most ``few / 2`` for a row; larger keys are searched with trees. Meetings are summed over both.
    """
    held = keys.join(labels, "class", "left").select("key", "class", "n", F.coalesce("component", "class").alias("component"))
    mixed = held.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.min("class").alias("first")).where("lo <> hi").select("key", "size", "first")
    rows = settle(held.join(mixed, "key"), "meetings")

    small = rows.where(F.col("size") <= few).select("key", "class", "component", "n")
    near = small.repartition("key").sortWithinPartitions("key", "class").mapInArrow(_by_cells(["key"], _neighbours, few), PAIRS)
    large = rows.where(F.col("size") > few).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    large = large.join(points.drop("n"), "class").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    # block i of a key meets every block j of it in the cell (i, j); keys of one group of texts mostly
    # have the same first class, and meetings of their cells are summed where they are found
    cells = large.select("key", "first", "class", "component", "n", "point", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("first", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "own", "class", "component", "n", "point")
    dealt = cells.repartition("first", "i", "j").sortWithinPartitions("first", "i", "j", "key")
    far = dealt.mapInArrow(_by_cells(["first", "i", "j", "key"], _searched, 25 * block), PAIRS)

    each = near.unionByName(far).groupBy("a", "b").agg(F.sum("met").alias("met"), F.first("needed").alias("needed"))
    out = settle(bounded_pairs(each.where("met >= needed").select("a", "b"), points), "left")
    discard(rows)
    return out


PAIRS = "a long, b long, met long, needed long"


def _by_cells(names: list[str], work, rows: int):
    """``work(table, cuts)`` on runs of whole cells (rows equal in ``names``) of about ``rows`` rows or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cuts = _cuts(table, names)
            if len(cuts) > 2:
                yield work(table.slice(0, cuts[-2]), cuts[:-1])
                held = table.slice(cuts[-2]).to_batches()
        if held and (table := pa.Table.from_batches(held).combine_chunks()).num_rows:
            yield work(table, _cuts(table, names))

    return trimmed(run)


def _cuts(table: pa.Table, names: list[str]) -> np.ndarray:
    """Where runs of rows equal in ``names`` begin, and the end."""
    differs = np.logical_or.reduce([(c := table[name].to_numpy())[1:] != c[:-1] for name in names])
    return np.concatenate([[0], np.flatnonzero(differs) + 1, [len(table)]])


def _counted(a: np.ndarray, b: np.ndarray, met: np.ndarray, needed: np.ndarray) -> pa.RecordBatch:
    """Meetings summed for each pair, the smaller class first."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high, met, needed = low[order], high[order], met[order], needed[order]
    first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])) if len(low) else np.zeros(0, np.int64)
    total = np.add.reduceat(met, first) if len(first) else met
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (low[first], high[first], total, needed[first])], names=["a", "b", "met", "needed"])


def _neighbours(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
    """All pairs of different components and fitting sizes within each (small) cell."""
    names, owner, n = (table[c].to_numpy() for c in ("class", "component", "n"))
    cell = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    left, right = [], []
    for step in range(1, int(np.diff(cuts).max(initial=1))):
        x, y = np.arange(len(names) - step), np.arange(step, len(names))
        good = (cell[x] == cell[y]) & (owner[x] != owner[y]) & (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y]))
        left.append(x[good])
        right.append(y[good])
    x, y = (np.concatenate(side) if side else np.zeros(0, np.int64) for side in (left, right))
    return _counted(names[x], names[y], np.ones(len(x), np.int64), needed_keys(np.minimum(n[x], n[y])))


def _searched(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
    """Pairs of cells by trees: cells (keys) of the same first class and blocks are one group, whose classes are searched once."""
    i, j, own, names, owner, n = (table[c].to_numpy() for c in ("i", "j", "own", "class", "component", "n"))
    points = points_of(table["point"].combine_chunks())
    groups = _cuts(table, ["first", "i", "j"])
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
    for start, end in zip(groups[:-1], groups[1:], strict=True):
        inside = cuts[(cuts >= start) & (cuts < end)]
        key = np.repeat(np.arange(len(inside)), np.diff(inside, append=end))
        label, first, at = np.unique(names[start:end], return_index=True, return_inverse=True)
        first = first + start
        # components are numbered within the group, as -1 stands for several
        _, local = np.unique(owner[first], return_inverse=True)
        one, two = own[first] == i[start], own[first] == j[start]
        if not one.any() or not two.any() or local.max(initial=0) == 0:
            continue
        others = np.flatnonzero(two)
        tree = CountTree(points[first[others]], n[first[others]], local[others])
        hits = [others[tree.search(points[first[x]], n[first[x]], local[x])] for x in np.flatnonzero(one)]
        x, y = np.repeat(np.flatnonzero(one), [len(h) for h in hits]), np.concatenate(hits)
        if i[start] == j[start]:
            x, y = x[y > x], y[y > x]
        met = np.zeros(len(x), np.int64)
        for part in range(0, len(inside), 512):
            chosen = (key >= part) & (key < part + 512)
            held = np.zeros((len(label), min(512, len(inside) - part)), np.float32)
            held[at[chosen], key[chosen] - part] = 1
            for some in range(0, len(x), 1 << 11):
                met[some : some + (1 << 11)] += np.einsum("pk,pk->p", held[x[some : some + (1 << 11)]], held[y[some : some + (1 << 11)]]).astype(np.int64)
        x, y, met = x[met > 0], y[met > 0], met[met > 0]
        found.append((label[x], label[y], met, needed_keys(np.minimum(n[first[x]], n[first[y]]))))
    return _counted(*(np.concatenate(column) for column in zip(*found, strict=True)))


def similar_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", classes_too: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row, components as the smallest doc_id in them.

    With ``classes_too`` also ``class``, the name of the text's set (see :func:`with_class`), and
    ``group``, one class that names the component; both are null for empty sets.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    each = settle(describe(docs), "sets")
    classes = each.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("point").alias("point"))
    classes = settle(classes, "classes")
    points, members = classes.select("class", "n", "point"), classes.select("class", "doc_id")

    by_key = Window.partitionBy("key")
    met = meeting_keys(docs, frequent_shingles(docs, each.count()))
    met = met.select("key", "class", "n", F.min("class").over(by_key).alias("lo"), F.max("class").over(by_key).alias("hi")).where("lo <> hi")
    keys = settle(met.select("key", "class", "n").distinct(), "keys")

    # a text that others are copies of shares more of its keys than they do
    central = keys.groupBy("class").agg((F.count("*") / F.greatest(F.first("n"), F.lit(1))).alias("shared"))
    leader = F.max(F.struct("shared", "class", "n")).over(by_key)
    led = settle(keys.join(central, "class").select("class", "n", leader.alias("lead")).groupBy("class", "n", "lead").agg(F.count("*").alias("met")), "led")
    homes = settle(led.groupBy("class").agg(F.max("lead").alias("lead")).select("class", F.col("lead.class").alias("home")), "homes")
    # a pair that meets its leader less often than it must is left to the trees, where all its keys count
    needed = F.floor(F.least("n", "lead.n") / 40) + 1
    others = led.where("class <> lead.class").where(sizes_fit(F.col("n"), F.col("lead.n")) & (F.col("met") >= needed))
    pairs = others.select(F.least("class", "lead.class").alias("a"), F.greatest("class", "lead.class").alias("b")).distinct()
    tried = settle(bounded_pairs(pairs, points), "tried")
    links = verified(tried, docs, members, homes, "leader-sets")
    labels = components(links)
    met = remaining_pairs(keys, labels, points)
    left = settle(met.join(tried, ["a", "b"], "left_anti"), "left")
    discard(met)
    more = verified(left, docs, members, homes, "tree-sets")
    # a doc_id with texts of several classes links them
    named = each.where("n > 0 and doc_id is not null")
    several = named.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("doc_id", "a")
    same = settle(named.join(several, "doc_id").where("a <> class").select("a", F.col("class").alias("b")).distinct(), "same")
    if not (more.isEmpty() and same.isEmpty()):
        labels = components(links.unionByName(more).unionByName(same))
    discard(keys, led, homes, tried, left, links, more, same, classes)

    named = each.join(labels, "class", "left").select("doc_id", "n", "class", F.when(F.col("n") > 0, F.coalesce("component", "class")).alias("group"))
    smallest = named.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    extra = [F.when(F.col("n") > 0, F.col("class")).alias("class"), "group"] if classes_too else []
    return named.join(smallest, "group", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *extra)


def with_class(documents: DataFrame, text: str, name: str) -> DataFrame:
    """Add the name of each text's set, null for an empty one."""

    def work(texts: list[bytes | None]) -> list[list]:
        sets = shingle_sets(texts)
        return [[digest(s) if len(s) else None for s in sets]]

    return with_columns(documents, text, [(name, T.LongType())], work, as_bytes=True)
