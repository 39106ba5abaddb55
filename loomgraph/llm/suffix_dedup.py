"""Exact removal of long byte strings seen in earlier documents, by logarithmic families of suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id.
Suffixes are compared by their first LENGTH bytes, so a suffix is a *window*. Documents are dealt
into groups by ranges of ids; groups are the batches of the index, in the order of their ranges.

The index is dealt over buckets that hold complete classes of equal windows. In a bucket, batches
arrive in order; each gets a sorted suffix array, is merge-scanned against the existing levels for
windows seen in earlier groups, and becomes a level; levels of equal size merge, so a bucket keeps a
logarithmic number of sorted levels. (Suffixes are sorted by a hash of the compared bytes: any order
that keeps equal windows together serves the scan.) Matches inside a group are found from the
group's own suffix array.

Most windows of a corpus occur once, and needn't travel. The smallest hash among a window's short
strings is its key; equal windows have equal keys, and neighbouring windows mostly share one, so a
group sends one key for a *segment* of some ten windows. A first family, of keys, tells which keys
occur in several groups. Only segments with such keys are sent, as compressed text, to the bucket of
their key. Keys with many different segments (texts around one frequent passage) are dealt by
windows instead, so that no bucket holds a hot key.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; rows with equal ids
are not earlier than each other; null ids come after all others and are no earlier documents of each
other; very long texts are taken whole; an empty table gives an empty result; other input columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import text_bytes

LENGTH, SHORT = 50, 26
REACH = LENGTH - SHORT + 1
#: Windows of a segment at most; bytes hashed at once; bytes of a group; different segments that make a key hot.
SEGMENT, CHUNK, GROUP_BYTES, HOT = 40, 1 << 20, 8 << 20, 200
NO_ID = np.iinfo(np.int64).max

U = np.uint64
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)
_P = U(0x100000001B3)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * _M2
    h = (h ^ (h >> U(29))) * _M1
    return h ^ (h >> U(32))


def short_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all strings of SHORT bytes of at most CHUNK + LENGTH bytes."""
    if not _powers:
        size = CHUNK + 2 * LENGTH
        for base in (_P, U(pow(int(_P), -1, 1 << 64))):
            steps = np.full(size, base)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    n = len(data)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _powers[0][:n], out=sums[1:])
    return mix((sums[SHORT:] - sums[: n - SHORT + 1]) * _powers[1][: n - SHORT + 1])


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and key of each segment of documents laid end to end."""
    starts, sizes, keys = [], [], []
    for at in range(0, len(data) - LENGTH + 1, CHUNK):
        part = data[at : at + CHUNK + LENGTH - 1]
        low, span = short_hashes(part), 1
        while span * 2 <= REACH:
            low, span = np.minimum(low[:-span], low[span:]), span * 2
        n = len(part) - LENGTH + 1
        low = np.minimum(low[:n], low[REACH - span : REACH - span + n])
        cut = np.zeros(n, bool)
        cut[0] = True
        cut[1:] = low[1:] != low[:-1]
        whole = np.ones(n, bool)  # windows that end within their document
        for end in ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + n + LENGTH)]:
            whole[max(0, end - LENGTH + 1 - at) : max(0, end - at)] = False
            if 0 <= end - at < n:
                cut[end - at] = True
            if 0 <= end - LENGTH + 1 - at < n:
                cut[end - LENGTH + 1 - at] = True
        first = np.flatnonzero(cut)
        into = np.arange(n) - np.repeat(first, np.diff(first, append=n))
        first = np.flatnonzero(into % SEGMENT == 0)
        size = np.diff(first, append=n)
        good = whole[first]
        starts.append(first[good] + at)
        sizes.append(size[good])
        keys.append(low[first[good]] >> U(16))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(keys)


def digests(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of the windows that begin at the places."""
    one, two = np.empty(len(places), U), np.empty(len(places), np.uint32)
    if not len(places):
        return one, two
    views = sliding_window_view(data, LENGTH)
    for at in range(0, len(places), 1 << 16):
        some = places[at : at + (1 << 16)]
        words = np.zeros((len(some), -(-LENGTH // 8) * 8), np.uint8)
        words[:, :LENGTH] = views[some]
        words = words.view(U)
        a, b = np.full(len(some), _M1), np.full(len(some), _M3)
        for j in range(words.shape[1]):
            a = mix(a * _M3 + words[:, j])
            b = (b ^ words[:, j]) * _M2
            b ^= b >> U(31)
        one[at : at + len(some)], two[at : at + len(some)] = a, (mix(b) >> U(32)).astype(np.uint32)
    return one, two


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All windows of segments, in order."""
    total = int(sizes.sum())
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total) if total else np.zeros(0, np.int64)


class Levels:
    """Logarithmic family of sorted arrays (hash, check) with the batch each entry came from and a mark."""

    def __init__(self) -> None:
        self.levels: list[list] = []  # [number of batches, hash, check, batch, mark], largest first

    def add(self, one: np.ndarray, two: np.ndarray, batch: int, mark: bool = False) -> np.ndarray:
        """Take a sorted batch in; returns which entries earlier batches hold. With ``mark`` both sides of a match are marked."""
        seen = np.zeros(len(one), bool)
        for level in self.levels:
            _, hashes, checks, _, marks = level
            at = np.minimum(np.searchsorted(hashes, one), len(hashes) - 1)
            found = (hashes[at] == one) & (checks[at] == two)
            seen |= found
            if mark:
                marks[at[found]] = True
        if len(one):
            self.levels.append([1, one, two, np.full(len(one), batch, np.int32), seen.copy()])
        while len(self.levels) > 1 and self.levels[-1][0] >= self.levels[-2][0]:
            self.merge(keep=mark)
        return seen

    def merge(self, keep: bool) -> None:
        """Merge the last two levels; entries found in both stay twice only if ``keep``."""
        a, b = self.levels.pop(-2), self.levels.pop()
        columns = [np.concatenate(pair) for pair in zip(a[1:], b[1:], strict=True)]
        order = np.argsort(columns[0], kind="stable")
        columns = [c[order] for c in columns]
        if not keep:
            first = np.ones(len(order), bool)
            first[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
            columns = [c[first] for c in columns]
        self.levels.append([a[0] + b[0], *columns])

    def marked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, batch and mark of every entry; equal hashes share a mark."""
        while len(self.levels) > 1:
            self.merge(keep=True)
        if not self.levels:
            return np.zeros(0, U), np.zeros(0, np.int32), np.zeros(0, bool)
        _, hashes, _, batch, mark = self.levels[0]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        return hashes, batch, np.repeat(np.logical_or.reduceat(mark, first), np.diff(first, append=len(hashes)))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays with their lengths, compressed."""
    raw = [a.tobytes() for a in arrays]
    return zstandard.compress(b"".join([np.array([len(r) for r in raw], np.int64).tobytes(), *raw]), 1)


def unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    at, out = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(raw, np.int64, len(kinds)), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def six_bytes(keys: np.ndarray) -> np.ndarray:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].copy()


def from_six(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = data.reshape(-1, 6)
    return out.view("<u8").ravel()


class Group:
    """Documents of one range of ids, their segments, and what the index said about them."""

    def __init__(self, blobs: list[bytes], buckets: int):
        parts = [unpacked(b, np.int64, np.int64, np.uint8) for b in sorted(blobs)]
        self.ids = np.concatenate([p[0] for p in parts])
        self.sizes = np.concatenate([p[1] for p in parts])
        self.data = np.concatenate([p[2] for p in parts])
        self.ends = np.cumsum(self.sizes)
        self.buckets = buckets
        self.start, self.size, self.key = segments(self.data, self.ends)
        self.doc = np.searchsorted(self.ends, self.start, "right")

    def key_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys sorted by bucket and key, and in how many segments each is (at most 255)."""
        keys, counts = np.unique(self.key, return_counts=True)
        order = np.argsort(keys % U(self.buckets), kind="stable")
        return keys[order], np.minimum(counts[order], 255).astype(np.uint8)

    def take_keys(self, answers: dict[int, bytes]) -> None:
        """Learn which keys other groups hold, and which of them are hot; keep the segments that can match at all."""
        keys, _ = self.key_counts()
        said = np.concatenate([unpacked(answers[b], np.uint8)[0] for b in sorted(answers)] or [np.zeros(0, np.uint8)])
        order = np.argsort(keys)
        said = said[order][np.searchsorted(keys[order], self.key)] if len(keys) else np.zeros(0, np.uint8)
        _, inverse = np.unique(self.key, return_inverse=True)
        low, high = np.full(inverse.max(initial=-1) + 1, 1 << 60), np.full(inverse.max(initial=-1) + 1, -1)
        np.minimum.at(low, inverse, self.doc)
        np.maximum.at(high, inverse, self.doc)
        use = (said > 0) | (low != high)[inverse]
        self.start, self.size, self.key, self.doc = self.start[use], self.size[use], self.key[use], self.doc[use]
        self.shared, self.hot = said[use] > 0, said[use] > 1
        self.place = spread(self.start, self.size)
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        self.one, self.two = digests(self.data, self.place)

    def requests(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(bucket, kind, numbers): kind 0 are segments whose text is sent, one of each content; kind 1 are windows, one of each."""
        at = np.flatnonzero(self.shared & ~self.hot)
        name = mix(self.one[self.first[at]] + mix(self.one[self.first[at] + self.size[at] - 1]) + self.size[at].astype(U))
        _, first = np.unique(name, return_index=True)
        at = at[first]
        yield from self._dealt(at, self.key[at] % U(self.buckets), 0)
        windows = np.flatnonzero(np.repeat(self.shared & self.hot, self.size))
        _, first = np.unique(self.one[windows], return_index=True)
        yield from self._dealt(windows[first], self.one[windows[first]] % U(self.buckets), 1)

    @staticmethod
    def _dealt(numbers: np.ndarray, bucket: np.ndarray, kind: int) -> Iterator[tuple[int, int, np.ndarray]]:
        order = np.argsort(bucket, kind="stable")
        numbers, bucket = numbers[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
        for start, part in zip(cuts, np.split(numbers, cuts[1:]), strict=False):
            yield int(bucket[start]), kind, part

    def text_of(self, at: np.ndarray) -> bytes:
        """Sizes and texts of segments."""
        sizes = self.size[at]
        return packed(sizes.astype(np.uint8), self.data[spread(self.start[at], sizes + LENGTH - 1)])

    def removed(self, answers: dict[tuple[int, int], bytes]) -> np.ndarray:
        """Bytes that go."""
        earlier: list[np.ndarray] = []
        for bucket, kind, numbers in self.requests():
            windows = spread(self.first[numbers], self.size[numbers]) if kind == 0 else numbers
            bits = np.unpackbits(unpacked(answers[bucket, kind], np.uint8)[0], count=len(windows)).astype(bool)
            earlier.append(windows[bits])
        seen = np.concatenate(earlier or [np.zeros(0, np.int64)])
        # equal windows share a number; a window goes if another group holds it or a smaller id of this one
        _, number = np.unique(self.one, return_inverse=True)
        gone = np.zeros(number.max(initial=-1) + 1, bool)
        gone[number[seen]] = True
        owner = self.ids[np.repeat(self.doc, self.size)] if len(self.doc) else np.zeros(0, np.int64)
        least = np.full(len(gone), NO_ID)
        np.minimum.at(least, number, owner)
        places = self.place[gone[number] | (owner > least[number])]
        change = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(change, places, 1)
        np.add.at(change, places + LENGTH, -1)
        return np.cumsum(change[:-1]) > 0


def _pack_groups(docs: DataFrame, cuts: list[int]) -> DataFrame:
    """(g, docs): documents of one range of ids, some at a time, as one compressed blob."""
    sent = docs.sparkSession.sparkContext.broadcast(np.array(cuts, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [t or b"" for t in text_bytes(batch.column(1))]
            group = np.searchsorted(sent.value, ids, "right")
            order = np.argsort(group, kind="stable")
            found, starts = np.unique(group[order], return_index=True)
            blobs = []
            for rows in np.split(order, starts[1:]):
                blobs.append(packed(ids[rows], np.array([len(texts[i]) for i in rows], np.int64), np.frombuffer(b"".join([texts[i] for i in rows]), np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(blobs, pa.binary())], names=["g", "docs"])

    return docs.mapInArrow(run, "g int, docs binary")


def _in_buckets(rows: DataFrame, parts: int, answer, schema: str) -> DataFrame:
    """``answer(bucket, rows)`` for the rows of each bucket, ordered by group; a bucket's rows are a bounded share of the index."""
    dealt = rows.repartition(parts, "b").sortWithinPartitions("b", "g", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["b"] != row["b"]:
                    yield answer(held)
                    held = []
                held.append(row)
        if held:
            yield answer(held)

    return dealt.mapInArrow(run, schema)


def _shared_keys(rows: list[dict], hot: int = HOT) -> pa.RecordBatch:
    """For each group, a byte for each of its keys: 0 of this group alone, 1 shared, 2 shared and hot."""
    levels, counts = Levels(), []
    for row in rows:
        six, n = unpacked(row["data"], np.uint8, np.uint8)
        keys = from_six(six)
        levels.add(keys, np.zeros(len(keys), np.uint32), row["g"], mark=True)
        counts.append((keys, n))
    hashes, batch, mark = levels.marked()
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    total = np.zeros(len(first), np.int64)
    for keys, n in counts:
        total[np.searchsorted(hashes[first], keys)] += n  # a batch holds a key once
    said = mark.astype(np.uint8) + (mark & np.repeat(total > hot, np.diff(first, append=len(hashes))))
    order = np.argsort(batch, kind="stable")
    parts = np.split(said[order].astype(np.uint8), np.flatnonzero(np.diff(batch[order])) + 1)
    owners = np.unique(batch)
    return pa.RecordBatch.from_arrays([pa.array(owners), pa.array([rows[0]["b"]] * len(owners), pa.int32()), pa.array([0] * len(owners), pa.int32()), pa.array([packed(p) for p in parts], pa.binary())], names=["g", "b", "kind", "data"])


def _seen_windows(rows: list[dict]) -> pa.RecordBatch:
    """For each group, a bit for each window it sent: an earlier group holds it."""
    levels, out = Levels(), []
    groups: dict[int, list[dict]] = {}
    for row in rows:
        groups.setdefault(row["g"], []).append(row)
    for g, sent in groups.items():
        got = []
        for row in sent:
            if row["kind"] == 0:
                sizes, text = unpacked(row["data"], np.uint8, np.uint8)
                sizes = sizes.astype(np.int64)
                begin = np.concatenate([[0], np.cumsum(sizes + LENGTH - 1)[:-1]])
                got.append(digests(text, spread(begin, sizes)))
            else:
                got.append(tuple(unpacked(row["data"], U, np.uint32)))
        one, two = (np.concatenate(x) for x in zip(*got, strict=True))
        unique, first, number = np.unique(one, return_index=True, return_inverse=True)
        seen = levels.add(unique, two[first], g)[number]
        at = 0
        for row, (part, _) in zip(sent, got, strict=True):
            out.append((g, row["b"], row["kind"], packed(np.packbits(seen[at : at + len(part)]))))
            at += len(part)
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["g", "b", "kind", "data"])


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", kept: bool = False, group_bytes: int = GROUP_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row; with ``kept`` also the remaining bytes."""
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(parts, -(-total // group_bytes))
    buckets = max(parts, -(-total // (2 * group_bytes)))
    cuts = docs.where("doc_id is not null").approxQuantile("doc_id", [i / groups for i in range(1, groups)], 0.25 / groups) if total else []
    packs = _pack_groups(docs, sorted({int(c) for c in cuts})).repartition(parts, "g")
    send = "g int, b int, kind int, data binary"
    names = ["g", "b", "kind", "data"]

    def batch(rows: list[tuple]) -> pa.Table:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], names=names)

    def send_keys(table: pa.Table) -> pa.Table:
        g = table["g"][0].as_py()
        group = Group(table["docs"].to_pylist(), buckets)
        keys, counts = group.key_counts()
        deal = keys % U(buckets)
        cuts = np.flatnonzero(np.concatenate([[True], deal[1:] != deal[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return batch([(g, int(deal[a]), 0, packed(six_bytes(keys[a:b]), counts[a:b])) for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)])

    def known(left: pa.Table, right: pa.Table) -> Group:
        group = Group(left["docs"].to_pylist(), buckets)
        rows = [r for r in right.to_pylist() if r["kind"] == 0 and r["stage"] == 1]
        group.take_keys({r["b"]: r["data"] for r in rows})
        return group

    def send_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return batch([])
        g, group = left["g"][0].as_py(), known(left, right)
        return batch([(g, b, kind, group.text_of(n) if kind == 0 else packed(group.one[n], group.two[n])) for b, kind, n in group.requests()])

    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        group = known(left, right)
        gone = group.removed({(r["b"], r["kind"]): r["data"] for r in right.to_pylist() if r["stage"] == 2})
        rows = []
        for doc_id, size, end in zip(group.ids, group.sizes, group.ends, strict=True):
            part, out = group.data[end - size : end], gone[end - size : end]
            left_over = part[~out].tobytes()
            spans = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
            row = (None if doc_id == NO_ID else int(doc_id), int(size), int(out.sum()), spans, hashlib.sha256(left_over).hexdigest())
            rows.append((*row, left_over) if kept else row)
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * kept
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in result.split(", ")])

    staged = lambda df, n: df.withColumn("stage", F.lit(n))
    own = packs.groupBy("g")
    keys = _in_buckets(own.applyInArrow(send_keys, send), parts, partial(_shared_keys, hot=hot), send)
    first = staged(keys, 1)
    windows = _in_buckets(own.cogroup(first.groupBy("g")).applyInArrow(send_windows, send), parts, _seen_windows, send)
    both = first.unionByName(staged(windows, 2))
    return own.cogroup(both.groupBy("g")).applyInArrow(finish, result)


