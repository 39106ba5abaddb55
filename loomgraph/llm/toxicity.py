"""Toxicity scores by logistic regression over hashed word n-grams and skip-grams, trained with FTRL-proximal.

A text's features are the distinct hashes of its words, pairs and triples of neighbouring words, and
pairs of words with one or two words between them. Each coordinate has its own learning rate, from
the sum of its squared gradients; the L1 term keeps all but the telling coordinates at zero, so the
weights are a short sorted list that is broadcast (at most ``MOST`` entries, those of the largest
weights). Scoring hashes whole texts in Arrow batches, drops nearly all features by a table of bits,
and adds up the weights of the others.

Training reads labelled rows only: a bounded hash sample of about ``PER_CLASS`` texts of either label,
chosen by key before any text is read, so only these texts leave their place. Their features are
made on the executors; the distinct hashes of these texts, four bytes each, reach the driver.
Coordinates found in fewer than ``MIN_DOCS`` texts of the sample are never included. The sample is
balanced, so a score is a probability for balanced classes.

Defined results: a null text is an empty one; a text without words scores as the intercept alone;
without any learned row the score is 0.5; a text of any length is scored whole; repeated rows are
scored each, and learned from each; a null label isn't learned from; an empty table gives an empty
result; an input column named like a new one gives way to it; equal scores are equally predicted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import by_bytes, trimmed, with_columns

PER_CLASS, MIN_DOCS, MOST = 2500, 3, 1 << 20
ALPHA, BETA, L1, L2, EPOCHS = 5.0, 1.0, 6.0, 0.01, 10
THRESHOLD = 0.7
#: Features as distances between the words that make them.
SHAPES = ((), (1,), (1, 2), (2,), (3,))
BITS = 20
_WORD = re.compile(r"[^\W_]+")


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) of all features of the texts and the text of each; a feature found again is there again."""
    words = [_WORD.findall(t.lower()) if t else [] for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    coded = pa.array([w for found in words for w in found], pa.string()).dictionary_encode()
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes, owner = own[coded.indices.to_numpy()], np.repeat(np.arange(len(texts)), sizes)
    keys, owners = [], []
    for number, shape in enumerate(SHAPES, 1):
        span = len(hashes) - max(shape, default=0)
        if span <= 0:
            continue
        key = hashes[:span] * np.uint64(2 * number + 1)
        for step in shape:
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[step : step + span]
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        inside = owner[:span] == owner[max(shape, default=0) :]
        keys.append((key >> np.uint64(32)).astype(np.uint32)[inside])
        owners.append(owner[:span][inside])
    return np.concatenate(keys or [np.zeros(0, np.uint32)]), np.concatenate(owners or [np.zeros(0, np.int64)])


@dataclass
class Weights:
    """Weights other than zero, by sorted hashes, and the intercept."""

    keys: np.ndarray
    values: np.ndarray
    intercept: float

    def __post_init__(self) -> None:
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[self.keys & np.uint32((1 << BITS) - 1)] = True

    def scores(self, texts: list[str | None]) -> np.ndarray:
        keys, owner = features(texts)
        likely = np.flatnonzero(self.bits[keys & np.uint32((1 << BITS) - 1)])
        keys, owner = keys[likely], owner[likely]
        at = np.searchsorted(self.keys, keys)
        known = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys) if len(self.keys) else at
        pairs = np.unique((owner[known].astype(np.int64) << 32) | at[known])  # a feature counts once for a text
        total = np.bincount(pairs >> 32, self.values[pairs & 0xFFFFFFFF], minlength=len(texts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of ``size`` coordinates after FTRL-proximal over rows (arrays of coordinates of value 1).

    Coordinate 0 is the intercept, of every row, and isn't held back by the L1 term.
    """
    z, n = np.zeros(size), np.zeros(size)
    hold = np.full(size, l1)
    hold[0] = 0.0

    def weights(at) -> np.ndarray:
        over = np.abs(z[at]) - hold[at]
        return np.where(over > 0, -np.sign(z[at]) * over / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for at, label in zip(rows, labels, strict=True):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -500, 500))) - label
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(np.arange(size))


def labelled_sample(labels: DataFrame, key: str, label: str, per_class: int = PER_CLASS) -> DataFrame:
    """(key, label): a hash sample of about ``per_class`` keys of either label, so that only the texts of these are looked up.

    Its size is bounded by ``per_class``, whatever the table's, so it may be broadcast.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, label).distinct()
    sizes = {r[label]: r.n for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}  # two rows
    if not sizes:
        return rows.limit(0)
    bound = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1 << 20, (per_class << 20) // n + 1))])
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < F.element_at(bound, F.col(label)))


def train(labelled: DataFrame, text: str, label: str, by: tuple[str, ...] = (), per_class: int = PER_CLASS, min_docs: int = MIN_DOCS, most: int = MOST, group_bytes: int = 1 << 20) -> Weights:
    """Fit on rows whose label is 0 or 1. Text and the columns ``by`` decide the hash sample, so that copies of a text aren't all in it or all out."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("label"), F.coalesce(F.col(text), F.lit("")).alias("text"), *by)
    rows = rows.withColumn("h", F.pmod(F.xxhash64("text", *by), F.lit(1 << 20)))
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(sizes) < 2:
        return Weights(np.zeros(0, np.uint32), np.zeros(0), 0.0)
    bound = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1 << 20, (per_class << 20) // n + 1))])
    sample = rows.where(F.col("h") < F.element_at(bound, F.col("label"))).select("label", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, texts = (c.to_pylist() for c in batch.columns)
            for start, end in by_bytes(map(len, texts), group_bytes):
                keys, owner = features(texts[start:end])
                found = np.unique((owner.astype(np.uint64) << np.uint64(32)) | keys)
                ends = np.searchsorted(found >> np.uint64(32), np.arange(end - start + 1, dtype=np.uint64)).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array((found & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(labels[start:end], pa.int32()), lists], names=["label", "keys"])

    made = sample.mapInArrow(trimmed(make), "label int, keys array<int>").toArrow()
    lists = made["keys"].combine_chunks()
    keys = lists.flatten().to_numpy().view(np.uint32)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    known, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    included = np.flatnonzero(times >= min_docs)
    number = np.zeros(len(known), np.int64)
    number[included] = np.arange(1, len(included) + 1)
    place = number[place]
    examples = [np.concatenate([[0], part[part > 0]]) for part in (place[a:b] for a, b in zip(ends, ends[1:], strict=False))]
    labels = made["label"].to_numpy()
    # an order of its own, that the order of rows on the executors doesn't change
    order = sorted(range(len(examples)), key=lambda i: (xxhash.xxh64_intdigest(known[included[examples[i][1:] - 1]].tobytes()), labels[i]))
    w = ftrl([examples[i] for i in order], labels[order], len(included) + 1)
    held = np.flatnonzero(w[1:])
    held = np.sort(held[np.argsort(-np.abs(w[1:][held]), kind="stable")[:most]])
    return Weights(known[included[held]], w[1:][held], float(w[0]))


def score_toxicity(docs: DataFrame, model: Weights, text: str = "text", threshold: float = THRESHOLD, group_bytes: int = 1 << 20) -> DataFrame:
    """Add score and predicted (1 if the score reaches ``threshold``)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str | None]) -> list[list]:
        scores: list[float] = []
        for start, end in by_bytes((len(t or "") for t in texts), group_bytes):
            scores += sent.value.scores(texts[start:end]).tolist()
        return [scores, [int(s >= threshold) for s in scores]]

    return with_columns(docs, text, [("score", T.DoubleType()), ("predicted", T.IntegerType())], work)
