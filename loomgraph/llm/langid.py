"""Language identification by language-bitmask n-gram filters.

The filter is a Bloom filter whose cells hold one bit for each language (bit-sliced): inserting an
n-gram sets its language's bit in every probed cell, and the AND of the probed cells gives at once
all languages that contain an n-gram. A text's n-grams are looked up together; the number of hits of
each language, corrected for the false positives expected from the fill of its slice, decides.

n-grams are runs of 3 and 4 characters of lower-cased letters, with one space for everything else.
A language's n-grams are those most frequent in its training texts. Training reads labelled rows
only, a bounded hash sample of about ``per_language`` texts of each language; counts are summed on
the executors and at most ``grams`` n-grams of each language reach the driver.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing could be
learned; texts without any hit get the first language in sorted order with score 0; ties go to the
first in sorted order; repeated rows are judged each; labels that are null are not learned from; an
input column named like a new one gives way to it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import by_bytes, with_columns

PER_LANGUAGE = 2000
GRAMS = 3000
CELLS = 1 << 18
PROBES = 3
SIZES = (3, 4)
UNKNOWN = "und"
_folds: list[np.ndarray] = []


def fold() -> np.ndarray:
    """Code point to itself if a letter, else to a space."""
    if not _folds:
        codes = np.arange(0x110000, dtype=np.uint32)
        letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _folds.append(np.where(letters, codes, 32).astype(np.uint32))
    return _folds[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all n-grams of the texts, the text of each, and the number of letters of each text."""
    joined = " " + "  ".join(t.lower() for t in texts) + " "
    sizes = np.array([len(t.lower()) + 2 for t in texts], dtype=np.int64)
    codes = fold()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)].astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    letters = np.bincount(owner[codes != 32], minlength=len(texts))
    run = np.ones(len(codes), bool)  # a run of spaces counts as one
    run[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (owner[1:] != owner[:-1])
    codes, owner = codes[run], owner[run]
    keys, owners = [], []
    for n in SIZES:
        if len(codes) < n:
            continue
        key = np.zeros(len(codes) - n + 1, np.uint64)
        for i in range(n):
            key = (key ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        inside = (owner[: len(key)] == owner[n - 1 :]) & (codes[n // 2 : len(codes) - n + 1 + n // 2] != 32)
        keys.append(key[inside])
        owners.append(owner[: len(key)][inside])
    return np.concatenate(keys or [np.zeros(0, np.uint64)]), np.concatenate(owners or [np.zeros(0, np.int64)]), letters


@dataclass
class GramFilter:
    """cells[c, w]: bits of languages 64 w to 64 w + 63 in cell c."""

    languages: list[str]
    cells: np.ndarray
    false_rate: np.ndarray
    probes: int

    @staticmethod
    def build(by_language: dict[str, np.ndarray], cells: int = CELLS, probes: int = PROBES) -> GramFilter:
        names = sorted(by_language)
        table = np.zeros((cells, max(1, -(-len(names) // 64))), np.uint64)
        fill = np.zeros(len(names))
        for i, name in enumerate(names):
            slice_ = np.zeros(cells, bool)
            for p in range(probes):
                slice_[GramFilter.cell(by_language[name], p, cells)] = True
            table[slice_, i // 64] |= np.uint64(1) << np.uint64(i % 64)
            fill[i] = slice_.mean()
        return GramFilter(names, table, fill**probes, probes)

    @staticmethod
    def cell(keys: np.ndarray, probe: int, cells: int) -> np.ndarray:
        return ((keys * np.uint64(2 * probe + 1) ^ (keys >> np.uint64(17 + 5 * probe))) % np.uint64(cells)).astype(np.int64)

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """All languages of each n-gram."""
        out = self.cells[self.cell(keys, 0, len(self.cells))]
        for p in range(1, self.probes):
            out = out & self.cells[self.cell(keys, p, len(self.cells))]
        return out

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return langs, scores
        keys, owner, letters = grams([t or "" for t in texts])
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        masks = self.masks(keys)
        hits = np.stack([np.bincount(owner[(masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) == 1], minlength=len(texts)) for i in range(len(self.languages))], axis=1)
        true = np.clip((hits - total[:, None] * self.false_rate) / (1 - self.false_rate), 0, None)
        best = true.argmax(1)
        share = true.max(1) / np.maximum(true.sum(1), 1e-9)
        for i in np.flatnonzero(letters):
            langs[i], scores[i] = self.languages[best[i]], float(share[i])
        return langs, scores


def train(labelled: DataFrame, key: str, text: str, label: str, per_language: int = PER_LANGUAGE, most: int = GRAMS) -> GramFilter:
    """Fit a filter on rows with a label; ``key`` and text only decide the hash sample."""
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(key, text), F.lit(1 << 20)).alias("h"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return GramFilter.build({})
    bound = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1 << 20, (per_language << 20) // n + 1))])
    sample = rows.where(F.col("h") < F.try_element_at(bound, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = (np.array(c.to_pylist(), dtype=object) for c in batch.columns)
            for lang in sorted(set(langs)):
                keys, _, _ = grams(list(texts[langs == lang]))
                found, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    from pyspark.sql import Window

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= most)
    found = top.select("lang", "gram").toArrow()
    langs, keys = np.array(found["lang"].to_pylist(), dtype=object), found["gram"].to_numpy()
    return GramFilter.build({lang: keys[langs == lang].view(np.uint64) for lang in sizes})


def identify_language(docs: DataFrame, model: GramFilter, text: str = "text", group_bytes: int = 1 << 20) -> DataFrame:
    """Add lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str | None]) -> list[list]:
        langs: list[str] = []
        scores: list[float] = []
        for start, end in by_bytes((len(t or "") + 2 for t in texts), group_bytes):
            a, b = sent.value.decide(texts[start:end])
            langs += a
            scores += b
        return [langs, scores]

    return with_columns(docs, text, [("lang_pred", T.StringType()), ("score", T.DoubleType())], work)
