"""Token counts by batch encoding in Arrow functions that return lengths only.

A text is split at *safe boundaries*: a single space with no white space on either side. The byte
level pre-tokenizer joins that space to what follows and looks no further, so the pieces on both
sides are encoded as they are within the text, special strings included (they hold no space). Only
pieces that the worker hasn't met yet go to the library, in batches balanced by bytes; the rest are
looked up in a bounded cache of lengths.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each;
an empty table gives an empty result; an input column named like a new one gives way to it.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomgraph.llm.common import by_bytes, forget, with_columns

#: Bytes of one call of the library, pieces kept in a worker's cache, tokens that make a text long.
BATCH_BYTES = 1 << 18
CACHE_PIECES = 600_000
LIMIT = 1024

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r"\s\s|^\s|\s$")
_counters: dict[str, PieceCounter] = {}


class PieceCounter:
    """Lengths of pieces under one tokenizer file; ``later`` has those that follow a space."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES, batch_bytes: int = BATCH_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache_pieces, self.batch_bytes = cache_pieces, batch_bytes
        self.later: dict[str, int] = {}

    def encode_lengths(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for start, end in by_bytes((len(p.encode()) for p in pieces), self.batch_bytes):
            out += map(len, self.tokenizer.encode_batch_fast(pieces[start:end], add_special_tokens=False))
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        split = [split_safely(t) if t else [] for t in texts]
        if len(self.later) > self.cache_pieces:
            forget(self.later)
        new = list({p for parts in split for p in parts[1:]}.difference(self.later))
        self.later.update(zip(new, self.encode_lengths([" " + p for p in new]), strict=True))
        heads = iter(self.encode_lengths([parts[0] for parts in split if parts]))
        known = self.later.__getitem__
        return [next(heads) + sum(map(known, parts[1:])) if parts else 0 for parts in split]


def split_safely(text: str) -> list[str]:
    """Pieces between safe boundaries, without the boundaries' spaces."""
    return text.split(" ") if not _UNSAFE.search(text) else _SAFE.split(text)


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = LIMIT, group_bytes: int = 1 << 22) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit; ``tokenizer`` is the path of a tokenizers .json file on every machine."""

    def work(texts: list[str | None]) -> list[list]:
        if tokenizer not in _counters:
            _counters[tokenizer] = PieceCounter(tokenizer)
        counter = _counters[tokenizer]
        sizes = [len(t.encode()) if t else 0 for t in texts]
        tokens: list[int] = []
        for start, end in by_bytes(sizes, group_bytes):
            tokens += counter.counts(texts[start:end])
        return [sizes, tokens, [n > limit for n in tokens]]

    return with_columns(docs, text, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())], work)
