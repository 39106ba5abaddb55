"""Batches of rows of like length from a buffer, over tables and over streams that may stop at any time.

Rows of a key come in the order of their sequence numbers. Each goes into the key's buffer; once the
buffer holds more than ``buffer`` batches' worth, a batch leaves it: a pivot length is drawn, rows
are taken from the nearest length on, until the longest row times their number would pass the
budget. At the end the buffer is drained in the same way. The draw is a hash of key and batch
number, so the batches depend on the rows' order alone: a stream gives the same ones whatever its
micro-batches are and wherever it is stopped and started again, and a table gives them too.

Rows longer than ``longest`` are skipped, and if ``most`` is set only the first ``most`` others of a
key are taken. A row that passes the budget by itself is a batch of its own. Null lengths count as 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class Rules:
    """Sizes in tokens (budget of a batch, longest row) and in batches (buffer)."""

    budget: int = 12_500
    buffer: int = 50
    longest: int | None = 512
    most: int | None = None
    seed: str = "0"


class Buffer:
    """The buffer of one key: rows (id, length) in their present order, the number of the next batch, and how many rows came in."""

    def __init__(self, rules: Rules, key: str, rows: Iterable[tuple[int, int]] = (), number: int = 0, taken: int = 0):
        self.rules, self.key, self.rows, self.number, self.taken = rules, key, list(rows), number, taken
        self.held = sum(n for _, n in self.rows)

    def add(self, row: int, length: int) -> Iterator[tuple[int, int, int]]:
        """Take a row; yields the rows (batch, id, length) of batches that leave."""
        rules = self.rules
        if (rules.longest is not None and length > rules.longest) or (rules.most is not None and self.taken >= rules.most):
            return
        self.rows.append((row, length))
        self.taken += 1
        self.held += length
        if self.held > rules.buffer * rules.budget:
            yield from self.batch()

    def batch(self) -> Iterator[tuple[int, int, int]]:
        drawn = hashlib.md5(f"{self.rules.seed}|{self.key}|{self.number}".encode(), usedforsecurity=False).hexdigest()
        pivot = self.rows[int(drawn[:7], 16) % len(self.rows)][1]
        self.rows.sort(key=lambda r: abs(r[1] - pivot))  # stable, so ties keep their order
        longest = size = 0
        for _, length in self.rows:
            longest = max(longest, length)
            if size and longest * (size + 1) > self.rules.budget:
                break
            size += 1
        out, self.rows = self.rows[:size], self.rows[size:]
        self.held -= sum(n for _, n in out)
        self.number += 1
        for row, length in out:
            yield self.number - 1, row, length

    def drain(self) -> Iterator[tuple[int, int, int]]:
        while self.rows:
            yield from self.batch()


def _schema(df: DataFrame, key: str) -> str:
    return f"`{key}` {df.schema[key].dataType.simpleString()}, batch long, id long, length long"


def buffered_batches(df: DataFrame, key: str, sequence: str, row: str, length: str, rules: Rules = Rules()) -> DataFrame:
    """(key, batch, id, length) of a table: each key's rows pass through one buffer in the order of (sequence, id).

    A task streams its keys, so memory is one buffer, not a key's rows; how many keys there are decides how far it spreads.
    """
    schema = _schema(df, key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buffer, now = None, object()
        for frame in frames:
            out = []
            for k, i, n in zip(frame[key], frame["id"], frame["length"], strict=True):
                if k != now:
                    out += [(now, *r) for r in buffer.drain()] if buffer else []
                    buffer, now = Buffer(rules, str(k)), k
                out += [(k, *r) for r in buffer.add(i, n)]
            yield pd.DataFrame(out, columns=[key, "batch", "id", "length"])
        if buffer:
            yield pd.DataFrame([(now, *r) for r in buffer.drain()], columns=[key, "batch", "id", "length"])

    rows = df.select(key, F.col(sequence).alias("sequence"), F.col(row).cast("long").alias("id"), F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("length"))
    return rows.repartition(key).sortWithinPartitions(key, "sequence", "id").select(key, "id", "length").mapInPandas(run, schema)


class _Batcher(StatefulProcessor):
    """Keeps each key's buffer in the stream's state; a row marked as the last one drains it."""

    def __init__(self, rules: Rules, key: str):
        self.rules, self.key = rules, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "id long, length long")
        self.counts = handle.getValueState("counts", "number long, taken long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["last", "sequence", "id"], kind="stable")
        number, taken = self.counts.get() if self.counts.exists() else (0, 0)
        buffer = Buffer(self.rules, str(key[0]), [(r[0], r[1]) for r in self.rows.get()] if self.rows.exists() else [], number, taken)
        out = []
        for i, n, last in zip(frame["id"], frame["length"], frame["last"], strict=True):
            out += buffer.drain() if last else buffer.add(int(i), int(n))
        if buffer.rows:
            self.rows.put(buffer.rows)
        else:
            self.rows.clear()
        self.counts.update((buffer.number, buffer.taken))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=[self.key, "batch", "id", "length"])

    def close(self) -> None:
        pass


def streamed_batches(stream: DataFrame, key: str, sequence: str, row: str, length: str, last: str, rules: Rules = Rules()) -> DataFrame:
    """As :func:`buffered_batches` for a stream whose files bring a key's rows in order; a row whose ``last`` is true ends its key.

    Needs a state store that keeps keyed state of its own, which :func:`with_state_store` sets.
    """
    columns = [key, F.col(sequence).alias("sequence"), F.col(row).cast("long").alias("id"), F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("length"), F.coalesce(F.col(last), F.lit(False)).alias("last")]
    return stream.select(*columns).groupBy(key).transformWithStateInPandas(statefulProcessor=_Batcher(rules, key), outputStructType=_schema(stream, key), outputMode="Append", timeMode="None")


def with_state_store(spark) -> None:
    """Let streams of this session keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
