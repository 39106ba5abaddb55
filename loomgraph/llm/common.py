"""Helpers shared by the corpus operators: row passing and byte-balanced batching."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text of an Arrow batch that are worked on at once.
PART_BYTES = 4 << 20


def release() -> None:
    """Give memory that this worker has freed back to the system; workers outlive tasks and stages.

    Collecting also empties the interpreter's lists of free objects, which keep whole blocks in use.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def bounded_batches(spark: SparkSession, size: int = PART_BYTES) -> None:
    """Let Arrow batches of the session hold ``size`` bytes at most (a larger row alone), on both sides of a worker's pipe.

    The setting's own bound is 64 MB; what a batch takes outside the heap is kept for the next one.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(setting, str(size))


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with :func:`release` before and after a partition."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        release()

    return wrapped


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None for nulls."""
    return column.cast(pa.large_binary()).to_pylist()


def by_bytes(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges [start, end) of consecutive rows with about ``most`` bytes each; a larger row is alone."""
    start = held = at = 0
    for at, size in enumerate(sizes, 1):
        if held and held + size > most:
            yield start, at - 1
            start, held = at - 1, 0
        held += size
    if at > start:
        yield start, at


def in_parts(batch: pa.RecordBatch, text: int, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, so that a part only becomes Python objects at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    for start, end in by_bytes(sizes, most):
        yield batch.slice(start, end - start)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that hold groups whole, from batches in which a group's rows are consecutive; a larger group is alone."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held)
        ends = np.zeros(table.num_rows - 1, bool)  # whether the next row begins another group
        for key in keys:
            column = table[key].combine_chunks()
            ends |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
        start = 0
        for cut in np.flatnonzero(ends) + 1:
            if cut - start >= rows:
                yield table.slice(start, cut - start)
                start = int(cut)
        last = int(np.flatnonzero(ends)[-1]) + 1 if ends.any() else 0
        if last - start >= rows // 2:
            yield table.slice(start, last - start)
            start = last
        held = table.slice(start).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def forget(cache: dict) -> None:
    """Drop the older half of a worker's cache."""
    for key in [*itertools.islice(cache, len(cache) // 2)]:
        del cache[key]


def with_columns(
    df: DataFrame,
    text: str,
    fields: list[tuple[str, T.DataType]],
    work: Callable[[list], list[list]],
    as_bytes: bool = False,
    keep: Callable[[dict], list[bool]] | None = None,
    after: Callable[[], None] | None = None,
) -> DataFrame:
    """Add columns that ``work`` computes from the texts of an Arrow batch.

    ``work`` gets the texts (str, or UTF-8 bytes; None for null) and returns a list of values for
    each field. Other columns pass through untouched; an input column with the name of a new one
    gives way to it. ``keep`` gets the new columns by name and says which rows stay;
    ``after`` is called at the end of a partition.
    """
    names = {name for name, _ in fields}
    rest = [f for f in df.schema.fields if f.name not in names]
    at = [f.name for f in df.schema.fields].index(text)
    places = [i for i, f in enumerate(df.schema.fields) if f.name not in names]
    schema = T.StructType(rest + [T.StructField(name, kind) for name, kind in fields])
    arrow = [_arrow(kind) for _, kind in fields]
    all_names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in in_parts(whole, at)):
            column = batch.column(at)
            made = work(text_bytes(column) if as_bytes else column.to_pylist())
            arrays = [batch.column(i) for i in places] + [pa.array(v, t) for v, t in zip(made, arrow, strict=True)]
            out = pa.RecordBatch.from_arrays(arrays, names=all_names)
            if keep is not None:
                out = out.filter(pa.array(keep(dict(zip([n for n, _ in fields], made, strict=True))), pa.bool_()))
            yield out
        if after is not None:
            after()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(trimmed(run), schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
