"""Several rounds of message passing by edge type with given weights, and readouts across the rounds.

A state is a row (node, state): an array of doubles. A round sums (or averages) the states of the
sources of a node's edges for each edge type, which Spark does in its own aggregation, sends the
sums through dense layers in Arrow batches, adds the node's state and applies the activation. As the
first layer is linear, sums are taken before it: one vector for each node and type is shuffled,
never one for each edge. Each round is written once and the next reads it, so a lost executor costs
its tasks alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.tables import settle

ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "tanh": np.tanh,
    "relu": lambda x: np.maximum(x, 0),
    "sigmoid": lambda x: 1 / (1 + np.exp(-x)),
    "softplus": lambda x: np.logaddexp(x, 0),
    "elu": lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0))),
    "swish": lambda x: x / (1 + np.exp(-x)),
    "square": np.square,
    "identity": lambda x: x,
}


@dataclass
class Dense:
    """x to weights @ x + bias."""

    weights: np.ndarray
    bias: np.ndarray

    def __call__(self, x: np.ndarray, times: np.ndarray | float = 1.0) -> np.ndarray:
        """``times``: how many inputs were summed up in each row of x, as each brings the bias once."""
        return x @ self.weights.T + np.multiply.outer(times, self.bias)


@dataclass
class Round:
    """A dense layer for each edge type, one that merges their activated outputs, and optionally one after it."""

    by_type: list[Dense]
    merge: Dense
    after: Dense | None = None


@dataclass
class Gru:
    """A gated unit: weights of input and state for the reset, update and new gates, stacked in this order."""

    of_input: Dense
    of_state: Dense

    def __call__(self, x: np.ndarray, held: np.ndarray) -> np.ndarray:
        (ri, zi, ni), (rh, zh, nh) = np.split(self.of_input(x), 3, axis=-1), np.split(self.of_state(held), 3, axis=-1)
        sigmoid = ACTIVATIONS["sigmoid"]
        z = sigmoid(zi + zh)
        return (1 - z) * np.tanh(ni + sigmoid(ri + rh) * nh) + z * held


@dataclass
class Readout:
    """How node states become one vector for each graph: a layer for each round (or one for all), an aggregate of nodes, a combination of rounds."""

    nodes: str = "sum"  # sum, mean, max, min
    rounds: str = "last"  # last, sum, mean, max, gru
    layers: list[Dense] = field(default_factory=list)
    activation: str = "identity"
    gru: Gru | None = None


def summed_messages(edges: DataFrame, states: DataFrame, size: int, how: str = "sum") -> DataFrame:
    """(node, got): for each edge type that reaches a node a struct (type, times, total); ``how`` is sum or mean, whose times is 1."""
    sent = edges.select(F.col("src").alias("node"), "dst", "type").join(states, "node")
    one = F.sum if how == "sum" else F.avg
    sums = sent.groupBy("dst", "type").agg(F.count("*").cast("double").alias("n"), *[one(F.col("state")[i]).alias(f"s{i}") for i in range(size)])
    times = F.col("n") if how == "sum" else F.lit(1.0)
    row = F.struct("type", times.alias("times"), F.array(*[f"s{i}" for i in range(size)]).alias("total"))
    return sums.groupBy(F.col("dst").alias("node")).agg(F.collect_list(row).alias("got"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def propagate(states: DataFrame, edges: DataFrame, rounds: list[Round], size: int, activation: str = "tanh", how: str = "sum") -> DataFrame:
    """(node, level, state): the activated first states at level 0 and the states after each round.

    ``edges`` has (src, dst, type), types from 0. Nodes without incoming edges keep to their own state.
    """
    act = ACTIVATIONS[activation]
    kind = states.schema["node"].dataType.simpleString()
    made = f"node {kind}, state array<double>"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows(batch.column(0), act(_matrix(batch.column(1), size)))

    def step(layer: Round):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = _matrix(batch.column(1), size)
                total, times = np.zeros((len(layer.by_type), *held.shape)), np.zeros((len(layer.by_type), len(held)))
                got = batch.column(2)
                owner = np.repeat(np.arange(len(held)), got.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int))
                found = got.flatten()
                types = found.field("type").to_numpy(zero_copy_only=False).astype(int)
                total[types, owner] = _matrix(found.field("total"), size)
                times[types, owner] = found.field("times").to_numpy(zero_copy_only=False)
                message = act(np.concatenate([dense(total[k], times[k]) for k, dense in enumerate(layer.by_type)], axis=1))
                merged = layer.merge(message, np.ones(len(held)))
                if layer.after is not None:
                    merged = layer.after(merged, np.ones(len(held)))
                yield _rows(batch.column(0), act(merged + held))

        return run

    levels = [settle(states.select("node", "state").mapInArrow(first, made), "states")]
    for layer in rounds:
        got = summed_messages(edges, levels[-1], size, how)
        levels.append(settle(levels[-1].join(got, "node", "left").select("node", "state", "got").mapInArrow(step(layer), made), "states"))
    return reduce(DataFrame.unionByName, [df.withColumn("level", F.lit(i)) for i, df in enumerate(levels)]).select("node", "level", "state")


def _rows(first: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1])
    return pa.RecordBatch.from_arrays([first, pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))], names=["node", "state"])


def readout(levels: DataFrame, members: DataFrame, last: int, size: int, how: Readout) -> DataFrame:
    """(graph, state) from the states of all levels; ``members`` has (node, graph), ``last`` is the number of rounds.

    Nodes are aggregated level by level in Spark; then a graph has one vector for each level and these are combined.
    """
    used = levels.where(F.col("level") == last) if how.rounds == "last" else levels
    kind = members.schema["graph"].dataType.simpleString()
    act, out = ACTIVATIONS[how.activation], how.layers[0].weights.shape[0] if how.layers else size

    def layer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(2), size)
            y = np.zeros((len(x), out))
            for level in np.unique(at):
                part = at == level
                dense = how.layers[0 if how.rounds == "last" else level] if how.layers else None
                y[part] = act(dense(x[part], np.ones(part.sum())) if dense else x[part])
            named = _rows(batch.column(0), y)
            yield pa.RecordBatch.from_arrays([named.column(0), batch.column(1), named.column(1)], names=["graph", "level", "state"])

    states = used.join(members.select("node", "graph"), "node").select("graph", "level", "state").mapInArrow(layer, f"graph {kind}, level int, state array<double>")
    one = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[how.nodes]
    pooled = states.groupBy("graph", "level").agg(F.array(*[one(F.col("state")[i]) for i in range(out)]).alias("state"))
    graphs = pooled.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("level", "state"))).alias("s")).select("graph", F.transform("s", lambda x: x.state).alias("s"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1, out)
            if how.rounds == "gru":
                made = x[:, 0]
                for i in range(1, x.shape[1]):
                    made = how.gru(x[:, i], made)
            else:
                made = x[:, -1] if how.rounds == "last" else getattr(x, how.rounds)(axis=1)
            named = _rows(batch.column(0), made)
            yield pa.RecordBatch.from_arrays(named.columns, names=["graph", "state"])

    return graphs.mapInArrow(combine, f"graph {kind}, state array<double>")
