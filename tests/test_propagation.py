"""Rounds of propagation and readouts against a plain loop over nodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import propagation as p

SIZE, OUT, ROUNDS = 3, 2, 2


def setup(seed=1):
    rng = np.random.default_rng(seed)
    dense = lambda o, i: p.Dense(rng.normal(size=(o, i)), rng.normal(size=o))
    states = {n: rng.normal(size=SIZE) for n in range(12)}
    edges = [(int(a), int(b), int(t)) for a, b, t in rng.integers(0, [12, 8, 2], size=(30, 3))]
    edges.append(edges[0])  # an edge that repeats counts twice
    rounds = [p.Round([dense(SIZE, SIZE) for _ in range(2)], dense(SIZE, 2 * SIZE), dense(SIZE, SIZE) if r else None) for r in range(ROUNDS)]
    return states, edges, rounds, dense


def plain(states, edges, rounds, act, how):
    levels = [{n: act(v) for n, v in states.items()}]
    for layer in rounds:
        new = {}
        for n in states:
            message = []
            for k, dense in enumerate(layer.by_type):
                got = [dense.weights @ levels[-1][a] + dense.bias for a, b, t in edges if (b, t) == (n, k)]
                message.append(np.zeros(SIZE) if not got else np.sum(got, 0) if how == "sum" else np.mean(got, 0))
            merged = layer.merge.weights @ act(np.concatenate(message)) + layer.merge.bias
            if layer.after:
                merged = layer.after.weights @ merged + layer.after.bias
            new[n] = act(merged + levels[-1][n])
        levels.append(new)
    return levels


def frames(spark, states, edges):
    rows = [(n, [float(x) for x in v]) for n, v in states.items()]
    return spark.createDataFrame(rows, "node long, state array<double>"), spark.createDataFrame(edges, "src long, dst long, type int")


@pytest.mark.parametrize(("activation", "how"), [("tanh", "sum"), ("elu", "mean"), ("relu", "sum")])
def test_rounds_same_as_loop(spark, activation, how):
    states, edges, rounds, _ = setup()
    got = p.propagate(*frames(spark, states, edges), rounds, SIZE, activation, how).collect()
    want = plain(states, edges, rounds, p.ACTIVATIONS[activation], how)
    assert len(got) == 12 * (ROUNDS + 1)
    for r in got:
        assert np.allclose(r.state, want[r.level][r.node])


def test_readouts(spark):
    states, edges, rounds, dense = setup(2)
    levels = p.propagate(*frames(spark, states, edges), rounds, SIZE).cache()
    want = plain(states, edges, rounds, np.tanh, "sum")
    members = spark.range(12).select(F.col("id").alias("node"), (F.col("id") % 3).alias("graph"))
    layers = [dense(OUT, SIZE) for _ in range(ROUNDS + 1)]
    gru = p.Gru(dense(3 * OUT, OUT), dense(3 * OUT, OUT))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def cell(x, h):
        i, s = gru.of_input.weights @ x + gru.of_input.bias, gru.of_state.weights @ h + gru.of_state.bias
        r, z = sigmoid(i[:OUT] + s[:OUT]), sigmoid(i[OUT : 2 * OUT] + s[OUT : 2 * OUT])
        return (1 - z) * np.tanh(i[2 * OUT :] + r * s[2 * OUT :]) + z * h

    for nodes in ("sum", "mean", "max", "min"):
        for how in ("last", "sum", "mean", "max", "gru"):
            got = {r.graph: r.state for r in p.readout(levels, members, ROUNDS, SIZE, p.Readout(nodes, how, layers, "sigmoid", gru)).collect()}
            for g in range(3):
                pooled = []
                for i, level in enumerate(want):
                    layer = layers[0 if how == "last" else i]
                    pooled.append(getattr(np, nodes)([sigmoid(layer.weights @ level[n] + layer.bias) for n in range(12) if n % 3 == g], axis=0))
                if how == "gru":
                    out = pooled[0]
                    for x in pooled[1:]:
                        out = cell(x, out)
                else:
                    out = pooled[-1] if how == "last" else getattr(np, how)(pooled, axis=0)
                assert np.allclose(got[g], out), (nodes, how)


def test_without_edges(spark):
    states, _, rounds, _ = setup()
    s, _ = frames(spark, states, [(0, 0, 0)])
    none = spark.createDataFrame([], "src long, dst long, type int")
    want = plain(states, [], rounds, np.tanh, "sum")
    assert all(np.allclose(r.state, want[r.level][r.node]) for r in p.propagate(s, none, rounds, SIZE).collect())
    assert p.propagate(s.limit(0), none, rounds, SIZE).count() == 0
