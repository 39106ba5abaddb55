"""Pointers at positions of a sequence: probabilities over allowed positions, their mass on target sets, and the metrics of both.

All are column expressions over arrays in a row and cost what the position sets hold, not the
sequence. Sets are ragged: positions outside the sequence, nulls and repeats don't count. Where no
position is allowed nothing has mass, and an empty set of targets has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.metrics import conditional_mean

GUARD = 1e-9


def _inside(positions: Column, length: Column) -> Column:
    return F.array_distinct(F.filter(F.coalesce(positions, F.array().cast("array<int>")), lambda i: i.isNotNull() & (i >= 0) & (i < length)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mass(scores: Column, targets: Column, allowed: Column | None = None) -> Column:
    """The softmax of the scores over the allowed positions (all, where not given), summed up over the targets.

    Targets that aren't allowed have no mass.
    """
    length = F.size(scores)
    at = lambda i: F.element_at(scores, i + 1).cast("double")
    if allowed is None:
        given, top = F.transform(scores, lambda x: x.cast("double")), F.array_max(scores).cast("double")
        hit = _inside(targets, length)
    else:
        places = _inside(allowed, length)
        given = F.transform(places, at)
        top = F.array_max(given)
        hit = F.array_intersect(_inside(targets, length), places)
    total = _sum(F.transform(given, lambda x: F.exp(x - top)))
    found = _sum(F.transform(hit, lambda i: F.exp(at(i) - top)))
    return F.when(F.size(given) > 0, found / total).otherwise(0.0)


def pointed(df: DataFrame, locations: str, repairs: str, length: str, error: str, targets: str, candidates: str) -> DataFrame:
    """Add buggy (1 if the error isn't at position 0), hit (1 if the best of the first ``length`` location scores is the error), error_mass and target_mass."""
    scores = F.slice(locations, F.lit(1), F.col(length))
    best = F.array_position(scores, F.array_max(scores)) - 1
    made = {
        "buggy": (F.col(error) > 0).cast("int"),
        "hit": F.coalesce((best == F.col(error)).cast("int"), F.lit(0)),
        "error_mass": mass(scores, F.array(F.col(error))),
        "target_mass": mass(F.col(repairs), F.col(targets), F.col(candidates)),
    }
    return df.withColumns(made)


def pointer_metrics(df: DataFrame) -> DataFrame:
    """One row of metrics of :func:`pointed` rows.

    location_loss over all; target_loss, location and repair accuracy (at least half the mass on
    targets) and both together over rows with an error; the accuracy on rows without one.
    """
    bug, sound = F.col("buggy"), 1 - F.col("buggy")
    repaired = (F.col("target_mass") >= 0.5).cast("int")
    return df.agg(
        F.avg(-F.log(F.col("error_mass") + GUARD)).alias("location_loss"),
        conditional_mean(-F.log(F.col("target_mass") + GUARD), bug).alias("target_loss"),
        conditional_mean(F.col("hit"), sound).alias("sound_accuracy"),
        conditional_mean(F.col("hit"), bug).alias("location_accuracy"),
        conditional_mean(repaired, bug).alias("repair_accuracy"),
        conditional_mean(F.col("hit") * repaired, bug).alias("joint_accuracy"),
    )
