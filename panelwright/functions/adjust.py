"""Multiple-testing corrections, intervals and projections as columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adjusted(df: DataFrame, p: str = "p", *ties: str) -> DataFrame:
    """bonferroni, holm and bh of the tests in ``df``; null p-values count as 1. Tests are rows of a table of results."""
    q = F.coalesce(p, F.lit(1.0))
    all_, up = Window.partitionBy(), Window.orderBy(q, *ties)
    m = F.count("*").over(all_)
    rank = F.row_number().over(up)
    out = df.withColumn("bonferroni", F.least(q * m, F.lit(1.0))).withColumn("_m", m).withColumn("_rank", rank)
    out = out.withColumn("holm", F.least(F.max((F.col("_m") - F.col("_rank") + 1) * q).over(up.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)))
    down = Window.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("bh", F.least(F.min(q * F.col("_m") / F.col("_rank")).over(down), F.lit(1.0))).drop("_m", "_rank")


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of a proportion."""
    p, z2 = k / n, z * z
    centre, half = (p + z2 / (2 * n)) / (1 + z2 / n), z / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return centre - half, centre + half


def projected(values: Column, total: float = 6.0) -> Column:
    """The nearest point with entries in [0, 1] that sum to ``total``, of an array of at least ``total`` doubles.

    The point is the values less one shift, cut to [0, 1]. As the shift falls from the greatest value, the sum grows by
    the number of entries strictly inside: an entry enters at its value and leaves at its value less 1. The walk over
    those places in order meets the total on one of them or between two.
    """
    place = lambda by, turn: F.transform(values, lambda x: F.struct((F.lit(float(by)) - x).alias("at"), F.lit(turn).alias("turn")))
    places = F.array_sort(F.concat(place(0, 1), place(1, -1)))
    begin = F.struct(places[0]["at"].alias("at"), F.lit(0).alias("inside"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("shift"))

    def walk(a: Column, x: Column) -> Column:
        reached = a["sum"] + a["inside"] * (x["at"] - a["at"])
        shift = F.when(a["shift"].isNull() & (a["inside"] > 0) & (reached >= total), (reached - total) / a["inside"] - x["at"]).otherwise(a["shift"])
        return F.struct(x["at"].alias("at"), (a["inside"] + x["turn"]).alias("inside"), reached.alias("sum"), shift.alias("shift"))

    shift = F.coalesce(F.aggregate(places, begin, walk)["shift"], F.array_min(values) - 1)  # all entries 1: rounding may keep the sum just below the total
    return F.transform(F.arrays_zip(values.alias("v"), F.array_repeat(shift, F.size(values)).alias("s")), lambda z: F.least(F.greatest(z["v"] - z["s"], F.lit(0.0)), F.lit(1.0)))


def projected_rows(values: np.ndarray, total: float = 6.0) -> np.ndarray:
    """``projected`` of every row of a matrix, by the same walk."""
    both = np.hstack([1.0 - values, 0.0 - values])  # entries leave before others enter at the same place
    order = np.argsort(both, 1, kind="stable")
    at = np.take_along_axis(both, order, 1)
    inside = np.cumsum(np.where(order < values.shape[1], -1, 1), 1)[:, :-1]
    reached = np.cumsum(inside * np.diff(at), 1)
    met = (inside > 0) & (reached >= total)
    first = met.argmax(1)[:, None]
    here = lambda x: np.take_along_axis(x, first, 1)
    shift = (here(reached) - total) / np.maximum(here(inside), 1) - here(at[:, 1:])
    shift = np.where(met.any(1, keepdims=True), shift, values.min(1, keepdims=True) - 1)
    return np.clip(values - shift, 0.0, 1.0)


def shrunk(p: Column, strength: float = 0.1, uniform: float = 6 / 49) -> Column:
    return p * (1 - strength) + strength * uniform
