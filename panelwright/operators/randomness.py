"""Tests of uniformity and dependence on the panel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.special import chi_square_sf, normal_sf, udf
from panelwright.operators.features import followed_hits, lagged_hits
from panelwright.operators.panel import gap_statistics, hits, universe
from panelwright.sources.draws import P0, UNIVERSE


def chi_square_uniform(draws: DataFrame) -> DataFrame:
    """(statistic, df, p) of the numbers' counts against equal chances."""
    g = gap_statistics(draws)
    e = F.col("periods") * P0
    out = g.agg(F.sum((F.col("count") - e) * (F.col("count") - e) / e).alias("statistic"), F.lit(UNIVERSE - 1).alias("df"))
    return out.withColumn("p", udf(lambda x, df: chi_square_sf(x, df))("statistic", "df"))


def number_tests(draws: DataFrame, lags: int = 10) -> DataFrame:
    """Per number: lag-1 autocorrelation, runs and their z and p, Ljung-Box statistic and p; null where a number is constant.

    Lagged products are counted from pairs of hits a lag apart, inside blocks that have the periods before them as well.
    """
    h = hits(draws)
    total = draws.agg(F.count("*").cast("double").alias("n"))
    base = gap_statistics(draws).select("number", "count", F.col("periods").cast("double").alias("n"))
    first = F.col("draw_index") < F.lit(lags)
    last = F.col("draw_index") >= F.col("n") - lags
    ends = h.crossJoin(F.broadcast(total)).where(first | last)  # one row
    lagged = F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag")
    pairs = lagged_hits(draws, lags)
    edge = ends.select("number", "draw_index", "n", lagged).groupBy("number", "lag").agg(F.sum((F.col("draw_index") < F.col("lag")).cast("int")).alias("head"), F.sum((F.col("draw_index") >= F.col("n") - F.col("lag")).cast("int")).alias("tail"))
    grid = base.select("number", "count", "n", lagged).where(F.col("lag") <= F.greatest(F.lit(1), F.least(F.lit(lags), F.floor(F.col("n") / 5))))
    grid = grid.join(pairs, ["number", "lag"], "left").join(edge, ["number", "lag"], "left").na.fill(0, ["both", "head", "tail"])
    m = F.try_divide("count", "n")
    # sum over t of (y_t - m)(y_{t-lag} - m), from counts
    cross = F.col("both") - m * (2 * F.col("count") - F.col("head") - F.col("tail")) + (F.col("n") - F.col("lag")) * m * m
    rho = F.try_divide(cross, F.col("n") * m * (1 - m))
    lb = grid.groupBy("number", "n", "count").agg(F.sum(rho * rho / (F.col("n") - F.col("lag"))).alias("s"), F.count("*").alias("lags"), F.max(F.when(F.col("lag") == 1, F.col("both"))).alias("both"), F.max(F.when(F.col("lag") == 1, F.col("head"))).alias("head"), F.max(F.when(F.col("lag") == 1, F.col("tail"))).alias("tail"))
    k, x, y = F.col("n") - 1, F.col("count") - F.col("tail"), F.col("count") - F.col("head")
    corr = F.try_divide(F.col("both") * k - x * y, F.sqrt(x * (k - x) * y * (k - y)))
    n1, n0 = F.col("count").cast("double"), F.col("n") - F.col("count")
    runs = (x + y - 2 * F.col("both") + 1).cast("long")  # changes of state, and one
    mu = F.try_divide(2 * n1 * n0, F.col("n")) + 1
    var = F.try_divide(2 * n1 * n0 * (2 * n1 * n0 - F.col("n")), F.col("n") * F.col("n") * (F.col("n") - 1))
    out = lb.select("number", corr.alias("autocorrelation"), runs.alias("runs"), F.try_divide(runs - mu, F.sqrt(var)).alias("runs_z"), (F.col("n") * (F.col("n") + 2) * F.col("s")).alias("ljung_box"), "lags")
    return out.withColumn("runs_p", udf(lambda z: 2 * normal_sf(abs(z)))("runs_z")).withColumn("ljung_box_p", udf(lambda q, df: chi_square_sf(q, df))("ljung_box", "lags"))


def cross_dependence(draws: DataFrame) -> DataFrame:
    """(a, b, n11, n10, n01, n00, phi, mutual_information, chi_square) of a at t and b at t + 1, for all a < b.

    Joint counts are products of a block's hits and those a period later; the table's other cells follow from marginal counts.
    """
    joint = followed_hits(draws)
    total = draws.agg(F.count("*").alias("t"), F.max("draw_index").alias("last"))
    h = hits(draws).crossJoin(F.broadcast(total))  # one row
    ends = h.groupBy("number").agg(F.sum((F.col("draw_index") < F.col("last")).cast("int")).alias("first"), F.sum((F.col("draw_index") > 0).cast("int")).alias("second"))
    u = universe(draws)
    ends = u.join(ends, "number", "left").na.fill(0)
    grid = ends.select(F.col("number").alias("a"), F.col("first").alias("na")).join(ends.select(F.col("number").alias("b"), F.col("second").alias("nb")), F.col("a") < F.col("b"))  # 1,176 rows
    g = grid.join(joint, ["a", "b"], "left").na.fill(0, ["n11"]).crossJoin(F.broadcast(total.select((F.col("t") - 1).alias("n"))))
    g = g.withColumn("n10", F.col("na") - F.col("n11")).withColumn("n01", F.col("nb") - F.col("n11")).withColumn("n00", F.col("n") - F.col("na") - F.col("nb") + F.col("n11"))
    n, na, nb = (F.col(c).cast("double") for c in ("n", "na", "nb"))
    det = F.col("n11") * F.col("n00").cast("double") - F.col("n10") * F.col("n01")
    phi = F.try_divide(det, F.sqrt(na * (n - na) * nb * (n - nb)))
    part = lambda c, x, y: F.when(F.col(c) > 0, F.col(c) / n * F.log(F.col(c) * n / (x * y))).otherwise(0.0)
    mi = part("n11", na, nb) + part("n10", na, n - nb) + part("n01", n - na, nb) + part("n00", n - na, n - nb)
    out = g.select("a", "b", "n11", "n10", "n01", "n00", phi.alias("phi"), mi.alias("mutual_information"), (n * phi * phi).alias("chi_square"))
    return out


def half_contingency(draws: DataFrame) -> DataFrame:
    """(number, first_half, second_half): counts before and from the middle period."""
    middle = F.floor(F.col("t") / 2)
    h = hits(draws).crossJoin(F.broadcast(draws.agg(F.count("*").alias("t"))))
    c = h.groupBy("number").agg(F.sum((F.col("draw_index") < middle).cast("int")).alias("first_half"), F.sum((F.col("draw_index") >= middle).cast("int")).alias("second_half"))
    return universe(draws).join(c, "number", "left").na.fill(0)


def gap_goodness(draws: DataFrame) -> DataFrame:
    """(number, gaps, statistic, df, p) of each number's closed gaps against the geometric law; null below 20 gaps.

    Cells hold single gaps while their expectation is at least 5, the last the rest.
    """
    step = F.col("draw_index") - F.lag("draw_index").over(Window.partitionBy("number").orderBy("draw_index"))
    counts = hits(draws).withColumn("gap", step).where("gap is not null").groupBy("number", "gap").agg(F.count("*").alias("c"))

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["c"].sum())
        row = {"number": int(pdf["number"].iloc[0]), "gaps": n, "statistic": None, "df": None, "p": None}
        if n >= 20:
            cells = 0
            while n * P0 * (1 - P0) ** cells >= 5:
                cells += 1
            expected = np.array([n * P0 * (1 - P0) ** i for i in range(cells)] + [n * (1 - P0) ** cells])
            seen = np.bincount(np.minimum(pdf["gap"].to_numpy() - 1, cells), pdf["c"].to_numpy(), cells + 1)
            x = float(((seen - expected) ** 2 / expected).sum())
            row |= {"statistic": x, "df": float(cells), "p": chi_square_sf(x, cells)}
        return pd.DataFrame([row])

    return counts.groupBy("number").applyInPandas(test, "number int, gaps long, statistic double, df double, p double")
