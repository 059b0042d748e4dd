"""The dense panel (draw_index, number, y) and what is counted on it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators import features
from panelwright.sources.draws import P0, PICK, UNIVERSE

PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47)


def panel(draws: DataFrame) -> DataFrame:
    """A row for every period and number, y = 1 where it was drawn; made from arrays, without a join."""
    every = F.explode(F.sequence(F.lit(1), F.lit(UNIVERSE))).alias("number")
    return draws.select("draw_index", "numbers", every).select("draw_index", "number", F.array_contains("numbers", F.col("number")).cast("int").alias("y"))


def hits(draws: DataFrame) -> DataFrame:
    """(draw_index, number) of the drawn numbers alone: an eighth of the panel."""
    return draws.select("draw_index", F.explode("numbers").alias("number"))


def universe(df: DataFrame) -> DataFrame:
    """The numbers 1 to 49 as rows."""
    return df.sparkSession.range(1, UNIVERSE + 1).select(F.col("id").cast("int").alias("number"))


def gap_statistics(draws: DataFrame, *group: str) -> DataFrame:
    """(group, number, count, current_gap, max_gap, mean_gap, last_index) of every number, never drawn ones included.

    A gap is the distance between consecutive hits; current_gap counts the periods since the last hit; max_gap also
    takes the leading and the current gap. mean_gap is null with fewer than two hits; last_index is -1 without any.
    With ``group`` columns, positions count inside each group.
    """
    if group:
        own = Window.partitionBy(*group).orderBy("draw_index")
        draws = draws.withColumn("draw_index", F.row_number().over(own).cast("long") - 1)
    else:
        return _gap_statistics(draws)
    h = draws.select(*group, "draw_index", F.explode("numbers").alias("number"))
    gap = F.col("draw_index") - F.lag("draw_index").over(Window.partitionBy(*group, "number").orderBy("draw_index"))
    h = h.withColumn("gap", gap).groupBy(*group, "number").agg(F.count("*").alias("count"), F.max("draw_index").alias("last_index"), F.min("draw_index").alias("first_index"), F.max("gap").alias("most"), F.avg("gap").alias("mean_gap"))
    total = draws.groupBy(*group).agg(F.count("*").alias("periods"))
    dense = total.withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(UNIVERSE))))
    on = [dense[c].eqNullSafe(h[c]) for c in (*group, "number")]
    joined = dense.join(h, on, "left").select(*[dense[c] for c in (*group, "number", "periods")], "count", "last_index", "first_index", "most", "mean_gap")
    current = F.coalesce(F.col("periods") - 1 - F.col("last_index"), F.col("periods"))
    return joined.select(*group, "number", "periods", F.coalesce("count", F.lit(0)).alias("count"), current.alias("current_gap"), F.coalesce(F.greatest("most", "first_index", current), F.col("periods")).alias("max_gap"), "mean_gap", F.coalesce("last_index", F.lit(-1)).alias("last_index"))


def _gap_statistics(draws: DataFrame) -> DataFrame:
    """``gap_statistics`` of the whole sequence, from totals of blocks: no hit is sorted, and 49 rows a block meet in windows."""
    blocks = features.block_totals(draws)
    before = F.last("high", ignorenulls=True).over(Window.partitionBy("number").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    h = blocks.withColumn("between", F.col("low") - before).groupBy("number").agg(F.sum("c").alias("count"), F.max("high").alias("last_index"), F.min("low").alias("first_index"), F.max(F.greatest("between", "step")).alias("most"))
    periods = draws.agg(F.count("*").alias("periods"))
    joined = periods.withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(UNIVERSE)))).join(h, "number", "left")
    current = F.coalesce(F.col("periods") - 1 - F.col("last_index"), F.col("periods"))
    # gaps add up to the way from the first hit to the last
    mean = F.when(F.col("count") > 1, (F.col("last_index") - F.col("first_index")) / (F.col("count") - 1)).alias("mean_gap")
    return joined.select("number", "periods", F.coalesce("count", F.lit(0)).alias("count"), current.alias("current_gap"), F.coalesce(F.greatest("most", "first_index", current), F.col("periods")).alias("max_gap"), mean, F.coalesce("last_index", F.lit(-1)).alias("last_index"))


def number_frequency(draws: DataFrame, last: int | None = None) -> DataFrame:
    """Count, share, expectation, z and gaps of every number; ``last`` counts the last periods only, the gaps stay those of all."""
    gaps = gap_statistics(draws)
    if last is None:
        counted = gaps.select("number", F.col("count").alias("n_hit"), F.col("periods").alias("n"))
    else:
        t = F.col("periods") - last
        top = draws.crossJoin(F.broadcast(draws.agg(F.count("*").alias("periods")))).where(F.col("draw_index") >= t)  # one row
        per = hits(top).groupBy("number").agg(F.count("*").alias("n_hit"))
        counted = gaps.select("number", "periods").join(per, "number", "left").select("number", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.least("periods", F.lit(last)).alias("n"))
    e = F.col("n") * P0
    joined = gaps.join(counted, "number")
    return joined.select("number", F.col("n_hit").alias("count"), F.try_divide("n_hit", "n").alias("proportion"), e.alias("expected"), (F.col("n_hit") - e).alias("difference"), F.try_divide(F.col("n_hit") - e, F.sqrt(e * (1 - P0))).alias("z_score"), "current_gap", "max_gap", "mean_gap", "last_index")


def frequency_by_year(draws: DataFrame) -> DataFrame:
    """Frequencies and gaps inside each calendar year."""
    return gap_statistics(draws.withColumn("year", F.year("draw_date")), "year")


def draw_patterns(draws: DataFrame) -> DataFrame:
    """Features of each period's set, from its sorted array alone and the set before."""
    n = F.col("numbers")
    before = draws.select((F.col("draw_index") + 1).alias("draw_index"), F.col("numbers").alias("before"))
    steps = F.zip_with(F.slice(n, 2, PICK - 1), F.slice(n, 1, PICK - 1), lambda b, a: b - a)
    tails = F.transform(n, lambda x: x % 10)
    total = F.aggregate(n, F.lit(0), lambda a, x: a + x)
    squares = F.aggregate(n, F.lit(0), lambda a, x: a + x * x)
    size = lambda f: F.size(F.filter(n, f)).cast("long")
    primes = F.array(*[F.lit(p) for p in PRIMES])
    decade = F.transform(n, lambda x: F.least(F.floor(x / 10), F.lit(4)))
    decades = [(F.lit(PICK) - F.size(F.array_remove(decade, F.lit(i).cast("long")))).cast("long").alias(f"decade_{i}") for i in range(5)]
    return draws.join(before, "draw_index", "left").select(
        "draw_index",
        size(lambda x: x % 2 == 1).alias("odd_count"),
        size(lambda x: x >= 25).alias("high_count"),
        total.cast("long").alias("total"),
        n[0].alias("lowest"),
        n[PICK - 1].alias("highest"),
        (n[PICK - 1] - n[0]).alias("span"),
        (total / PICK).alias("mean"),
        F.sqrt(squares / PICK - (total / PICK) * (total / PICK)).alias("std"),
        F.size(F.filter(steps, lambda s: s == 1)).cast("long").alias("adjacent_pairs"),
        (F.lit(PICK) - F.size(F.array_distinct(tails))).cast("long").alias("duplicate_tails"),
        F.coalesce(F.size(F.array_intersect(n, F.col("before"))), F.lit(0)).cast("long").alias("overlap_previous"),
        size(lambda x: F.array_contains(primes, x)).alias("prime_count"),
        *decades,
        *[steps[i].alias(f"gap_{i + 1}") for i in range(PICK - 1)],
    )


def cooccurrence(draws: DataFrame, k: int) -> DataFrame:
    """(key, count, expected, z_score) of every k-subset of the universe, zero counts included; k is 2 or 3.

    Subsets come from each period's array; counting is one aggregation. Order columns: count falling, then key as text.
    """
    n = F.col("numbers")
    places = [c for c in _combinations(PICK, k)]
    subsets = F.array(*[F.struct(*[n[i].alias(f"n{j + 1}") for j, i in enumerate(c)]) for c in places])
    counts = draws.select(F.explode(subsets).alias("s")).select("s.*").groupBy(*[f"n{j + 1}" for j in range(k)]).agg(F.count("*").alias("count"))
    every = universe(draws).withColumnRenamed("number", "n1")
    for j in range(2, k + 1):  # at most 18,424 rows, whatever the input
        every = every.withColumn(f"n{j}", F.explode(F.sequence(F.lit(1), F.lit(UNIVERSE)))).where(F.col(f"n{j}") > F.col(f"n{j - 1}"))
    p = math.comb(UNIVERSE - k, PICK - k) / math.comb(UNIVERSE, PICK)
    total = draws.agg(F.count("*").alias("periods"))
    joined = every.join(counts, [f"n{j + 1}" for j in range(k)], "left").crossJoin(F.broadcast(total))  # one row
    e = F.col("periods") * p
    c = F.coalesce("count", F.lit(0))
    return joined.select(F.concat_ws("-", *[f"n{j + 1}" for j in range(k)]).alias("combination"), c.alias("count"), e.alias("expected"), F.try_divide(c - e, F.sqrt(e * (1 - p))).alias("z_score"))


def _combinations(n: int, k: int) -> list[tuple[int, ...]]:
    from itertools import combinations

    return list(combinations(range(n), k))


def hypergeometric(total: int, good: int, picked: int) -> list[tuple[int, float]]:
    """(value, probability) of the number of good ones among ``picked`` of ``total``."""
    return [(i, math.comb(good, i) * math.comb(total - good, picked - i) / math.comb(total, picked)) for i in range(min(good, picked) + 1)]


def prize_law() -> list[tuple[int, bool, float]]:
    """(main_matches, special_match, probability) of a ticket of six numbers; matches that cannot be are left out."""
    rest = UNIVERSE - PICK - 1
    tiers = [(m, bool(s), PICK - m - s) for m in range(PICK + 1) for s in (0, 1)]
    return [(m, s, math.comb(PICK, m) * math.comb(rest, others) / math.comb(UNIVERSE, PICK)) for m, s, others in tiers if others >= 0]


def adjacent_probability() -> float:
    """The chance that a draw has two consecutive numbers at least."""
    return 1 - math.comb(UNIVERSE - PICK + 1, PICK) / math.comb(UNIVERSE, PICK)


def convolved(law: list[tuple[int, float]], times: int) -> list[tuple[int, float]]:
    """The law of the sum of so many independent values from 0 on."""
    out = [1.0]
    for _ in range(times):
        out = [sum(out[i - v] * p for v, p in law if 0 <= i - v < len(out)) for i in range(len(out) + len(law) - 1)]
    return list(enumerate(out))


def against_theory(observed: DataFrame, value: str, law: list[tuple[int, float]]) -> DataFrame:
    """Counts of ``value`` next to a law's expectation; values without a count are kept."""
    table = observed.sparkSession.createDataFrame(law, "value int, probability double")
    counts = observed.groupBy(F.col(value).cast("int").alias("value")).agg(F.count("*").alias("count"))
    total = observed.agg(F.count("*").alias("n"))
    return table.join(counts, "value", "left").crossJoin(F.broadcast(total)).select("value", "probability", F.coalesce("count", F.lit(0)).alias("count"), (F.col("probability") * F.col("n")).alias("expected"))


def z_within(value: Column, *by: str) -> Column:
    """Population z-score inside each group; 0 where the spread vanishes."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(value).over(w)
    return F.when(sd <= 1e-15, F.lit(0.0)).otherwise((value - F.avg(value).over(w)) / sd)


#: Draws of one range of a rolling mean.
SPAN = 8_192


def rolling_mean(draws: DataFrame, width: int) -> DataFrame:
    """(draw_index, rolling_mean): mean total of a draw and of the ``width`` - 1 before it, null where there are fewer.

    Draws are dealt out by ranges; the last rows of a range go to the next one as well.
    """
    own = F.floor(F.col("draw_index") / SPAN)
    ranges = F.explode(F.when(F.col("draw_index") % SPAN > SPAN - width, F.array(own, own + 1)).otherwise(F.array(own))).alias("range")
    total = F.aggregate("numbers", F.lit(0), lambda a, x: a + x).cast("double").alias("total")
    w = Window.partitionBy("range").orderBy("draw_index").rowsBetween(1 - width, 0)
    mean = F.when(F.count("*").over(w) == width, F.avg("total").over(w)).alias("rolling_mean")
    return draws.select("draw_index", total, ranges).select("draw_index", "range", mean).where(own == F.col("range")).drop("range")
