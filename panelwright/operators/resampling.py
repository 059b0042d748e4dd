"""Simulated histories and resampling: every replicate has its own seed, so that results do not depend on partitions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.sources.draws import P0, PICK, UNIVERSE

METRICS = ("max_abs_deviation", "max_gap", "mean_sum", "sum_std", "overlap_rate", "max_overlap")
#: Periods of a history that a worker holds at once, those at either end of them that nearly always hit every number, and a usual length of its longest gaps.
CHUNK, EDGE, USUAL = 16_320, 128, 64
#: A draw's bits; its sum stands above them.
BITS, SUM_AT = np.uint64((1 << UNIVERSE + 1) - 2), np.uint64(UNIVERSE + 1)


@cache
def _triples() -> tuple[np.ndarray, np.ndarray]:
    """Sets of three numbers by 16 random bits: their numbers in the bytes of an integer, one byte left 0, and their bits with their sum above them.

    Every set has as many places as any other; the places left over have all bits, so that nothing goes with them.
    """
    sets = np.array(list(combinations(range(1, UNIVERSE + 1), PICK // 2)))
    place = np.arange(1 << 16)
    left, place = place >= len(place) // len(sets) * len(sets), place % len(sets)
    packed = (np.uint64(1) << sets.astype(np.uint64)).sum(1, dtype=np.uint64) + (sets.sum(1).astype(np.uint64) << SUM_AT)
    return np.pad(sets.astype(np.uint8), ((0, 0), (0, 1))).view(np.uint32)[place, 0], np.where(left, BITS, packed[place])


def _pairs(rng: np.random.Generator, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``n`` fair draws in parts: two places of ``_triples`` for each try, their bits and sums added, and the tries that are draws. A draw is two sets of three at random, drawn again where they share a number.

    Every draw parts into as many such pairs as any other, so that all are equally likely.
    """
    _, table = _triples()
    while n > 0:
        a, b = rng.bit_generator.random_raw(n * 7 // 8 + 16).view(np.uint16).reshape(2, -1)
        x, y = table.take(a), table.take(b)
        apart = np.flatnonzero((x & y & BITS) == 0)[:n]
        yield a, b, x + y, apart
        n -= len(apart)


def fair(rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``n`` fair draws: a row of eight bytes each, two of which are 0, as bits, and their sums."""
    sets, _ = _triples()
    a, b, packed = (np.concatenate(x) for x in zip(*[(a[k], b[k], both[k]) for a, b, both, k in _pairs(rng, n)], strict=True))
    return np.stack([sets[a], sets[b]], 1).view(np.uint8), packed & BITS, (packed >> SUM_AT).astype(np.int64)


def _counts(masks: np.ndarray) -> np.ndarray:
    """How many of ``masks`` have each number: fields of 2, 4 and 8 bits are added up, as many as they have room for."""
    fields = masks[None]
    for width, room, keep in ((1, 3, 0x5555555555555555), (2, 5, 0x3333333333333333), (4, 17, 0x0F0F0F0F0F0F0F0F)):
        if rest := -fields.shape[1] % room:
            fields = np.pad(fields, ((0, 0), (0, rest)))
        fields = fields.reshape(len(fields), room, -1)
        fields = np.concatenate([np.add.reduce(f & np.uint64(keep), 1) for f in (fields, fields >> np.uint64(width))])
    bytes_ = fields.view(np.uint8).reshape(8, -1, 8).sum(1, dtype=np.int64)  # by bit of a byte, and byte
    return bytes_.T.ravel()[1 : UNIVERSE + 1]


def _longest_way(masks: np.ndarray, start: int, last: np.ndarray, longest: int) -> int:
    """The longest way between hits of a number, at least ``longest``, after the periods from ``start`` on; the ``last`` hit of each number (-1: none) is moved on.

    The leading gap counts its periods, closed gaps their distance. Only numbers that some run of ``longest`` periods
    lacks can go further inside these periods; their hits are looked at one by one. While ``longest`` is short, runs of
    USUAL periods are tried: a number that lacks one goes at least as far as all that lack none.
    """
    size, lacking, whole = max(longest, USUAL), BITS, len(masks) >= EDGE
    if whole:
        runs, width = masks, 1
        while 2 * width <= min(size, len(masks)):
            runs, width = runs[:-width] | runs[width:], 2 * width
        runs = runs[: max(0, len(runs) - size + width)] | runs[size - width :]
        first, end = masks[:EDGE], masks[-EDGE:]
        found = np.bitwise_and.reduce(runs) & np.bitwise_or.reduce(first) & np.bitwise_or.reduce(end)
        lacking = BITS & ~found
        if not lacking and longest < size:
            lacking = BITS
    number = np.arange(1, UNIVERSE + 1, dtype=np.uint64)
    looked = lacking >> number & np.uint64(1) == 1
    if not looked.all():
        hit = lambda x: np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, 1 : UNIVERSE + 1]
        longest = max(longest, int((start + hit(first).argmax(0) - np.maximum(last, 0))[~looked].max()))
        last[~looked] = (start + len(masks) - 1 - hit(end[::-1].copy()).argmax(0))[~looked]
    for k in np.flatnonzero(looked):
        at = np.flatnonzero(masks & np.uint64(1 << int(k) + 1)) + start
        if len(at):
            longest = max(longest, int(np.diff(at, prepend=max(last[k], 0)).max()))
            last[k] = at[-1]
    return longest


def history_metrics(periods: int, seed: int, replicate: int) -> tuple[float, ...]:
    """Extremes of one fair history of ``periods`` draws, made and measured in chunks of bounded memory."""
    rng = np.random.default_rng([seed, replicate])
    count, last = np.zeros(UNIVERSE, np.int64), np.full(UNIVERSE, -1)
    longest = total = squares = overlaps = most = 0
    before = np.zeros(0, np.uint64)
    for start in range(0, periods, CHUNK):
        packed = np.concatenate([both.take(k) for _, _, both, k in _pairs(rng, min(CHUNK, periods - start))])
        masks, sums = packed & BITS, packed >> SUM_AT
        count += _counts(masks)
        longest = _longest_way(masks, start, last, longest)
        total, squares = total + int(sums.sum()), squares + int((sums * sums).sum())
        both = np.append(before, masks)
        shared = np.bitwise_count(both[1:] & both[:-1])
        overlaps, most, before = overlaps + int(np.count_nonzero(shared >= 2)), max(most, int(shared.max(initial=0))), masks[-1:]
    gap = max(longest, int(np.where(last >= 0, periods - 1 - last, periods).max()))
    sd = np.sqrt(max(0.0, (squares - total * total / periods) / max(1, periods - 1)))
    return float(np.abs(count - periods * P0).max()), float(gap), total / periods, float(sd), overlaps / max(1, periods), float(most)


def simulate(spark: SparkSession, periods: int, replicates: int, seed: int = 41, done: DataFrame | None = None) -> DataFrame:
    """(replicate, the metrics) of fair histories; replicates that ``done`` has are not made again."""
    ids = spark.range(replicates).withColumnRenamed("id", "replicate")
    if done is not None:
        ids = ids.join(done.select("replicate"), "replicate", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(int(r), *history_metrics(periods, seed, int(r))) for r in f["replicate"]], columns=["replicate", *METRICS])

    return ids.repartition(max(1, min(replicates, 256))).mapInPandas(run, "replicate long, " + ", ".join(f"{m} double" for m in METRICS))


def empirical(observed: DataFrame, simulated: DataFrame) -> DataFrame:
    """(metric, observed, mean, sd, q025, q975, p): extremes by their right tail, sums by distance from the median; plus-one p-values."""
    stack = "stack({}, {}) as (metric, value)".format(len(METRICS), ", ".join(f"'{m}', cast({m} as double)" for m in METRICS))
    s, o = simulated.selectExpr(stack), observed.selectExpr(stack).withColumnRenamed("value", "observed")
    q = s.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.percentile("value", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    j = s.join(F.broadcast(o.join(q, "metric")), "metric")  # a row for each metric
    two = F.col("metric").isin("mean_sum", "sum_std")
    extreme = F.when(two, F.abs(F.col("value") - F.col("q")[1]) >= F.abs(F.col("observed") - F.col("q")[1])).otherwise(F.col("value") >= F.col("observed"))
    out = j.groupBy("metric", "observed", "mean", "sd", "q").agg(((F.sum(extreme.cast("int")) + 1) / (F.count("*") + 1)).alias("p"))
    return out.select("metric", "observed", "mean", "sd", F.col("q")[0].alias("q025"), F.col("q")[2].alias("q975"), "p")


def bootstrap(values: DataFrame, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """(group, mean, low, high): percentile intervals of group means from (group, value, count).

    A replicate's counts of the distinct values are one multinomial draw, so no replicate touches the rows: groups come
    as counts of their distinct values.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        n, v = pdf["count"].to_numpy(), pdf["value"].to_numpy(float)
        rng = np.random.default_rng([seed, *pdf["group"].iloc[0].encode()])
        means = rng.multinomial(n.sum(), n / n.sum(), replicates) @ v / n.sum()
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame([(pdf["group"].iloc[0], float(n @ v / n.sum()), low, high)], columns=["group", "mean", "low", "high"])

    return values.groupBy("group").applyInPandas(run, "group string, mean double, low double, high double")


#: Positions of a series whose blocks one task sums.
SPAN = 4_096


def block_sums(values: DataFrame, block: int, rest: int) -> DataFrame:
    """(start, whole, cut): sums of the ``block`` and of the ``rest`` values from each position on, where a whole block follows.

    The series is dealt out by ranges of positions; the first values of a range go to the range before it as well.
    """
    own = F.floor(F.col("position") / SPAN)
    ranges = F.explode(F.when(F.col("position") % SPAN < block - 1, F.array(own, own - 1)).otherwise(F.array(own))).alias("range")
    w = Window.partitionBy("range").orderBy("position")
    after = w.rowsBetween(0, block - 1)
    cut = F.sum("value").over(w.rowsBetween(0, rest - 1)) if rest else F.lit(0.0)
    sums = values.select("position", F.col("value").cast("double").alias("value"), ranges).select("position", "range", F.sum("value").over(after).alias("whole"), cut.alias("cut"), F.count("*").over(after).alias("n"))
    return sums.where((own == F.col("range")) & (F.col("n") == block)).select(F.col("position").alias("start"), "whole", "cut")


def block_bootstrap(values: DataFrame, replicates: int = 1000, block: int = 20) -> DataFrame:
    """(n, mean, low, high): a percentile interval of the mean of (position from 0 without a gap, value), by moving blocks.

    A replicate is as long as the series, of blocks at random starts, the last one cut. A start is the hash of replicate
    and place, so that it does not depend on partitions. A series shorter than a block gives no row.
    """
    n = values.count()
    if n < block:
        return values.sparkSession.createDataFrame([], "n long, mean double, low double, high double")
    places = -(-n // block)
    j = F.col("id") % places
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("replicate").cast("string"), j.cast("string"))), 1, 15), 16, 10).cast("long")
    starts = values.sparkSession.range(replicates * places).withColumn("replicate", F.floor(F.col("id") / places)).select("replicate", (j == places - 1).alias("last"), (hashed % (n - block + 1)).alias("start"))
    rest = n % block
    part = F.when(F.col("last") & F.lit(rest > 0), F.col("cut")).otherwise(F.col("whole"))
    means = starts.join(block_sums(values, block, rest), "start").groupBy("replicate").agg((F.sum(part) / n).alias("m"))
    q = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return values.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).crossJoin(q).select("n", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))  # one row each
