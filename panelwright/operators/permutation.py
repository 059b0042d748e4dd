"""Permutation tests that keep a period's numbers together: outcomes change places, sets of numbers stay.

A period's outcome, and each set of numbers that is held against it, is a mask of 49 bits, so that hits are bits of two
masks in common. Outcomes change places within blocks of periods, by maps i -> a i + b modulo the block's length with a
prime a: bijections that a task computes without a sort, and that form a group with the identity, as an exact test needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Periods in a block; multipliers are the primes from here up to four times as much, none of which divides a length.
BLOCK = 2048
MULTIPLIERS = [p for p in range(BLOCK + 1, 4 * BLOCK) if all(p % q for q in range(2, int(p**0.5) + 1))]


def mask(numbers: Column) -> Column:
    """An array of numbers from 1 to 49 as bits of a long."""
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, n: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))))


#: Counts of at most 49 whose sum a byte holds.
_BYTE = 5


def _block_hits(outcome: np.ndarray, masks: np.ndarray, block: int, powers: np.ndarray, replicates: int) -> np.ndarray:
    """Hits of each mask over one block, outcomes as they are and permuted; ``powers`` has i -> a i by multiplier."""
    n, models = masks.shape
    out = np.empty((replicates + 1, models), np.int64)
    width = -(-n // (8 * _BYTE)) * 8 * _BYTE
    sets = np.zeros((models, width), np.uint64)
    sets[:, :n] = masks.T
    twice, moved, common, bits = np.append(outcome, outcome), np.zeros(width, np.uint64), np.empty_like(sets), np.empty(sets.shape, np.uint8)
    # eight counts to a word: words are added up first, then their bytes
    words = bits.view(np.uint64).reshape(models, _BYTE, -1)
    for r in range(replicates + 1):
        if r:
            shift = (r * 7919 + block * 104_729) % n
            np.take(twice[shift : shift + n], powers[(r * 31 + block) % len(powers)], out=moved[:n], mode="clip")
        else:
            moved[:n] = outcome
        np.bitwise_count(np.bitwise_and(sets, moved, out=common), out=bits)
        out[r] = words.sum(1).view(np.uint8).sum(1, dtype=np.int64)
    return out


def permuted_hits(rows: DataFrame, replicates: int) -> DataFrame:
    """(replicate, k, hits) of rows (place, outcome, masks): hits of the k-th mask over all periods, outcomes permuted; replicate 0 is as it was.

    ``place`` counts the periods from 0 without a gap. A block is one row of at most BLOCK periods; a task adds its
    blocks' hits up, so that replicates times masks rows leave it.
    """
    block = F.floor(F.col("place") / BLOCK).alias("block")
    blocks = rows.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("place", "outcome", "masks"))).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, powers = None, {}
        for b in batches:
            for at, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                outcome = np.asarray(v.values.field("outcome")).astype(np.uint64)
                n = len(outcome)
                masks = np.asarray(v.values.field("masks").flatten()).astype(np.uint64).reshape(n, -1)
                total = np.zeros((replicates + 1, masks.shape[1]), np.int64) if total is None else total
                if n not in powers:  # of two lengths at most: whole blocks', and the last one's
                    powers[n] = np.outer(MULTIPLIERS, np.arange(n)) % n
                total += _block_hits(outcome, masks, at, powers[n], replicates)
        if total is not None:
            r, k = np.indices(total.shape)
            yield pa.record_batch([pa.array(r.ravel()), pa.array(k.ravel()), pa.array(total.ravel())], ["replicate", "k", "hits"])

    return blocks.mapInArrow(run, "replicate long, k long, hits long").groupBy("replicate", "k").agg(F.sum("hits").alias("hits"))


def plus_one(exceeds: Column) -> Column:
    """(1 + replicates that reach the observed value) over (1 + replicates), of rows whose replicate 0 is the observed one."""
    return (1 + F.sum((exceeds & (F.col("replicate") > 0)).cast("long"))) / F.count("*")


def rank_correlations(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """(replicate, rho): rank correlation of bins' places and hit rates of (replicate, k, hits), with (k, n) cells in each bin; equal rates share their mean rank."""
    rates = hits.join(F.broadcast(sizes), "k").withColumn("rate", F.round(F.col("hits") / F.col("n"), 12))  # a row for each bin
    own = Window.partitionBy("replicate")
    rank = F.rank().over(own.orderBy("rate")) + (F.count("*").over(Window.partitionBy("replicate", "rate")) - 1) / 2
    return rates.withColumn("r", rank).groupBy("replicate").agg(F.corr(F.col("k").cast("double"), "r").alias("rho"))


def step_down(hits: DataFrame) -> DataFrame:
    """(k, hits, raw_p, family_p) of (replicate, k, hits): plus-one p-values, alone and by the step-down maximum over models.

    Models go by falling observed hits, ties by k. A model's value is held against the greatest of its own and all later
    models' hits in each replicate, and no model's p lies below an earlier one's.
    """
    seen = hits.where("replicate = 0").select("k", F.col("hits").alias("observed"))
    place = F.row_number().over(Window.orderBy(F.desc("observed"), "k"))  # a row for each model
    both = hits.join(F.broadcast(seen.withColumn("place", place)), "k")
    later = Window.partitionBy("replicate").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("most", F.max("hits").over(later)).groupBy("k", "place", "observed").agg(plus_one(F.col("hits") >= F.col("observed")).alias("raw_p"), plus_one(F.col("most") >= F.col("observed")).alias("step"))
    return found.select("k", F.col("observed").alias("hits"), "raw_p", F.max("step").over(Window.orderBy("place")).alias("family_p"))
