"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from panelwright.llm._store import forget, stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b long): component is the smallest node that it reaches.

    Alternating star contraction: each node hands its larger neighbours, then its smaller ones, to the smallest node it
    sees, until no edge changes; the rounds grow with the logarithm of the longest path. Every round is written to the
    shared folder. An empty table gives an empty one; loops and repeated edges do no harm.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        """``df`` written, with its number of edges and two sums that tell whether they changed."""
        seen = Observation()
        marks = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "m") % 1_000_003).alias("x"), F.sum(F.xxhash64("m", "v") % 999_983).alias("y")]
        out = stored(df.observe(seen, *marks), name)
        return out, tuple(seen.get[c] for c in ("n", "x", "y"))

    now, seen = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    while seen[0]:
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).union(now.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("v"), "m").distinct()
        least = large.groupBy("v").agg(F.min("m").alias("to"))
        small = large.join(least, "v").select(F.col("m").alias("v"), F.col("to").alias("m")).union(least.select("v", F.col("to").alias("m")))
        last = seen
        nxt, seen = kept(small.where("v <> m").distinct())
        forget(spark, now)
        now = nxt
        if seen == last:
            break
    nodes = now.select(F.col("v").alias("node"), F.col("m").alias("component"))
    return nodes.union(now.select(F.col("m").alias("node"), F.col("m").alias("component"))).distinct()
