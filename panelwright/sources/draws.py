"""Draw tables: numbered periods, each with a sorted subset of the universe."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNIVERSE, PICK = 49, 6
P0 = PICK / UNIVERSE

DRAW_SCHEMA = (
    "draw_id string, draw_date date, number_1 int, number_2 int, number_3 int, number_4 int, number_5 int, number_6 int, "
    "special_number int, sales_amount double, sales_count double, total_prize double, jackpot double, "
    "winner_count_by_tier string, prize_by_tier string, source string, source_version string"
)


def place_among(edges: Sequence[float], key: Column) -> Column:
    """How many of the sorted ``edges`` lie below ``key``: a binary search in one array literal, however many edges there are."""
    depth = len(edges).bit_length()
    padded = [*map(repr, edges), *["Infinity"] * ((1 << depth) - 1 - len(edges))]
    table = F.split(F.lit(",".join(padded)), ",").cast("array<double>")  # of constants alone: Spark makes it a literal
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(depth))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) < key, at + step).otherwise(at))


def numbered(df: DataFrame, key: str, name: str = "draw_index", ranges: int | None = None) -> DataFrame:
    """``df`` with consecutive numbers from 0 in the order of the numeric, unique ``key``.

    Rows are dealt out by ranges of the key, numbered inside each range, and moved by the size of the ranges before. The
    ranges' edges are fixed before the plan is built, by one pass of sketches over the key, and their sizes by a second; these
    are added up and looked up in one array literal, so that no join is due. There are as many ranges as shuffle partitions, or ``ranges``.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = sorted(set(df.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    df = df.withColumn("_range", place_among(edges, F.col(key)) if edges else F.lit(0))
    sizes = dict(df.groupBy("_range").count().collect())  # a row for each range
    before = accumulate((sizes.get(i, 0) for i in range(len(edges))), initial=0)
    offsets = F.split(F.lit(",".join(map(str, before))), ",").cast("array<long>")  # of constants alone, as the edges are
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key)).cast("long") - 1
    # an exchange of a stated number of partitions: small rows stay spread over all cores, as much is made of each
    dealt = df.repartitionById(ranges, F.col("_range")).withColumn("_inside", inside)
    return dealt.withColumn(name, F.col("_inside") + F.get(offsets, F.col("_range"))).drop("_range", "_inside")


def lowest(key: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` numbers whose hashes with each key are the smallest, smallest first; a row for each key."""
    n = np.arange(1, UNIVERSE + 1)
    # the first factor is reduced before the product, which would pass 64 bits for keys from about 10 ** 11
    hashed = np.fmod(np.fmod(key[:, None] * 7919 + n * 104729, 1000003) * (n * 31 + np.fmod(key, 1009)[:, None] + 17), 1000003)
    # a hash and its number make one integer, so that plain integers are sorted
    ranked = np.sort(np.partition(hashed * 64 + n, size - 1, 1)[:, :size], 1)
    return ranked % 64


def subset(key: Column, size: int) -> Column:
    """The ``size`` numbers of the universe that a key's hash puts first, smallest hash first."""

    def run(keys: pa.Array) -> pa.Array:
        sets = lowest(pc.fill_null(keys, 0).to_numpy(zero_copy_only=False), size)
        out = pa.FixedSizeListArray.from_arrays(pa.array(sets.ravel().astype(np.int32)), size).cast(pa.list_(pa.int32()))
        return pc.if_else(keys.is_valid(), out, pa.scalar(None, out.type)) if keys.null_count else out

    run.__annotations__ = {"keys": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<int>")(key.cast("long"))


def derived_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(draw_index, draw_id, draw_date, order_year, numbers, special_number): a draw for every order, derived by arithmetic.

    The numbers come sorted; the special number is the one that ranks next. No shuffle but for the numbering; hashes are
    made by a batch of orders at a time, as 49 written-out or interpreted hashes a row are slow in Spark.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderstatus")
    d = numbered(orders, "o_orderkey").withColumn("seven", subset(F.col("o_orderkey"), PICK + 1))
    return d.select(
        "draw_index",
        F.lpad(F.col("draw_index").cast("string"), 9, "0").alias("draw_id"),
        F.date_add(F.lit("2007-01-02").cast("date"), (F.col("draw_index") % 7000 * 3).cast("int")).alias("draw_date"),
        F.col("o_orderkey").alias("key"),
        F.sort_array(F.slice("seven", 1, PICK)).alias("numbers"),
        F.element_at("seven", PICK + 1).alias("special_number"),
    )


def wide(draws: DataFrame) -> DataFrame:
    """``numbers`` as columns number_1 .. number_6."""
    return draws.select("*", *[F.col("numbers")[i].alias(f"number_{i + 1}") for i in range(PICK)]).drop("numbers")


def load_csv(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The processed table: lenient sorts by (date, id); strict fails on malformed rows and keeps the order."""
    read = spark.read.schema(DRAW_SCHEMA).option("header", True).option("dateFormat", "yyyy-MM-dd")
    if strict:
        return read.option("mode", "FAILFAST").csv(path)
    return read.csv(path).orderBy("draw_date", "draw_id")
