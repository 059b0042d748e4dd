"""What a table held when something was registered: digests of multisets of rows, and equality of sets of names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digests are sums modulo 2 ** 60 of two halves of each row's hash.
MODULUS = 1 << 60


def row_text(columns: Sequence[Column]) -> Column:
    """A row as text: fields with their lengths, nulls apart from any text, so that no two rows have the same."""
    field = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.concat_ws("|", *map(field, columns))


def digested(rows: DataFrame, columns: Sequence[Column], *by: str) -> DataFrame:
    """(``by``, n, first, second): the digest of the multiset of rows of each part; repeated rows count, order does not."""
    half = lambda start: F.conv(F.substring(F.md5(row_text(columns).cast("binary")), start, 15), 16, 10).cast("decimal(38,0)")
    total = lambda start: (F.sum(half(start)) % MODULUS).cast("long")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), total(1).alias("first"), total(17).alias("second"))


def merged(digests: DataFrame, *by: str) -> DataFrame:
    """The digest of the parts' rows together: parts are added up and never read again, so an append costs its own rows alone."""
    total = lambda c: (F.sum(F.col(c).cast("decimal(38,0)")) % MODULUS).cast("long").alias(c)
    return digests.groupBy(*by).agg(F.sum("n").alias("n"), total("first"), total("second"))


def unbound(registered: DataFrame, found: DataFrame, *by: str) -> DataFrame:
    """(``by``, state) of the parts whose digests differ: changed, lost or added."""
    x, y = registered.alias("x"), found.alias("y")
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by]
    both = x.join(y, on, "full")
    same = (F.col("x.n") == F.col("y.n")) & (F.col("x.first") == F.col("y.first")) & (F.col("x.second") == F.col("y.second"))
    state = F.when(F.col("y.n").isNull(), "lost").when(F.col("x.n").isNull(), "added").when(~same, "changed")
    return both.select(*[F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in by], state.alias("state")).where("state is not null")


def set_difference(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """(``name``, side) of the names that only one side has; equal sets give no row. Repetitions within a side do not count."""
    one, other = left.select(name).distinct().withColumn("in_left", F.lit(True)), right.select(name).distinct().withColumn("in_right", F.lit(True))
    both = one.join(other, name, "full")
    return both.where("in_left is null or in_right is null").select(name, F.when(F.col("in_left").isNull(), "right").otherwise("left").alias("side"))
