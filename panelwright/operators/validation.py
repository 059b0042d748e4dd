"""Cleaning and validation of draw tables (draw_id, draw_date, number_1 .. number_6, special_number, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.sources.draws import PICK, UNIVERSE

NUMBERS = [f"number_{i}" for i in range(1, PICK + 1)]
WARNINGS = ("duplicate_date", "not_sorted", "missing_draw_ids", "special_missing")


def year_prefix(draw_id: Column) -> Column:
    """The first three characters of an id padded to nine; a longer id is not cut."""
    return F.substring(F.when(F.length(draw_id) < 9, F.lpad(draw_id, 9, "0")).otherwise(draw_id), 1, 3)


def rules(df: DataFrame) -> dict[str, Column]:
    """A condition for each issue that one row, or its neighbours by key or order, can have."""
    n = F.array(*NUMBERS)
    bad = lambda x: x.isNull() | (x < 1) | (x > UNIVERSE)
    many = lambda *c: F.count("*").over(Window.partitionBy(*c)) > 1
    return {
        "missing_number": F.exists(n, lambda x: x.isNull()),
        "main_out_of_range": F.exists(n, lambda x: x.isNotNull() & bad(x)),
        "main_repeated": F.size(F.array_distinct(F.array_compact(n))) != PICK,
        "special_out_of_range": F.col("special_number").isNotNull() & bad(F.col("special_number")),
        "special_repeated": F.coalesce(F.array_contains(n, F.col("special_number")), F.lit(False)),
        "special_missing": F.col("special_number").isNull(),
        "invalid_date": F.col("draw_date").isNull(),
        "duplicate_draw_id": many("draw_id"),
        "duplicate_date": F.col("draw_date").isNotNull() & many("draw_date"),
        "duplicate_row": many("draw_id", "draw_date", *NUMBERS),
        "not_ascending": F.exists(F.zip_with(F.slice(n, 2, PICK - 1), F.slice(n, 1, PICK - 1), lambda b, a: b < a), lambda x: x),
    }


def issues(df: DataFrame) -> DataFrame:
    """(code, severity, n_rows, first_row, last_row, row_sum) of every rule that some row breaks; rows are named by ``seq``.

    One pass marks the rows, one aggregation counts by code: no rule collects its rows.
    """
    marks = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in _flagged(rules(df)).items()])))
    flagged = df
    for k, c in rules(df).items():
        flagged = flagged.withColumn(f"rule_{k}", c)
    found = flagged.select("seq", marks.alias("code"))
    found = found.unionByName(_out_of_order(df)).unionByName(missing_ids(df).select(F.col("missing").alias("seq"), F.lit("missing_draw_ids").alias("code")))
    severity = F.when(F.col("code").isin(*WARNINGS), "warning").otherwise("error")
    return found.groupBy("code").agg(F.count("*").alias("n_rows"), F.min("seq").alias("first_row"), F.max("seq").alias("last_row"), F.sum("seq").alias("row_sum")).withColumn("severity", severity)


def _flagged(all_rules: dict[str, Column]) -> dict[str, Column]:
    return {k: F.col(f"rule_{k}") for k in all_rules}


#: Values of ``seq`` in a range; rows are compared inside ranges, whose last rows are handed on.
RANGE = 65_536


def _out_of_order(df: DataFrame) -> DataFrame:
    """Rows whose date lies before that of the row before them in the order of ``seq``, whatever numbers are missing between.

    Neighbours inside a range of ``seq`` meet in a window; a range's first row meets the last of the range before that has
    rows. ``seq`` is unique; rows without a date, or after one, are in order.
    """
    rows = df.select("seq", "draw_date", F.floor(F.col("seq") / RANGE).alias("range"))
    inside = Window.partitionBy("range").orderBy("seq")
    ends = rows.groupBy("range").agg(F.max_by(F.struct("draw_date"), "seq").alias("end"))
    handed = ends.select("range", F.lag("end").over(Window.orderBy("range")).alias("handed"))  # a row for each range
    rows = rows.withColumn("before", F.lag(F.struct("draw_date")).over(inside)).join(handed, "range")
    return rows.where(F.col("draw_date") < F.coalesce("before", "handed")["draw_date"]).select("seq", F.lit("not_sorted").alias("code"))


#: Longest gap whose ids are listed; a longer one raises, as it is an id that went wrong rather than lost draws.
LONGEST_GAP = 1_000_000


def missing_ids(df: DataFrame) -> DataFrame:
    """(prefix, missing): numbers between the least and greatest of each year's ids that no row has.

    Runs of ids are found by joins with their neighbours; only the ends of runs, two for each gap, are put in order.
    """
    ids = df.select(year_prefix(F.col("draw_id")).alias("prefix"), F.expr("try_cast(draw_id as bigint)").alias("id")).where("id is not null").distinct()
    without = lambda step: ids.join(ids.select("prefix", (F.col("id") + step).alias("id")), ["prefix", "id"], "left_anti")
    ends = without(-1).withColumn("ends", F.lit(1)).unionByName(without(1).withColumn("ends", F.lit(0)))
    after = F.lead("id").over(Window.partitionBy("prefix").orderBy("id", "ends"))
    gaps = ends.withColumn("after", after).where("ends = 1 and after is not null")
    said = F.raise_error(F.format_string("ids between %d and %d are missing: too many to list", "id", "after")).cast("array<bigint>")
    listed = F.when(F.col("after") - F.col("id") > LONGEST_GAP, said).otherwise(F.sequence(F.col("id") + 1, F.col("after") - 1))
    return gaps.select("prefix", F.explode(listed).alias("missing"))


#: Order in which a hard validation fails.
PRIORITY = ("missing_number", "main_out_of_range", "main_repeated", "invalid_date", "duplicate_draw_id", "duplicate_date", "duplicate_row", "not_sorted")


def first_failure(df: DataFrame) -> DataFrame:
    """(code, n_rows) of the first rule of PRIORITY that fails, or no row."""
    rank = F.array_position(F.array(*[F.lit(c) for c in PRIORITY]), F.col("code"))
    return issues(df).where(rank > 0).select("code", "n_rows", rank.alias("rank")).orderBy("rank").limit(1).select("code", "n_rows")


def validate(df: DataFrame) -> None:
    """Raises ValueError for the first rule that fails, or for an empty table."""
    if df.isEmpty():
        raise ValueError("no rows")
    if (bad := first_failure(df).first()) is not None:
        raise ValueError(f"{bad['code']}: {bad['n_rows']} rows")


def clean(raw: DataFrame, source: str, version: str, version_column: str | None = None) -> DataFrame:
    """Text columns to the draw schema: ids without ``.0``, dates and numbers coerced, numbers sorted (all null if one is), last row of each (id, date) kept."""
    number = [F.expr(f"try_cast(trim({c}) as int)") for c in NUMBERS]
    n = F.array(*number)
    sorted_ = F.when(F.exists(n, lambda x: x.isNull()), F.array(*[F.lit(None).cast("int")] * PICK)).otherwise(F.array_sort(n))
    typed = raw.select(
        "seq",
        F.regexp_replace(F.trim("draw_id"), r"\.0$", "").alias("draw_id"),
        F.expr("cast(try_to_timestamp(trim(draw_date), 'yyyy/MM/dd') as date)").alias("draw_date"),
        *[sorted_[i].alias(c) for i, c in enumerate(NUMBERS)],
        F.expr("try_cast(trim(special_number) as int)").alias("special_number"),
        F.lit(source).alias("source"),
        (F.col(version_column) if version_column else F.lit(version)).alias("source_version"),
    )
    return keep_last(typed, ["draw_id", "draw_date"], "seq")


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``: an aggregation, so that copies meet before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def conflicts_and_new(existing: DataFrame, arriving: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of new ids, ids whose numbers differ): what an incremental append has to add and to refuse."""
    new = arriving.join(existing, "draw_id", "left_anti")
    other = existing.select("draw_id", F.array(*NUMBERS).alias("known"))
    clash = arriving.join(other, "draw_id").where(~F.array(*NUMBERS).eqNullSafe(F.col("known"))).select("draw_id")
    return new, clash
