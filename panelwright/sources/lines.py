"""Text files by numbered lines, whatever their encoding, and the rules of a table of draws line by line."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.sources.draws import PICK, UNIVERSE

#: Names that columns of exports have, and what they are called here.
ALIASES = {
    "遊戲名稱": "game_name", "遊戲": "game_name", "期別": "draw_id", "開獎日期": "draw_date", "銷售總額": "sales_amount", "銷售金額": "sales_amount",
    "銷售注數": "sales_count", "總獎金": "total_prize", "特別號": "special_number",
    "獎號1": "number_1", "獎號2": "number_2", "獎號3": "number_3", "獎號4": "number_4", "獎號5": "number_5", "獎號6": "number_6",
    "號碼1": "number_1", "號碼2": "number_2", "號碼3": "number_3", "號碼4": "number_4", "號碼5": "number_5", "號碼6": "number_6",
}


def canonical(name: str) -> str:
    """A column's name without marks and spaces around it, by its alias."""
    plain = name.replace("﻿", "").strip()
    return ALIASES.get(plain, plain)


def numbered_lines(spark: SparkSession, path: str, legacy: str = "cp950") -> DataFrame:
    """(file, line, value): every line of the text files at ``path``, numbered from 1 within its file.

    Files are split as Spark splits text: lines are numbered inside each split in the order of reading, and moved by the
    sizes of the file's splits before, a row each. A file whose lines are all UTF-8 is read as such; any other is decoded
    as ``legacy``, in batches; a line that neither reads raises an error. A mark at a file's start is dropped.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("turn"), F.col("value").cast("binary").alias("raw"))
    sizes = read.groupBy("file", "start").agg(F.count("*").alias("n"), F.bool_and(F.is_valid_utf8(F.col("raw").cast("string"))).alias("plain"))
    own = Window.partitionBy("file")
    before = F.coalesce(F.sum("n").over(own.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each split
    splits = sizes.select("file", "start", before.alias("before"), F.bool_and("plain").over(own).alias("plain"))
    line = F.row_number().over(Window.partitionBy("file", "start").orderBy("turn")).cast("long")
    rows = read.withColumn("inside", line).join(splits, ["file", "start"]).select("file", (F.col("inside") + F.col("before")).alias("line"), "plain", "raw")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([r.decode(legacy) for r in b.column(2).to_pylist()], pa.string())], ["file", "line", "value"])

    plain = rows.where("plain").select("file", "line", F.col("raw").cast("string").alias("value"))
    other = rows.where("not plain").select("file", "line", "raw").mapInArrow(decode, "file string, line long, value string")
    return plain.union(other).withColumn("value", F.when(F.col("line") == 1, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value")))


def table_of(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """(file, line, ``names`` as text) of lines of comma-separated values, blank ones and each file's first left out; fields that a line lacks are null."""
    fields = F.from_csv(F.col("value"), F.lit(", ".join(f"`{n}` string" for n in names)))
    return lines.where("line > 1 and trim(value) <> ''").select("file", "line", fields.alias("f")).select("file", "line", "f.*")


#: Rules in the order in which a line is held against them.
RULES = ("duplicate_id", "malformed", "not_chronological", "invalid_numbers", "invalid_special")
#: Lines in a range; neighbours are compared inside ranges, whose last lines are handed on.
RANGE = 65_536


def line_faults(rows: DataFrame) -> DataFrame:
    """(file, line, fault) of each row (file, line, draw_id, draw_date, number_1 .. number_6, special_number as text) that a rule refuses, by the first that does.

    duplicate_id: an earlier line has the id. malformed: a date or number that is none. not_chronological: date and id
    not above those of the line before, of those well formed. invalid_numbers: not six different numbers of the universe.
    invalid_special: outside the universe, or among the six.
    """
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    n = F.array(*[number(f"number_{i}") for i in range(1, PICK + 1)])
    day = F.when(F.col("draw_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("try_cast(draw_date as date)"))
    bad = lambda x: (x < 1) | (x > UNIVERSE)
    typed = rows.select("file", "line", "draw_id", F.struct(day.alias("day"), number("draw_id").alias("id")).alias("key"), n.alias("n"), number("special_number").alias("s"), F.floor(F.col("line") / RANGE).alias("range"))
    whole = F.col("key.day").isNotNull() & F.col("key.id").isNotNull() & ~F.exists("n", lambda x: x.isNull()) & F.col("s").isNotNull()
    typed = typed.withColumn("whole", whole).withColumn("good", F.when(whole, F.col("key")))
    inside = Window.partitionBy("file", "range").orderBy("line")
    ends = typed.groupBy("file", "range").agg(F.max_by("key", F.when(F.col("whole"), F.col("line"))).alias("end"))
    past = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select("file", "range", F.last("end", ignorenulls=True).over(past).alias("handed"))  # a row for each range
    first = typed.groupBy("file", "draw_id").agg(F.min("line").alias("first"))
    before = F.last("good", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    held = typed.withColumn("before", before).join(handed, ["file", "range"]).join(first, ["file", "draw_id"], "left").withColumn("last", F.coalesce("before", "handed"))
    fault = (
        F.when(F.col("line") > F.col("first"), RULES[0]).when(~F.col("whole"), RULES[1]).when(F.col("key") <= F.col("last"), RULES[2])
        .when((F.size(F.array_distinct("n")) != PICK) | F.exists("n", bad), RULES[3]).when(bad(F.col("s")) | F.array_contains("n", F.col("s")), RULES[4])
    )
    return held.select("file", "line", fault.alias("fault")).where("fault is not null")


def validate_lines(rows: DataFrame) -> None:
    """Raises ValueError for the first line of ``rows`` that ``line_faults`` finds."""
    if (bad := line_faults(rows).orderBy("file", "line").first()) is not None:
        raise ValueError(f"{bad['file']}, line {bad['line']}: {bad['fault']}")


def import_table(spark: SparkSession, path: str, source: str, version: str, legacy: str = "cp950") -> DataFrame:
    """Cleaned draws of exported CSV files of one layout, whose first lines name the columns by any of their names."""
    from panelwright.operators import validation

    lines = numbered_lines(spark, path, legacy)
    head = lines.where("line = 1").agg(F.min("value").alias("value"), F.countDistinct("value").alias("n")).first()
    if head["n"] != 1:
        raise ValueError(f"{head['n']} different headers: one is needed")
    rows = table_of(lines, [canonical(c) for c in head["value"].split(",")])
    return validation.clean(rows.withColumn("seq", F.struct("file", "line")), source, version).drop("seq")
