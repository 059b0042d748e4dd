"""Ledgers as text: one canonical JSON object a line."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators.ledger import canonical


def _fault(line: str | None) -> str | None:
    if line is None or not line.strip():
        return "blank"
    try:
        record = json.loads(line)
    except ValueError:
        return "not_json"
    if not isinstance(record, dict):
        return "not_object"
    try:
        return None if canonical(record) == line.encode() else "not_canonical"
    except ValueError:  # NaN or infinity
        return "not_canonical"


def line_fault(line: Column) -> Column:
    """blank, not_json, not_object or not_canonical; null for a canonical record."""
    return F.pandas_udf(lambda s: pd.Series([_fault(x) for x in s], dtype="object"), "string")(line)


def read_ledger(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Records of a ledger's text files by ``schema``. Strict: a faulty line fails the read; else it is a row of nulls with its ``fault``."""
    lines = spark.read.text(path).withColumn("fault", line_fault(F.col("value")))
    if strict:  # a condition, so that no later choice of columns leaves it out
        said = F.raise_error(F.concat(F.lit("ledger line is "), "fault", F.lit(": "), F.coalesce("value", F.lit("")))).cast("boolean")
        lines = lines.where(F.when(F.col("fault").isNull(), True).otherwise(said))
    record = F.when(F.col("fault").isNull(), F.from_json("value", schema)).alias("r")
    out = lines.select(record, "fault").select("r.*", "fault")
    return out.drop("fault") if strict else out
