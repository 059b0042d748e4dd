"""What recorded events and payloads say: results and corrections, predictions, anchors, stages, protocol faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.sources.draws import PICK, UNIVERSE


def result_events(events: DataFrame, keys: list[str], order: str, body: str) -> DataFrame:
    """``events`` with kind: a key's first is its result, one with another body than that before a correction, else repeated.

    A repeated body leaves the state as it was, so the event before says as much as the last accepted one.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    kind = F.when(F.row_number().over(w) == 1, "result").when(F.col(body).eqNullSafe(F.lag(body).over(w)), "repeated").otherwise("correction")
    return events.withColumn("kind", kind)


def with_prediction(results: DataFrame, predictions: DataFrame, keys: list[str], event: str = "event_id") -> DataFrame:
    """``results`` with lookup (missing, found or ambiguous) and prediction, the one event of its keys, null if there is not exactly one.

    Predictions are counted by keys before they meet the results, so that no pairs arise.
    """
    p = predictions.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(event).alias("_first"))
    lookup = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") == 1, "found").otherwise("ambiguous")
    return results.join(p, keys, "left").withColumn("lookup", lookup).withColumn("prediction", F.when(F.col("_n") == 1, F.col("_first"))).drop("_n", "_first")


def with_anchor(predictions: DataFrame, anchors: DataFrame, keys: list[str], valid: Column, order: str = "event_id") -> DataFrame:
    """``predictions`` with anchor: the last of the ``valid`` anchors with the same keys, or null."""
    last = anchors.where(valid).groupBy(*keys).agg(F.max(order).alias("anchor"))
    return predictions.join(last, keys, "left")


def stages(events: DataFrame, key: str, order: str, size: int = 100) -> DataFrame:
    """(key, stage, n, first, last, complete): each key's events in slices of ``size``; a slice counts once it is full."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    cut = events.withColumn("stage", F.ceil(place / size))
    return cut.groupBy(key, "stage").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"), (F.count("*") == size).alias("complete"))


def protocol(predictions: DataFrame, results: DataFrame, ledger: str, keys: list[str], order: str = "event_id") -> DataFrame:
    """(ledger, repeated_predictions, unpredicted_results, early_results, sound): faults of each ledger against its rules.

    A key is predicted once, has no result without a prediction, and none before it.
    """
    side = lambda df, p, r: df.select(*keys, F.when(F.lit(p), F.col(order)).alias("p"), F.when(F.lit(r), F.col(order)).alias("r"))
    both = side(predictions, True, False).unionByName(side(results, False, True))
    per = both.groupBy(*keys).agg(F.count("p").alias("np"), F.count("r").alias("nr"), F.min("p").alias("p"), F.min("r").alias("r"))
    faults = per.groupBy(ledger).agg(
        F.sum(F.greatest(F.col("np") - 1, F.lit(0))).alias("repeated_predictions"),
        F.sum(F.when(F.col("np") == 0, F.col("nr")).otherwise(0)).alias("unpredicted_results"),
        F.sum(F.when(F.col("r") < F.col("p"), 1).otherwise(0)).alias("early_results"),
    )
    return faults.withColumn("sound", F.col("repeated_predictions") + F.col("unpredicted_results") + F.col("early_results") == 0)


def payload_rules(payload: Column, draw_id: Column, draw_date: Column) -> list[tuple[str, Column]]:
    """(fault, condition) in the order in which a JSON payload {status, id, date, numbers} is refused; a null condition refuses too."""
    v = F.try_parse_json(payload)
    at = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    n = at("numbers", "array<int>")
    return [
        ("malformed", v.isNull()),
        ("not_announced", at("status", "string") != "ANNOUNCED"),
        ("other_draw", at("id", "string") != draw_id),
        ("other_date", at("date", "string") != F.date_format(draw_date, "yyyy-MM-dd")),
        ("not_integers", F.schema_of_variant(at("numbers", "variant")) != "ARRAY<BIGINT>"),  # no booleans, fractions or texts
        ("not_seven", F.size(n) != PICK + 1),
        ("out_of_range", F.exists(n, lambda x: (x < 1) | (x > UNIVERSE))),
        ("repeated", F.size(F.array_distinct(n)) != PICK + 1),
    ]


def read_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """``df`` (draw_id, draw_date, payload) with fault, the first rule that refuses the payload, and, where none does, sorted numbers and special_number."""
    fault = F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), name) for name, c in payload_rules(F.col(payload), F.col("draw_id"), F.col("draw_date"))])
    n = F.try_variant_get(F.try_parse_json(F.col(payload)), "$.numbers", "array<int>")
    out = df.withColumn("fault", fault)
    sound = F.col("fault").isNull()
    return out.withColumn("numbers", F.when(sound, F.array_sort(F.slice(n, 1, PICK)))).withColumn("special_number", F.when(sound, F.get(n, F.lit(PICK))))


def compared(expected: DataFrame, actual: DataFrame, keys: list[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """(n, missing, extra, beyond, max_difference) of two tables of values by keys: what a reproduction left out, added or changed."""
    e, a = expected.select(*keys, F.col(value).alias("_e"), F.lit(1).alias("_in_e")), actual.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_in_a"))
    d = F.abs(F.col("_e") - F.col("_a"))
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    both = F.col("_in_e").isNotNull() & F.col("_in_a").isNotNull()
    beyond = both & (F.col("_e").isNull() != F.col("_a").isNull()) | F.coalesce(d > tolerance, F.lit(False))
    return e.join(a, keys, "full").agg(one(both).alias("n"), one(F.col("_in_a").isNull()).alias("missing"), one(F.col("_in_e").isNull()).alias("extra"), one(beyond).alias("beyond"), F.max(d).alias("max_difference"))
