"""A hash-chained event ledger: canonical records, verification, and what is read from it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START_HASH = "0" * 64


def canonical(record: dict) -> bytes:
    """Sorted keys, no spaces, no NaN, UTF-8."""
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def record_hash(event_id: int, ledger: int, sequence: int, body: str, previous: str) -> str:
    return hashlib.sha256(canonical({"body": body, "event_id": event_id, "ledger": ledger, "previous_record_hash": previous, "sequence": sequence})).hexdigest()


CHAIN = "ledger long, sequence long, event_id long, body string, previous_record_hash string, record_hash string"


def chain(events: DataFrame) -> DataFrame:
    """A chain for each ledger of (ledger, event_id, body), by event_id; events without a ledger are in none.

    The order is total, so a ledger stays in one task; its events come sorted in batches, and only the last hash is carried.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ledger, place, before = None, 0, START_HASH
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.ledger != ledger:
                    ledger, place, before = r.ledger, 0, START_HASH
                place += 1
                own = record_hash(int(r.event_id), int(ledger), place, r.body, before)
                rows.append((int(ledger), place, int(r.event_id), r.body, before, own))
                before = own
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHAIN.split(", ")])

    ordered = events.select("ledger", "event_id", "body").where("ledger is not null").repartition("ledger").sortWithinPartitions("ledger", "event_id")
    return ordered.mapInPandas(run, CHAIN)


def verify(ledger: DataFrame) -> DataFrame:
    """(ledger, records, bad_sequence, bad_link, bad_hash, repeated_event): faults of each ledger; all 0 in a sound one.

    Links are compared with the record before by a window; a record's own hash is made again in Arrow batches.
    """
    w = Window.partitionBy("ledger").orderBy("sequence")

    @F.pandas_udf("string")
    def again(event_id: pd.Series, ledger_: pd.Series, sequence: pd.Series, body: pd.Series, previous: pd.Series) -> pd.Series:
        return pd.Series([record_hash(int(a), int(b), int(c), d, e) for a, b, c, d, e in zip(event_id, ledger_, sequence, body, previous, strict=True)])

    bad = lambda c: F.sum(c.cast("int")).alias
    r = ledger.withColumn("place", F.row_number().over(w)).withColumn("before", F.coalesce(F.lag("record_hash").over(w), F.lit(START_HASH))).withColumn("again", again("event_id", "ledger", "sequence", "body", "previous_record_hash"))
    return r.groupBy("ledger").agg(F.count("*").alias("records"), bad(F.col("sequence") != F.col("place"))("bad_sequence"), bad(F.col("before") != F.col("previous_record_hash"))("bad_link"), bad(F.col("again") != F.col("record_hash"))("bad_hash"), (F.count("*") - F.countDistinct("event_id")).alias("repeated_event"))


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last event of each key: one aggregation, partial before the shuffle."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("e")).select(key, *[F.col(f"e.{c}").alias(c) for c in rest])
