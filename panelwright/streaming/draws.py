"""Draws as a stream: state of each number, and the latest event of each key."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from panelwright.operators.ledger import latest
from panelwright.sources.draws import P0

ALPHA = 0.06
STATE = "next long, count long, last_seen long, max_gap long, ewma double"
OUT = "number int, " + STATE + ", late long"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Moves a number's state over the new periods in their order; periods at or before the last one are counted as late."""
    at, count, last, longest, ewma = state.get if state.exists else (0, 0, -1, 0, P0)
    late = 0
    rows = pd.concat(list(frames)).sort_values("draw_index")
    for t, y in zip(rows["draw_index"].tolist(), rows["y"].tolist(), strict=True):
        if t < at:
            late += 1
            continue
        if y:
            longest, count, last = max(longest, t - last if last >= 0 else t), count + 1, t
        ewma = ALPHA * y + (1 - ALPHA) * ewma
        at = t + 1
    state.update((at, count, last, longest, ewma))
    yield pd.DataFrame([(key[0], at, count, last, longest, ewma, late)], columns=[c.split()[0] for c in OUT.split(", ")])


def number_state(panel: DataFrame) -> DataFrame:
    """(number, state, late) after each batch of a streaming panel (draw_index, number, y): 49 keys, a few numbers each.

    Periods have to arrive in order from batch to batch; late ones change nothing and are reported.
    """
    return panel.groupBy("number").applyInPandasWithState(_advance, OUT, STATE, "update", "NoTimeout")


def keep_latest(events: DataFrame, key: str, order: str, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over all that a stream has now; each batch's latest events go to a folder of their own, so a repeated batch overwrites itself.

    Read the result with ``latest(spark.read.parquet(path + "/*"), key, order)``.
    """

    def write(batch: DataFrame, number: Any) -> None:
        latest(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch-{number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(draws: DataFrame) -> DataFrame:
    """Running counts of numbers over a stream of draws: a plain streaming aggregation."""
    return draws.select(F.explode("numbers").alias("number")).groupBy("number").count()
