"""A logistic model of each number that moves with every period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.features import Packed
from panelwright.operators.fits import FEATURES, _cells
from panelwright.sources.draws import P0, UNIVERSE

#: Numbers that move together in a task.
TOGETHER = 7


def online(panel: DataFrame, rate: float = 0.05, shrink: float = 0.1) -> DataFrame:
    """(number, n, brier, log_loss): a logistic model for each number, scored on each period and then moved by it.

    A number's periods come sorted in batches; its weights and sums are carried from one batch to the next.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, t, b, brier, loss = None, 0, 0.0, 0.0, 0.0
        w = np.zeros(len(FEATURES))
        said = lambda: pd.DataFrame([(number, t, brier / t, loss / t)], columns=["number", "n", "brier", "log_loss"])
        for pdf in frames:
            for n, x, y in zip(pdf["number"].to_numpy(), pdf[list(FEATURES)].to_numpy(float), pdf["y"].to_numpy(float), strict=True):
                if n != number:
                    if number is not None:
                        yield said()
                    number, t, b, brier, loss = int(n), 0, float(np.log(P0 / (1 - P0))), 0.0, 0.0
                    w = np.zeros(len(FEATURES))
                p = 1 / (1 + np.exp(-(x @ w + b)))
                q = (1 - shrink) * p + shrink * P0
                brier += (q - y) ** 2
                loss -= np.log(q if y else 1 - q)
                step = rate / np.sqrt(1 + t) * (p - y)
                w = w - step * x
                b -= step
                t += 1
        if number is not None:
            yield said()

    ordered = panel.select("draw_index", "number", "y", *FEATURES).repartition("number").sortWithinPartitions("number", "draw_index")
    return ordered.mapInPandas(run, "number int, n long, brier double, log_loss double")


def online_blocks(blocks: Packed, rate: float = 0.05, shrink: float = 0.1) -> DataFrame:
    """``online`` from packed blocks: each task has some of the numbers and all blocks in their order.

    A block's features are made where they are used, so that what is dealt out and sorted is 20 KB a block for each of
    seven tasks, and no row of the panel. Weights, and a block's cells, are all that a task holds.
    """
    cells = _cells(blocks, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, w, t, brier, loss = None, np.zeros(0), 0, np.zeros(0), np.zeros(0)

        def said() -> pa.RecordBatch:
            number = np.arange(group * TOGETHER, group * TOGETHER + len(w)) + 1
            return pa.record_batch([pa.array(number.astype(np.int32)), pa.array(np.full(len(w), t)), pa.array(brier / t), pa.array(loss / t)], ["number", "n", "brier", "log_loss"])

        for b in batches:
            for row in range(b.num_rows):
                now = b.column("group")[row].as_py()
                for _, _, x, y in cells([b.slice(row, 1)]):
                    own = slice(now * TOGETHER, (now + 1) * TOGETHER)
                    x, y = np.ascontiguousarray(x[own].transpose(1, 0, 2)), np.ascontiguousarray(y[own].T)
                    if now != group:
                        if group is not None:
                            yield said()
                        group, t, brier, loss = now, 0, np.zeros(y.shape[1]), np.zeros(y.shape[1])
                        w = np.zeros(x.shape[1:])
                        w[:, 0] = np.log(P0 / (1 - P0))
                    steps, p = rate / np.sqrt(1.0 + t + np.arange(len(x))), np.empty(y.shape)
                    part, z = np.empty(w.shape), np.empty(len(w))
                    wide = z[:, None]
                    for seen, hit, chance, step in zip(x, y, p, steps.tolist(), strict=True):  # in place, as calls cost more than seven numbers do
                        np.multiply(seen, w, part)
                        np.add.reduce(part, 1, None, z)
                        np.negative(z, z)
                        np.exp(z, z)
                        z += 1
                        np.divide(1, z, chance)
                        np.subtract(chance, hit, z)
                        z *= step
                        np.multiply(seen, wide, part)
                        w -= part
                    q = (1 - shrink) * p + shrink * P0
                    brier, loss, t = brier + ((q - y) ** 2).sum(0), loss - np.log(np.where(y == 1, q, 1 - q)).sum(0), t + len(x)
        if group is not None:
            yield said()

    groups = -(-UNIVERSE // TOGETHER)
    dealt = blocks.table.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartitionById(groups, F.col("group"))
    return dealt.sortWithinPartitions("group", "block").mapInArrow(run, "number int, n long, brier double, log_loss double")
