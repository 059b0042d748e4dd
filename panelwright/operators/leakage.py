"""Guards against looking ahead: assertions on a history, and features compared under a changed future."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.features import Known, by_block_twice, since
from panelwright.sources.draws import PICK, lowest, subset


def assert_before(draws: DataFrame, draw_id: str, draw_date: str, least: int) -> None:
    """Raises ValueError where ``draws`` (draw_id, draw_date) reach into the target: its id, its date or a later one, or fewer than ``least`` periods."""
    found = draws.agg(F.count("*").alias("n"), F.bool_or(F.col("draw_id") == draw_id).alias("same"), F.bool_or(F.col("draw_date") >= F.lit(draw_date).cast("date")).alias("late"), F.bool_or(F.col("draw_date").isNull()).alias("undated")).first()
    for bad, why in ((found["same"], "the target is among its history"), (found["late"] or found["undated"], "history does not lie before the target"), (found["n"] < least, f"{found['n']} periods, {least} are needed")):
        if bad:
            raise ValueError(why)


#: A period's key in the changed history: its number times the first, plus the second.
_KEY = (2_654_435, 97)


def changed_from(draws: DataFrame, cut: int) -> DataFrame:
    """``draws`` with other numbers from period ``cut`` on: each period's are drawn anew from its key, so that two runs agree."""
    other = subset(F.col("draw_index") * _KEY[0] + _KEY[1], PICK)
    return draws.withColumn("numbers", F.when(F.col("draw_index") >= cut, F.sort_array(other)).otherwise(F.col("numbers")))


def changed_periods(periods: pa.Table, cut: int) -> pa.Table:
    """``changed_from`` of some periods (draw_index, bits of their numbers) in a task."""
    at = periods["draw_index"].to_numpy()
    other = (np.int64(1) << lowest(at * _KEY[0] + _KEY[1], PICK).astype(np.int64)).sum(1)
    return periods.set_column(periods.column_names.index("bits"), "bits", pa.array(np.where(at >= cut, other, periods["bits"].to_numpy())))


def digest(*columns: Column) -> tuple[Column, Column]:
    """A row's two hashes; summed over rows they tell whether two sets of rows agree, in whatever order."""
    return F.xxhash64(*columns) % 1_000_000_007, F.xxhash64(F.lit(1), *columns) % 998_244_353


def period_digests(frame: DataFrame, digits: int = 9) -> DataFrame:
    """(draw_index, n, a, b): an order-free digest of all columns of each period's rows, doubles rounded."""
    cols = [F.round(c, digits) + 0.0 if t == "double" else F.col(c) for c, t in sorted(frame.dtypes)]
    a, b = digest(*cols)
    return frame.groupBy("draw_index").agg(F.count("*").alias("n"), F.sum(a).alias("a"), F.sum(b).alias("b"))


def leaks(build: Callable[[DataFrame], DataFrame], draws: DataFrame, cut: int, labels: tuple[str, ...] = ("y",)) -> DataFrame:
    """(draw_index, leaked) for the periods up to ``cut``: whether ``build``'s rows of a period change with numbers from ``cut`` on.

    ``build`` makes features with a draw_index; ``labels``, which are what happens, are left out. Periods that only one
    of the two runs has count as leaked.
    """
    sides = []
    for d in (draws, changed_from(draws, cut)):
        made = build(d).where(F.col("draw_index") <= cut)
        sides.append(period_digests(made.drop(*labels)))
    before, after = sides
    same = F.col("x.n").eqNullSafe(F.col("y.n")) & F.col("x.a").eqNullSafe(F.col("y.a")) & F.col("x.b").eqNullSafe(F.col("y.b"))
    both = before.alias("x").join(after.alias("y"), F.col("x.draw_index") == F.col("y.draw_index"), "full")
    return both.select(F.coalesce("x.draw_index", "y.draw_index").alias("draw_index"), (~same).alias("leaked"))


def checklist(draws: DataFrame, builds: dict[str, Callable[[DataFrame], DataFrame]], cut: int) -> DataFrame:
    """(item, periods, leaked, status): each feature set held against a changed future."""
    out = None
    for name, build in builds.items():
        row = leaks(build, draws, cut).agg(F.lit(name).alias("item"), F.count("*").alias("periods"), F.sum(F.col("leaked").cast("long")).alias("leaked"))
        out = row if out is None else out.union(row)
    return _status(out)


@dataclass(frozen=True)
class InBlock:
    """A feature set made inside blocks: what ``of`` makes of what is known, matrices of periods by numbers, from period ``start`` on."""

    of: Callable[[Known], dict[str, np.ndarray]]
    alpha: float
    widths: tuple[int, ...]
    start: int = 0


def _status(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", F.when(F.col("leaked") == 0, "PASS").otherwise("FAIL"))


def block_checklist(draws: DataFrame, builds: dict[str, InBlock], cut: int, digits: int = 9) -> DataFrame:
    """``checklist`` of feature sets that are made inside blocks: both histories' features of a period meet where they are made, and a row for each block and set comes out."""
    kinds = tuple(dict.fromkeys((b.alpha, b.widths) for b in builds.values()))
    same = lambda a, b: np.round(a, digits) == np.round(b, digits) if np.asarray(a).dtype.kind == "f" else a == b

    def make(known: list[tuple[Known, Known]]) -> pa.Table:
        rows = []
        for name, build in builds.items():
            one, two = (since(k, build.start) for k in known[kinds.index((build.alpha, build.widths))])
            keep = one["draw_index"][:, 0] <= cut
            a, b = build.of(one), build.of(two)
            apart = np.zeros(one["y"].shape, bool)
            for c in a:
                apart |= ~same(a[c], b[c])
            rows.append((name, int(keep.sum()), int(apart[keep].any(1).sum())))
        return pa.table([pa.array(x) for x in zip(*rows, strict=True)], ["item", "periods", "leaked"])

    parts = by_block_twice(draws, lambda p: changed_periods(p, cut), make, "item string, periods long, leaked long", kinds, cut)
    return _status(parts.groupBy("item").agg(F.sum("periods").alias("periods"), F.sum("leaked").alias("leaked")))
