"""Logistic models of the audited features, many fits at once.

All fits take the same Newton steps together. A step is one pass over the rows: a task adds up, for every fit and number,
the gradient and curvature of the rows that train the fit, with matrix products; Spark adds the tasks' sums; what the
driver solves is one small system a fit. Which rows train a fit is a range of an ordinal column, so refits along the
periods, folds, penalties, left-out features and years are all lists of fits.

Rows come as a panel, or from packed blocks of draws (``features.packed``): then a task makes the features of a block
anew in each pass, and no row of the panel is ever written, moved or sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.adjust import projected, projected_rows, shrunk
from panelwright.operators.features import Packed, audited_known, since
from panelwright.sources.draws import P0, UNIVERSE

FEATURES = ("z_gap_asof", "z_ewma", "z_transition_rate", "z_long_rate", "z_rate_20", "z_rate_50", "z_rate_100")
#: Newton steps from the uniform chance; hits depend on features so little that five reach a double's precision.
STEPS = 5
#: Steps end early where the last one moved no coefficient by more: the next would move it by the square of that.
STILL = 1e-9
#: Penalty: the objective is the sum of losses and |w|^2 / (2 C), the intercept left out.
C = 0.2
#: Fits at once, at most: a task holds 49 x 44 sums of each, and the driver their coefficients.
MOST_FITS = 4_096

_WIDTH = len(FEATURES) + 1
_PAIRS = [(i, j) for i in range(_WIDTH) for j in range(i, _WIDTH)]
#: Columns of sums: gradients by coefficient, then curvatures by pair of coefficients.
SUMS = [f"g{i}" for i in range(_WIDTH)] + [f"h{i}_{j}" for i, j in _PAIRS]


@dataclass(frozen=True)
class Fit:
    """A model by name, trained on rows with ``begin <= at < end``; ``drop`` leaves features out, ``number`` adds an effect of each number."""

    name: str
    end: int
    begin: int = 0
    c: float = C
    drop: tuple[str, ...] = ()
    number: bool = True


@dataclass
class Fitted:
    """Coefficients (intercept first) and effects of numbers, a row for each fit, and how far the last step went."""

    fits: list[Fit]
    coef: np.ndarray
    effect: np.ndarray
    moved: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def chances(self, x: np.ndarray, number: np.ndarray, which: np.ndarray) -> np.ndarray:
        z = (x * self.coef[which]).sum(1) + self.effect[which, number - 1]
        return 1 / (1 + np.exp(-z))


def _design(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.column_stack([np.ones(batch.num_rows), *(np.asarray(batch.column(first + i), float) for i in range(_WIDTH - 1))])


def _step(now: Fitted):
    """(fit, number, sums): gradients and curvatures of a partition's rows (at, number, y, features) at ``now``."""
    begin, end = (np.array([getattr(f, k) for f in now.fits]) for k in ("begin", "end"))
    rows, cols = np.array(_PAIRS).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((UNIVERSE, len(now.fits), len(SUMS)))
        for b in batches:
            at, number, y = (np.asarray(b.column(i)) for i in range(3))
            x = _design(b, 3)
            for n in np.unique(number):
                mine = np.flatnonzero(number == n)
                own, t = x[mine], at[mine, None]
                inside = (t >= begin) & (t < end)
                p = 1 / (1 + np.exp(-(own @ now.coef.T + now.effect[:, n - 1])))
                total[n - 1, :, :_WIDTH] += ((y[mine, None] - p) * inside).T @ own
                total[n - 1, :, _WIDTH:] += (p * (1 - p) * inside).T @ (own[:, rows] * own[:, cols])
        yield from _said(total)

    return run


def _said(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums by number, fit and column as rows, of fits that rows train."""
    number, fit = np.nonzero(total[:, :, _WIDTH])  # the curvature of the intercept
    if len(fit):
        found = total[number, fit]
        yield pa.record_batch([pa.array(fit.astype(np.int32)), pa.array(number.astype(np.int32)), *(pa.array(found[:, i].copy()) for i in range(len(SUMS)))], ["fit", "number", *SUMS])


#: Periods, their place among the fits' ranges, features (number, period, coefficient) and hits (number, period) of a block.
Cells = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _cells(blocks: Packed, begin: int, at: str = "draw_index") -> Callable[[Iterator[pa.RecordBatch]], Iterator[Cells]]:
    """For use in tasks: the cells of every block of a partition, from period ``begin`` on."""
    read = blocks.reader()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[Cells]:
        for known in read(batches):
            known = since(known, begin)
            if len(known["y"]):
                known = audited_known(known, FEATURES)
                x = np.empty((UNIVERSE, len(known["y"]), _WIDTH))
                x[:, :, 0] = 1
                for k, c in enumerate(FEATURES, 1):
                    x[:, :, k] = known[c].T
                yield known["draw_index"][:, 0], known[at][:, 0], x, known["y"].T.astype(float)

    return run


#: Fits whose chances a task holds at once, for a block's cells.
_TOGETHER = 32


def _block_step(now: Fitted, cells: Callable[[Iterator[pa.RecordBatch]], Iterator[Cells]]):
    """``_step`` from the cells of blocks: a block is cut where other fits begin or end, so that all rows of a piece train the same fits."""
    begin, end = (np.array([getattr(f, k) for f in now.fits]) for k in ("begin", "end"))
    rows, cols = np.array(_PAIRS).T
    # fits with the same coefficients, such as all in the first step, share their sums
    every, same = np.unique(np.hstack([now.coef, now.effect]), axis=0, return_inverse=True)
    coef, effect, same = every[:, :_WIDTH], every[:, _WIDTH:], same.ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((UNIVERSE, len(now.fits), len(SUMS)))
        for _, at, x, y in cells(batches):
            inside = (at[:, None] >= begin) & (at[:, None] < end)
            cuts = np.flatnonzero((inside[1:] != inside[:-1]).any(1)) + 1
            for low, high in pairwise([0, *cuts.tolist(), len(at)]):
                fits = np.flatnonzero(inside[low])
                if not len(fits):
                    continue
                own, hit = x[:, low:high], y[:, low:high, None]
                distinct = np.unique(same[fits])
                few = len(distinct) < 5
                pairs = None if few else own[..., rows] * own[..., cols]
                for i in range(0, len(distinct), _TOGETHER):
                    some = distinct[i : i + _TOGETHER]
                    p = 1 / (1 + np.exp(-(own @ coef[some].T + effect[some].T[:, None, :])))
                    w = p * (1 - p)
                    if few:
                        h = np.stack([((own * w[:, :, k, None]).transpose(0, 2, 1) @ own)[:, rows, cols] for k in range(len(some))], 1)
                    else:
                        h = w.transpose(0, 2, 1) @ pairs
                    sums = np.concatenate([(hit - p).transpose(0, 2, 1) @ own, h], 2)
                    mine = fits[np.isin(same[fits], some)]
                    total[:, mine] += sums[:, np.searchsorted(some, same[mine])]
        yield from _said(total)

    return run


def _whole(h: np.ndarray) -> np.ndarray:
    """Symmetric matrices of rows of curvatures."""
    out = np.zeros((*h.shape[:-1], _WIDTH, _WIDTH))
    for k, (i, j) in enumerate(_PAIRS):
        out[..., i, j] = out[..., j, i] = h[..., k]
    return out


def _solved(now: Fitted, sums: np.ndarray) -> Fitted:
    """``now`` after one step; sums by fit, number and column. Effects of numbers, whose block is diagonal, are eliminated first."""
    grad, h = sums[:, :, :_WIDTH], _whole(sums[:, :, _WIDTH:])
    penalty = np.array([1 / f.c for f in now.fits])
    used = np.array([[True, *(c not in f.drop for c in FEATURES)] for f in now.fits])
    ridge = np.where(np.arange(_WIDTH) > 0, penalty[:, None], 0.0)
    a = h.sum(1) + np.eye(_WIDTH) * ridge[:, :, None]
    a[:, 0, 0] += a[:, 0, 0] == 0  # no row: the intercept stays
    g = grad.sum(1) - ridge * now.coef
    d, b = h[:, :, 0, 0] + penalty[:, None], h[:, :, 0, :]
    own = grad[:, :, 0] - penalty[:, None] * now.effect
    numbers = np.array([f.number for f in now.fits])[:, None]
    own, b = np.where(numbers, own, 0.0), np.where(numbers[:, :, None], b, 0.0)
    a, g = a - np.einsum("fni,fnj,fn->fij", b, b, 1 / d), g - np.einsum("fni,fn,fn->fi", b, own, 1 / d)
    a = np.where(used[:, :, None] & used[:, None, :], a, np.eye(_WIDTH))
    change = np.linalg.solve(a, np.where(used, g, 0.0)[:, :, None])[:, :, 0]
    effect = (own - np.einsum("fni,fi->fn", b, change)) / d
    return Fitted(now.fits, now.coef + change, now.effect + effect, np.maximum(np.abs(change).max(1), np.abs(effect).max(1)))


def fitted(panel: DataFrame | Packed, fits: Sequence[Fit], at: str = "draw_index", steps: int = STEPS, start: int = 0) -> Fitted:
    """All ``fits`` of ``panel`` (draw_index, number, y, features): each step is one job for all of them.

    Features are used as they are; the audited ones are standardised by period. A fit without rows keeps the uniform
    chance. A panel that is costly to make should be written first (``sinks.tables.stored``), as each step reads it; packed
    blocks are written, and give the audited features of their periods from ``start`` on (``at``: draw_index or year).
    """
    if not 0 < len(fits) <= MOST_FITS:
        raise ValueError(f"1 to {MOST_FITS} fits, not {len(fits)}")
    if bad := [f.name for f in fits if f.c <= 0 or not f.number and set(FEATURES) <= set(f.drop)]:
        raise ValueError(f"fits without a positive c or any feature: {bad}")
    now = Fitted(list(fits), np.zeros((len(fits), _WIDTH)), np.zeros((len(fits), UNIVERSE)))
    now.coef[:, 0] = np.log(P0 / (1 - P0))
    low, high = min(f.begin for f in fits), max(f.end for f in fits)
    if isinstance(panel, Packed):
        rows = panel.between(max(low, start), high) if at == "draw_index" else panel.table
        cells = _cells(panel, start, at)
        step = lambda now: _block_step(now, cells)
    else:
        rows = panel.where((F.col(at) < high) & (F.col(at) >= low))
        rows = rows.select(F.col(at).cast("long").alias("at"), F.col("number").cast("int").alias("number"), F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in FEATURES])
        step = _step
    schema = "fit int, number int, " + ", ".join(f"{c} double" for c in SUMS)
    for _ in range(steps):
        got = rows.mapInArrow(step(now), schema).groupBy("fit", "number").agg(*[F.sum(c).alias(c) for c in SUMS]).toArrow()
        sums = np.zeros((len(fits), UNIVERSE, len(SUMS)))
        sums[np.asarray(got["fit"]), np.asarray(got["number"])] = np.column_stack([np.asarray(got[c]) for c in SUMS])
        now = _solved(now, sums)
        if now.moved.max() < STILL:
            break
    return now


def scored(panel: DataFrame, models: Fitted, blocks: Sequence[tuple[str, str, int, int]]) -> DataFrame:
    """(block, draw_index, number, y, p): rows of ``panel`` with begin <= draw_index < end of each block (name, fit, begin, end), scored by its fit.

    Blocks may overlap: a row is scored once for each. Fits are looked up in a task, no row moves.
    """
    place = {f.name: k for k, f in enumerate(models.fits)}
    names, which = [b[0] for b in blocks], np.array([place[b[1]] for b in blocks])
    begin, end = np.array([b[2] for b in blocks]), np.array([b[3] for b in blocks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, number = np.asarray(b.column(0)), np.asarray(b.column(1))
            x = _design(b, 3)
            row, block = np.nonzero((t[:, None] >= begin) & (t[:, None] < end))
            p = models.chances(x[row], number[row], which[block])
            take = pa.array(row)
            yield pa.record_batch([pa.array(names, pa.string()).take(pa.array(block)), *(b.column(i).take(take) for i in range(3)), pa.array(p)], ["block", "draw_index", "number", "y", "p"])

    rows = panel.where((F.col("draw_index") >= int(begin.min())) & (F.col("draw_index") < int(end.max())))
    rows = rows.select(F.col("draw_index").cast("long").alias("draw_index"), F.col("number").cast("int").alias("number"), F.col("y").cast("long").alias("y"), *[F.col(c).cast("double").alias(c) for c in FEATURES])
    return rows.mapInArrow(run, "block string, draw_index long, number int, y long, p double")


def refits(first: int, periods: int, every: int, c: float = C, begin: int = 0, **more) -> tuple[list[Fit], list[tuple[str, str, int, int]]]:
    """Fits and blocks of an expanding walk: from period ``first`` on a refit every so many periods, each on all before it."""
    if not begin < first < periods or every < 1:
        raise ValueError("the first target lies outside the periods, or the interval below 1")
    starts = range(first, periods, every)
    return [Fit(str(s), s, begin, c, **more) for s in starts], [(str(s), str(s), s, min(s + every, periods)) for s in starts]


def projected_chances(rows: DataFrame, *by: str, shrink: float = 0.1) -> DataFrame:
    """(``by``, draw_index, items, q): each period's numbers in order, and their chances projected to a sum of six and shrunk to uniform."""
    arrays = rows.groupBy(*by, "draw_index").agg(F.sort_array(F.collect_list(F.struct("number", "y", "p"))).alias("items"))
    return arrays.withColumn("q", F.transform(projected(F.transform("items", lambda x: x["p"])), lambda x: shrunk(x, shrink)))


def losses(rows: DataFrame, *by: str, shrink: float = 0.1) -> DataFrame:
    """(``by``, draw_index, hits_6, brier, log_loss) of each period by its projected and shrunk chances.

    The six are those of the greatest chance to ten digits, ties to the smaller number. A period's numbers are one array.
    """
    arrays = projected_chances(rows, *by, shrink=shrink).withColumn("e", F.zip_with("items", "q", lambda x, q: F.struct((-F.round(q, 10)).alias("r"), x["number"].alias("n"), x["y"].alias("y"), q.alias("q"))))
    total = lambda f: F.aggregate("e", F.lit(0.0), lambda a, x: a + f(x)) / F.size("e")
    clip = lambda q: F.least(F.greatest(q, F.lit(1e-12)), F.lit(1 - 1e-12))
    hits = F.aggregate(F.slice(F.sort_array("e"), 1, 6), F.lit(0).cast("long"), lambda a, x: a + x["y"])
    brier, loss = total(lambda x: (x["q"] - x["y"]) * (x["q"] - x["y"])), total(lambda x: -F.log(F.when(x["y"] == 1, clip(x["q"])).otherwise(1 - clip(x["q"]))))
    return arrays.select(*by, "draw_index", hits.alias("hits_6"), brier.alias("brier"), loss.alias("log_loss"))


def block_losses(blocks: Packed, models: Fitted, spans: Sequence[tuple[str, str, int, int]], start: int = 0, shrink: float = 0.1) -> DataFrame:
    """``losses`` by block of ``scored``, from packed blocks: a row for each period comes out of a task, and no row for a number."""
    place = {f.name: k for k, f in enumerate(models.fits)}
    chosen = [(name, models.coef[place[fit]], models.effect[place[fit]], begin, end) for name, fit, begin, end in spans]
    chance = lambda x, coef, effect: 1 / (1 + np.exp(-(x @ coef + effect[:, None])))
    first = max(start, min(s[2] for s in spans))
    return _lost(blocks, chosen, chance, first, max(s[3] for s in spans), shrink)


def _lost(blocks: Packed, chosen: Sequence[tuple], chance: Callable[..., np.ndarray], first: int, end: int, shrink: float) -> DataFrame:
    """(block, draw_index, hits_6, brier, log_loss) of the periods of each of ``chosen`` (name, ..., begin, end); ``chance`` gives numbers by periods."""
    cells = _cells(blocks, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _, x, hits in cells(batches):
            for name, *model, begin, stop in chosen:
                low, high = np.searchsorted(t, [begin, stop])
                if low < high:
                    q, y = shrunk(projected_rows(chance(x[:, low:high], *model).T), shrink), hits[:, low:high].T
                    top = np.argsort(-np.round(q, 10), axis=1, kind="stable")[:, :6]
                    clip = np.clip(q, 1e-12, 1 - 1e-12)
                    found = [np.take_along_axis(y, top, 1).sum(1).astype(np.int64), ((q - y) ** 2).mean(1), -np.log(np.where(y == 1, clip, 1 - clip)).mean(1)]
                    yield pa.record_batch([pa.array([name] * (high - low), pa.string()), pa.array(t[low:high]), *map(pa.array, found)], ["block", "draw_index", "hits_6", "brier", "log_loss"])

    return blocks.between(first, end).mapInArrow(run, "block string, draw_index long, hits_6 long, brier double, log_loss double")


def coefficients(spark, models: Fitted) -> DataFrame:
    """(fit, term, value) of the intercept and the features of every fit."""
    rows = [(f.name, term, float(v)) for f, coef in zip(models.fits, models.coef, strict=True) for term, v in zip(("intercept", *FEATURES), coef, strict=True)]
    return spark.createDataFrame(rows, "fit string, term string, value double")


# --- variants of one fit by what each period adds to its sums ----------------------------------------------------------


def period_sums(panel: DataFrame, model: Fitted) -> DataFrame:
    """(draw_index, sums): gradient and curvature of each period's rows at the one fit of ``model``, which has no effects of numbers.

    A period has 44 sums in place of 49 rows; whatever weighs whole periods works on these.
    """
    if len(model.fits) != 1 or model.fits[0].number:
        raise ValueError("one fit without effects of numbers is needed")
    coef = [float(v) for v in model.coef[0]]
    fit = model.fits[0]
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in FEATURES)]
    z = sum((b * v for b, v in zip(coef[1:], x[1:], strict=True)), F.lit(coef[0]))
    rows = panel.where((F.col("draw_index") >= fit.begin) & (F.col("draw_index") < fit.end)).withColumn("p", 1 / (1 + F.exp(-z)))
    r, w = F.col("y") - F.col("p"), F.col("p") * (1 - F.col("p"))
    sums = [F.sum(r * v) for v in x] + [F.sum(w * x[i] * x[j]) for i, j in _PAIRS]
    return rows.groupBy("draw_index").agg(*[s.alias(c) for s, c in zip(sums, SUMS, strict=True)])


def _period_sums(x: np.ndarray, y: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """``period_sums`` of a block's cells: periods by sums."""
    x = np.ascontiguousarray(x.transpose(1, 0, 2))
    p = 1 / (1 + np.exp(-(x @ coef)))
    grad = ((y.T - p)[:, None, :] @ x)[:, 0]
    h = (x * (p * (1 - p))[..., None]).transpose(0, 2, 1) @ x
    rows, cols = np.array(_PAIRS).T
    return np.hstack([grad, h[:, rows, cols]])


def range_sums(blocks: Packed, model: Fitted, last: int, ranges: int, start: int = 0) -> DataFrame:
    """``period_sums`` for ``deletion_sums``, from packed blocks: periods of a block and of the same of so many ranges are one row, the ``last`` ones a row each.

    A row's draw_index is its first period's, so that it lies in its range.
    """
    fit, coef, cells = model.fits[0], model.coef[0], _cells(blocks, max(start, model.fits[0].begin))
    low, high = max(start, fit.begin), fit.end - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _, x, y in cells(batches):
            keep = t <= high
            t, sums = t[keep], _period_sums(x[:, keep], y[:, keep], coef)
            piece = np.where(t > high - last, t, -1 - (t - low) * ranges // (high - low + 1))
            cuts = np.flatnonzero(np.diff(piece, prepend=np.nan))
            if len(cuts):
                sums = np.add.reduceat(sums, cuts, 0)
                yield pa.record_batch([pa.array(t[cuts]), *(pa.array(sums[:, k].copy()) for k in range(len(SUMS)))], ["draw_index", *SUMS])

    return blocks.between(low, fit.end).mapInArrow(run, "draw_index long, " + ", ".join(f"{c} double" for c in SUMS))


def poisson_limits(most: int = 12) -> np.ndarray:
    """The Poisson law's running sums at mean 1: a uniform number's count is how many lie at or below it."""
    terms = np.cumprod([1.0, *(1 / k for k in range(1, most))])
    return np.exp(-1.0) * np.cumsum(terms)


def bootstrap_sums(sums: DataFrame, replicates: int) -> DataFrame:
    """(variant, sums): each replicate weighs every period by a Poisson count drawn from (replicate, period).

    One pass: tasks multiply the matrix of counts with their periods' sums, so that there are as many rows as replicates
    for each task, and never periods times replicates.
    """
    parts = lambda b: (np.asarray(b.column(0)), np.column_stack([np.asarray(b.column(k + 1)) for k in range(len(SUMS))]))
    return _bootstrapped(sums.select("draw_index", *SUMS), lambda batches: map(parts, batches), replicates)


def block_bootstrap_sums(blocks: Packed, model: Fitted, replicates: int, start: int = 0) -> DataFrame:
    """``bootstrap_sums`` of ``period_sums`` at ``model``, from packed blocks: a period's sums do not leave their task."""
    fit, coef = model.fits[0], model.coef[0]
    low = max(start, fit.begin)
    cells = _cells(blocks, low)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for t, _, x, y in cells(batches):
            n = np.searchsorted(t, fit.end)
            yield t[:n], _period_sums(x[:, :n], y[:, :n], coef)

    return _bootstrapped(blocks.between(low, fit.end), parts, replicates)


def _bootstrapped(rows: DataFrame, parts: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], replicates: int) -> DataFrame:
    prime = 1_000_003
    counts = np.searchsorted(poisson_limits(), np.arange(prime) / float(prime), "right").astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((replicates, len(SUMS)))
        r = np.arange(replicates, dtype=np.int64)[:, None]
        own, turn = (r * 104_729 % prime).astype(float), (r * 31 + 7).astype(float)
        # whole numbers below 2 ** 53 in doubles, whose division is many times as fast
        rest = lambda x: x - np.floor(x / prime) * prime
        for periods, sums in parts(batches):
            for i in range(0, len(periods), 512):
                key = periods[i : i + 512].astype(np.int64)
                mixed = rest((key * 7919 % prime).astype(float) + own)
                total += counts[rest(mixed * mixed + (key % 1009 + 17).astype(float) * turn).astype(np.int32)] @ sums[i : i + 512]
        yield pa.record_batch([pa.array(np.arange(replicates)), *(pa.array(total[:, k].copy()) for k in range(len(SUMS)))], ["variant", *SUMS])

    kind = ", ".join(f"{c} double" for c in SUMS)
    return rows.mapInArrow(run, f"variant long, {kind}").groupBy("variant").agg(*[F.sum(c).alias(c) for c in SUMS])


def deletion_sums(sums: DataFrame, last: int, blocks: int) -> DataFrame:
    """(variant, sums): all periods less the last 1 to ``last`` (variants of these numbers), and less each of ``blocks`` ranges (-1 down).

    Totals of ranges are made once; every variant is the whole less what it leaves out.
    """
    ends = sums.agg(F.min("draw_index").alias("low"), F.max("draw_index").alias("high"))
    t = sums.crossJoin(F.broadcast(ends))  # one row
    i = F.col("draw_index") - F.col("low")
    block = -1 - F.floor(i * blocks / (F.col("high") - F.col("low") + 1))
    back = F.col("high") - F.col("draw_index") + 1
    parts = t.select(F.explode(F.array(F.struct(F.lit("block").alias("kind"), block.alias("v")), F.struct(F.lit("back").alias("kind"), F.when(back <= last, back).alias("v")))).alias("k"), *SUMS)
    totals = parts.where("k.v is not null").groupBy("k.kind", "k.v").agg(*[F.sum(c).alias(c) for c in SUMS])
    out = Window.partitionBy("kind").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # ``last`` rows
    left = totals.where("kind = 'back'").select("v", *[F.sum(c).over(out).alias(c) for c in SUMS]).union(totals.where("kind = 'block'").select("v", *SUMS))
    whole = sums.agg(*[F.sum(c).alias(f"all_{c}") for c in SUMS])
    return left.crossJoin(F.broadcast(whole)).select(F.col("v").alias("variant"), *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in SUMS])  # one row


def stepped(variants: DataFrame, model: Fitted) -> DataFrame:
    """(variant, coef): one Newton step from ``model``'s fit on the sums of each variant."""
    fit, start = model.fits[0], model.coef[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = np.column_stack([np.asarray(b.column(k + 1)) for k in range(len(SUMS))])
            each = Fitted([fit] * b.num_rows, np.repeat(start[None], b.num_rows, 0), np.zeros((b.num_rows, 1)))
            done = _solved(each, sums[:, None, :])
            yield pa.record_batch([b.column(0), pa.array(list(done.coef), pa.list_(pa.float64()))], ["variant", "coef"])

    return variants.select(F.col("variant").cast("long").alias("variant"), *SUMS).mapInArrow(run, "variant long, coef array<double>")


def recommended(coefs: DataFrame, following: DataFrame, picks: int = 6) -> DataFrame:
    """(variant, picked): the numbers of the greatest score by each variant's coefficients, from the coming period's features.

    Scores are compared to ten digits, ties go to the smaller number. The coming period's 49 rows go to every task.
    """
    items = following.agg(F.sort_array(F.collect_list(F.struct("number", F.array(*[F.col(c).cast("double") for c in FEATURES]).alias("x")))).alias("items"))
    each = coefs.crossJoin(F.broadcast(items))  # one row
    score = lambda x: F.aggregate(F.zip_with(F.slice("coef", 2, _WIDTH - 1), x["x"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    ranked = F.sort_array(F.transform("items", lambda x: F.struct((-F.round(score(x), 10)).alias("s"), x["number"].alias("n"))))
    return each.select("variant", F.sort_array(F.transform(F.slice(ranked, 1, picks), lambda x: x["n"])).alias("picked"))
