"""Random forests of the audited features, grown level by level from histograms.

A level is one pass over the rows for all trees of all forests: a task finds each row's node in every tree and adds the
row's weight, and its hits, to the histograms of the features that the node may split by; Spark adds the tasks' histograms
and keeps each node's best split. Trees are small tables of splits, so rows never move. A tree draws whole periods: a
period's 49 rows have one Poisson weight, from (tree, period).

Rows come as a panel, or from packed blocks of draws (``features.packed``), whose features are made anew in each pass.
Bins are bytes, and so is a step down a tree: a level's splits are all held against all rows, and masks keep what holds
for a row's own node, so that nothing is looked up row by row but the cell of a histogram.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.features import Packed, audited_known, since
from panelwright.operators.fits import FEATURES, _lost, poisson_limits
from panelwright.sources.draws import P0

#: Features are cut into bins of this width around 0, the outermost of which are open; they are standardised by period.
BINS, WIDTH = 32, 0.25
#: Features that a node may split by.
TRIED = 3


@dataclass(frozen=True)
class Forest:
    """A forest by name, trained on rows with ``begin <= draw_index < end``; ``balanced`` weighs hits and misses alike in all."""

    name: str
    end: int
    begin: int = 0
    trees: int = 60
    depth: int = 6
    leaf: int = 30
    balanced: bool = False


@dataclass
class Grown:
    """Splits of every tree (tree by node, nodes numbered from 1 as in a heap): feature or -1, last bin that goes left, and hit rate."""

    forests: list[Forest]
    owner: np.ndarray
    feature: np.ndarray
    edge: np.ndarray
    rate: np.ndarray

    def path(self, bins: Sequence[np.ndarray], level: int, tree: int) -> list[np.ndarray]:
        """For each of the first ``level`` steps down a tree, 255 where a row goes right and 0 elsewhere; ``bins`` has an array for each feature. A leaf's rows go left."""
        stay, out = np.zeros_like(bins[0]), []
        feature, edge = self.feature[tree].tolist(), self.edge[tree].tolist()  # plain numbers, which leave bytes as they are
        for step in range(level):
            right = _own([stay if feature[n] < 0 else (bins[feature[n]] > edge[n]).view(np.uint8) for n in range(1 << step, 2 << step)], out)
            out.append(np.negative(right))
        return out

    def open(self, level: int) -> np.ndarray:
        """Whether rows come to the nodes of ``level``, tree by node: below a leaf there are none."""
        out = np.ones((len(self.owner), 1), bool)
        for step in range(level):
            out = np.repeat(out & (self.feature[:, 1 << step : 2 << step] >= 0), 2, 1)
        return out

    def rates(self) -> np.ndarray:
        """Hit rates of the nodes of the last level, tree by node; those below a leaf have the leaf's."""
        depth = self.feature.shape[1].bit_length() - 2
        out = self.rate[:, 1:2]
        for step in range(depth):
            leaf = np.repeat(self.feature[:, 1 << step : 2 << step] < 0, 2, 1)
            out = np.where(leaf, np.repeat(out, 2, 1), self.rate[:, 2 << step : 4 << step])
        return out

    def chances(self, bins: Sequence[np.ndarray], trees: Sequence[int]) -> np.ndarray:
        """The mean hit rate of every row by some ``trees``."""
        depth, rates, p = self.feature.shape[1].bit_length() - 2, self.rates(), np.zeros(bins[0].shape)
        for tree in trees:
            p += rates[tree].take(_node(self.path(bins, depth, tree), bins[0].shape))
        return p / max(len(trees), 1)


def _own(values: list[np.ndarray], path: Sequence[np.ndarray]) -> np.ndarray:
    """Of ``values``, one array for each node of a level, each row's own node's."""
    for right in reversed(path):
        values = [a if a is b else a ^ ((a ^ b) & right) for a, b in zip(values[::2], values[1::2], strict=True)]
    return values[0]


def _node(path: Sequence[np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Each row's place among the nodes of its level."""
    out = np.zeros(shape, np.uint8 if len(path) <= 8 else np.uint16)
    for right in path:
        out <<= 1
        out |= right & 1
    return out


def binned(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x / WIDTH) + BINS // 2, 0, BINS - 1).astype(np.uint8)


def _hash(*keys: np.ndarray | int) -> np.ndarray:
    """Numbers below 1,000,003 from integers."""
    out = np.int64(17)
    for k in keys:
        out = (out * 7919 + np.asarray(k, np.int64) * 104_729 + 12_345) % 1_000_003
        out = (out * out + 31 * out + 7) % 1_000_003
    return out


def weights(tree: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How often each tree draws each period, periods by trees."""
    return np.searchsorted(poisson_limits(), _hash(tree[None, :], period[:, None]) / 1_000_003.0, "right")


def tried(tree: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Whether a node may split by each feature: TRIED of them, by hashes of (tree, node, feature)."""
    h = np.stack([_hash(tree, node, f) * len(FEATURES) + f for f in range(len(FEATURES))], -1)
    return h <= np.partition(h, TRIED - 1, -1)[..., TRIED - 1 : TRIED]


#: Rows that a task takes at a time.
ROWS = 40_000


#: Rows with a weight of their own each (panel), or periods of 49 rows (packed blocks): periods, outcomes and, by feature, bins, both periods by rows.
Cells = tuple[np.ndarray, np.ndarray, list[np.ndarray]]


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Some batches as one table."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= ROWS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _of_panel(t: pa.Table) -> Cells:
    column = lambda i: np.asarray(t.column(i))[:, None]
    return np.asarray(t.column(0)), column(1).astype(np.uint8), [binned(column(i + 2).astype(float)) for i in range(len(FEATURES))]


def _panel_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[Cells]:
    return map(_of_panel, _tables(batches))


def _block_cells(blocks: Packed, begin: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[Cells]]:
    """For use in tasks: the cells of every block of a partition, from period ``begin`` on."""
    read = blocks.reader()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[Cells]:
        for known in read(batches):
            known = since(known, begin)
            if len(known["y"]):
                known = audited_known(known, FEATURES)
                yield known["draw_index"][:, 0], known["y"].astype(np.uint8), [binned(known[c]) for c in FEATURES]

    return run


def _aligned(slots: np.ndarray) -> np.ndarray:
    """``slots`` (tree, node, place) with a feature that both nodes of a split may try at the same place, so that it need not be told apart there."""
    for each in slots:
        for a, b in zip(each[::2].tolist(), each[1::2], strict=False):
            rest = [f for f in b.tolist() if f not in a]
            b[:] = [f if f in b else rest.pop() for f in a]
    return slots


def _histograms(now: Grown, level: int, scale: np.ndarray, cells: Callable[[Iterator[pa.RecordBatch]], Iterator[Cells]] = _panel_cells):
    """(tree, node, feature, bin, w, hits) of a partition's rows at the nodes of ``level`` that are no leaves."""
    trees = np.arange(len(now.owner))
    begin, end = (np.array([getattr(now.forests[o], k) for o in now.owner]) for k in ("begin", "end"))
    alive = np.array([now.forests[o].depth > level for o in now.owner])
    width = 1 << level
    allowed = tried(trees[:, None], width + np.arange(width)[None, :])
    slots = _aligned(np.argsort(~allowed, axis=-1, kind="stable")[..., :TRIED])  # the features that each node may split by

    def roots(y: np.ndarray, bins: list[np.ndarray], drawn: np.ndarray, found: np.ndarray) -> None:
        """All rows are at the root: a period's own counts times its weights."""
        every = 2 * BINS * np.arange(len(y))[:, None] + BINS * y
        for f, own in enumerate(bins):
            counts = np.bincount((every + own).ravel(), minlength=2 * BINS * len(y)).reshape(len(y), -1)
            tree, k = np.nonzero(slots[:, 0] == f)
            found[tree, k] += (drawn.T.astype(np.float32) @ counts.astype(np.float32))[tree].reshape(-1, 2, BINS)  # whole numbers far below 2 ** 24

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = width * BINS
        found = np.zeros((len(trees), TRIED, 2, size))  # whole numbers: draws of rows without and with a hit
        for t, y, bins in cells(batches):
            periods, of = np.unique(t, return_inverse=True)
            drawn = (weights(trees, periods) * ((periods[:, None] >= begin) & (periods[:, None] < end) & alive))[of]
            if not level and y.shape[1] > 1:
                roots(y, bins, drawn, found)
                continue
            for tree in np.flatnonzero(drawn.any(0)):
                row = np.flatnonzero(drawn[:, tree])
                w = drawn[row, tree]
                own = [b.take(row, 0) for b in bins]
                path = now.path(own, level, tree)
                # a row's weight, outcome, node and bin make one small integer
                most = int(w.max()) + 1
                kind = np.uint16 if 2 * most * size <= 1 << 16 else np.uint32
                place = y.take(row, 0).astype(kind)
                place *= kind(size)
                place += (2 * size * w).astype(kind)[:, None]
                if level:
                    place += _node(path, place.shape).astype(kind) * kind(BINS)
                for k in range(TRIED):
                    counts = np.bincount((place + _own([own[f] for f in slots[tree, :, k]], path)).ravel(), minlength=2 * most * size)
                    found[tree, k] += np.tensordot(np.arange(most), counts.reshape(most, 2, size), 1)
        found = found.reshape(len(trees), TRIED, 2, width, BINS) * now.open(level)[:, None, None, :, None]
        missed, hits = found[:, :, 0].reshape(len(trees), TRIED, size), found[:, :, 1].reshape(len(trees), TRIED, size)
        tree, k, cell = np.nonzero(missed + hits)
        node, bin_ = np.divmod(cell, BINS)
        won = hits[tree, k, cell] * scale[tree]
        yield pa.record_batch([pa.array(x.astype(np.int32)) for x in (tree, node + width, slots[tree, node, k], bin_)] + [pa.array(missed[tree, k, cell] + won), pa.array(won)], ["tree", "node", "feature", "bin", "w", "hits"])

    return run


def _splits(cells: DataFrame, leaf: DataFrame) -> DataFrame:
    """(tree, node, feature, bin, rates): each node's best split, ties to the first feature and bin; feature is null where none helps.

    A split's gain is what it takes off the weighted squared deviation (Gini's impurity, but for a factor); each side
    keeps the weight of ``leaf`` rows.
    """
    own = Window.partitionBy("tree", "node", "feature")
    left = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    c = cells.withColumn("lw", F.sum("w").over(left)).withColumn("lh", F.sum("hits").over(left)).withColumn("aw", F.sum("w").over(own)).withColumn("ah", F.sum("hits").over(own)).join(F.broadcast(leaf), "tree")  # a row for each tree
    rw, rh = F.col("aw") - F.col("lw"), F.col("ah") - F.col("lh")
    gain = F.when((F.col("lw") >= F.col("leaf")) & (rw >= F.col("leaf")) & (rw > 0), F.round(F.col("lh") * F.col("lh") / F.col("lw") + rh * rh / rw - F.col("ah") * F.col("ah") / F.col("aw"), 9))
    ranked = F.struct((-gain).alias("g"), "feature", "bin")
    best = F.min_by(F.struct("feature", "bin", (F.col("lh") / F.col("lw")).alias("left"), F.try_divide(rh, rw).alias("right")), F.when(gain > 0, ranked))
    return c.groupBy("tree", "node").agg(best.alias("s"), F.max("aw").alias("w"), F.max("ah").alias("h")).select("tree", "node", "s.feature", "s.bin", "s.left", "s.right", (F.col("h") / F.col("w")).alias("own"))


def grown(panel: DataFrame | Packed, forests: Sequence[Forest], start: int = 0) -> Grown:
    """All ``forests`` of ``panel`` (draw_index, y, features), a job for each level. Splits, at most trees times nodes, come to the driver.

    Packed blocks give the audited features of their periods from ``start`` on. A forest without rows gives the uniform chance.
    """
    owner = np.repeat(np.arange(len(forests)), [f.trees for f in forests])
    depth = max(f.depth for f in forests)
    shape = (len(owner), 1 << (depth + 1))
    now = Grown(list(forests), owner, np.full(shape, -1), np.zeros(shape, np.int64), np.full(shape, P0))
    low, high = min(f.begin for f in forests), max(f.end for f in forests)
    if isinstance(panel, Packed):
        rows, read, spark = panel.between(max(low, start), high), _block_cells(panel, start), panel.table.sparkSession
    else:
        rows = panel.select(F.col("draw_index").cast("long").alias("draw_index"), F.col("y").cast("int").alias("y"), *[F.col(c).cast("double").alias(c) for c in FEATURES])
        rows, read, spark = rows.where((F.col("draw_index") >= low) & (F.col("draw_index") < high)), _panel_cells, panel.sparkSession
    scale = np.array([(1 - P0) / P0 if forests[o].balanced else 1.0 for o in owner])
    leaf = spark.createDataFrame([(k, float(forests[o].leaf)) for k, o in enumerate(owner)], "tree int, leaf double")
    for level in range(depth):
        cells = rows.mapInArrow(_histograms(now, level, scale, read), "tree int, node int, feature int, bin int, w double, hits double").groupBy("tree", "node", "feature", "bin").agg(F.sum("w").alias("w"), F.sum("hits").alias("hits"))
        found = _splits(cells, leaf).toArrow()
        tree, node = np.asarray(found["tree"]), np.asarray(found["node"])
        if level == 0:
            now.rate[tree, node] = np.asarray(found["own"])
        split = np.asarray(found["feature"].is_valid())
        if not split.any():
            break
        tree, node = tree[split], node[split]
        found = found.filter(pa.array(split))
        now.feature[tree, node], now.edge[tree, node] = np.asarray(found["feature"]), np.asarray(found["bin"])
        now.rate[tree, 2 * node], now.rate[tree, 2 * node + 1] = np.asarray(found["left"]), np.asarray(found["right"])
    return now


def scored(panel: DataFrame, forest: Grown, blocks: Sequence[tuple[str, str, int, int]]) -> DataFrame:
    """(block, draw_index, number, y, p): rows with begin <= draw_index < end of each block (name, forest, begin, end), by the mean of the forest's trees."""
    place = {f.name: np.flatnonzero(forest.owner == k) for k, f in enumerate(forest.forests)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tables(batches):
            t, _, bins = _of_panel(rows)
            for name, which, begin, end in blocks:
                at = np.flatnonzero((t >= begin) & (t < end))
                if len(at):
                    p = forest.chances([b.take(at) for b in bins], place[which])
                    b = rows.take(pa.array(at)).combine_chunks()
                    column = lambda i, b=b: b.column(i).combine_chunks()
                    yield pa.record_batch([pa.array([name] * len(at), pa.string()), column(0), column(len(FEATURES) + 2), column(1).cast(pa.int64()), pa.array(p)], ["block", "draw_index", "number", "y", "p"])

    rows = panel.where((F.col("draw_index") >= min(b[2] for b in blocks)) & (F.col("draw_index") < max(b[3] for b in blocks)))
    rows = rows.select(F.col("draw_index").cast("long").alias("draw_index"), F.col("y").cast("int").alias("y"), *[F.col(c).cast("double").alias(c) for c in FEATURES], F.col("number").cast("int").alias("number"))
    return rows.mapInArrow(run, "block string, draw_index long, number int, y long, p double")


def block_losses(blocks: Packed, forest: Grown, spans: Sequence[tuple[str, str, int, int]], start: int = 0, shrink: float = 0.1) -> DataFrame:
    """``fits.losses`` by block of ``scored``, from packed blocks: a row for each period comes out of a task, and no row for a number."""
    place = {f.name: np.flatnonzero(forest.owner == k) for k, f in enumerate(forest.forests)}
    chance = lambda x, trees: forest.chances([binned(x[:, :, k + 1]) for k in range(len(FEATURES))], trees)
    first = max(start, min(s[2] for s in spans))
    return _lost(blocks, [(name, place[which], begin, end) for name, which, begin, end in spans], chance, first, max(s[3] for s in spans), shrink)
