"""Leakage-free features of every (period, number): all of them look at earlier periods alone.

Histories are cut into blocks of periods. A block also gets the few periods before it, for trailing windows, and one row of
totals for each number that hands on what lies further back. One exchange of the draws by block serves all windows, and
there are as many tasks as blocks, however few numbers there are. A block's windows are running sums of a matrix of hits,
periods by numbers, so that no row of the panel is ever sorted or moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.sinks.tables import stored
from panelwright.sources.draws import P0, UNIVERSE

AUDITED_ALPHA, BASE_ALPHA = 0.06, 2 / 21
TRANSITION_PRIOR, LONG_PRIOR = 30.0, 12.0
AUDITED_WINDOWS, BASE_WINDOWS = (20, 50, 100), (5, 10, 20, 50, 100, 200)
#: Periods in a block; (1 - alpha) ** BLOCK vanishes against any double of the average's size and its inverse does not overflow.
BLOCK = 2048


class Known(dict):
    """Matrices of a block by name, periods by numbers, each made when it is first asked for; ``draw_index`` is one column."""

    def __init__(self, found: dict[str, np.ndarray], makers: dict[str, Callable[[Known], np.ndarray]]):
        super().__init__(found)
        self.makers = makers

    def __missing__(self, name: str) -> np.ndarray:
        self[name] = out = self.makers[name](self)
        return out

    def __or__(self, more: dict[str, np.ndarray]) -> Known:
        return Known({**self, **more}, self.makers)


_TOTALS = "block long, number int, n_after long, c long, low long, high long, step long, n1 long, k1 long, ewma double, c_after long"


#: Draws that a task packs at a time.
PACK = 65_536


def _blocked(draws: DataFrame, reach: int, *more: str) -> DataFrame:
    """(block, start, bits, ``more``): ``draws`` (draw_index, numbers) by blocks; ``reach`` periods before a block are in it as well, and two at least.

    A task packs its draws before they are dealt out: periods of a block that follow each other are one row, their numbers
    are bits. So eight bytes a draw are moved, and the rows to be sorted by block are few, however long the history is.
    """
    size, reach = BLOCK, max(reach, 2)
    rows = draws.select(F.col("draw_index").cast("long").alias("draw_index"), "numbers", *more)
    kinds = dict(rows.dtypes)
    schema = "block long, start long, bits array<long>" + "".join(f", {c} array<{kinds[c]}>" for c in more)

    def packed_rows(t: pa.Table) -> pa.RecordBatch:
        at = t["draw_index"].to_numpy()
        late = np.flatnonzero(at % size >= size - reach)
        row, block = np.append(np.arange(len(at)), late), np.append(at // size, at[late] // size + 1)
        order = np.lexsort((at[row], block))
        row, block = row[order], block[order]
        at = at[row]
        cuts = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.append(cuts, len(at)), pa.int32()), x)
        columns = [pa.array(_bits(t["numbers"])[row]), *(t[c].combine_chunks().take(pa.array(row)) for c in more)]
        return pa.record_batch([pa.array(block[cuts]), pa.array(at[cuts]), *map(lists, columns)], ["block", "start", "bits", *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= PACK:
                yield packed_rows(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield packed_rows(pa.Table.from_batches(held))

    # a stated number of partitions: these rows are few bytes, but 49 come of each draw
    return rows.mapInArrow(run, schema).repartition(int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")


def _bits(sets: pa.ChunkedArray) -> np.ndarray:
    """Sets of numbers as bits."""
    sets = sets.combine_chunks()
    n = pc.fill_null(pc.list_value_length(sets), 0).to_numpy(zero_copy_only=False)
    out = np.zeros(len(n), np.int64)
    np.bitwise_or.at(out, np.repeat(np.arange(len(n)), n), np.int64(1) << pc.list_flatten(sets).to_numpy(zero_copy_only=False).astype(np.int64))
    return out


def _opened(periods: pa.Table) -> pa.Table:
    """A row for each period (draw_index, bits, and what else there is) of the rows of ``_blocked``."""
    if "start" not in periods.column_names:
        return periods
    lists = {c: periods[c].combine_chunks() for c in periods.column_names if c not in ("block", "start")}
    n = pc.list_value_length(lists["bits"]).to_numpy(zero_copy_only=False)
    first = periods["start"].to_numpy() - np.cumsum(n) + n
    return pa.table({"draw_index": np.repeat(first, n) + np.arange(n.sum()), **{c: pc.list_flatten(x) for c, x in lists.items()}})


def _hits(periods: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of a block's periods, their numbers in that order, and their hits as a matrix."""
    periods = _opened(periods)
    at = periods["draw_index"].to_numpy()
    bits = periods["bits"].to_numpy() if "bits" in periods.column_names else _bits(periods["numbers"])
    order = np.argsort(at)
    return order, at[order], bits[order, None] >> np.arange(1, UNIVERSE + 1) & 1


def _earlier(x: np.ndarray, by: int = 1) -> np.ndarray:
    """The rows of ``x`` moved down, zeros first."""
    out = np.zeros_like(x)
    out[by:] = x[:-by]
    return out


def _table(columns: dict[str, np.ndarray | pa.Array]) -> pa.Table:
    return pa.table({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def _no_rows(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "date": pa.date32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))})


def _totals(alpha: float, size: int):
    """The totals of a block's own periods, a row for each number."""

    def run(key: tuple, periods: pa.Table) -> pa.Table:
        _, at, y = _hits(periods)
        block, last, after = key[0].as_py(), _earlier(y), np.arange(len(at)) > 0
        own = at // size == block
        if not own.any():
            return _no_rows(_TOTALS)
        at, y, last, after = at[own], y[own], last[own], after[own]
        number, place = np.nonzero(np.ascontiguousarray(y.T))  # the hits of each number, in the order of periods
        hit, c = at[place], y.sum(0)
        never, end = c == 0, np.cumsum(c)
        edges = lambda to: pa.array(np.append(hit, 0)[np.where(never, -1, to)], mask=never)
        step, same = np.zeros(UNIVERSE, np.int64), number[1:] == number[:-1]
        np.maximum.at(step, number[1:][same], np.diff(hit)[same])
        gain = alpha * (1 - alpha) ** (size - 1 - (at % size).astype(float))
        return _table({
            "block": np.full(UNIVERSE, block), "number": np.arange(1, UNIVERSE + 1, dtype=np.int32), "n_after": np.full(UNIVERSE, after.sum()), "c": c, "low": edges(end - c), "high": edges(end - 1),
            "step": step, "n1": last.sum(0), "k1": (last & y).sum(0), "ewma": np.bincount(number, gain[place], UNIVERSE), "c_after": c - y[~after].sum(0),
        })

    return run


def block_totals(draws: DataFrame) -> DataFrame:
    """(block, number, c, low, high, step, ...): each block's hits of a number, the first and last of them and the longest way between two; low and high are null without hits."""
    return _blocked(draws, 0).groupBy("block").applyInArrow(_totals(AUDITED_ALPHA, BLOCK), _TOTALS)


def lagged_hits(draws: DataFrame, lags: int) -> DataFrame:
    """(number, lag, both): periods that hit a number as the period ``lag`` before did, for lags from 1; a row only where there are any."""
    size = BLOCK

    def run(key: tuple, periods: pa.Table) -> pa.Table:
        at, y = _every(periods)
        own = np.flatnonzero(at // size == key[0].as_py())
        both = np.array([(y[own[own >= k]] & y[own[own >= k] - k]).sum(0) for k in range(1, lags + 1)])
        lag, number = np.nonzero(both)
        return _table({"number": (number + 1).astype(np.int32), "lag": (lag + 1).astype(np.int32), "n": both[lag, number]})

    return _blocked(draws, lags).groupBy("block").applyInArrow(run, "number int, lag int, n long").groupBy("number", "lag").agg(F.sum("n").alias("both"))


def followed_hits(draws: DataFrame) -> DataFrame:
    """(a, b, n11): periods that hit b after one that hit a, for a < b; a row only where there are any."""
    size = BLOCK

    def run(key: tuple, periods: pa.Table) -> pa.Table:
        at, y = _every(periods)
        own = np.flatnonzero(at // size == key[0].as_py())
        own = own[own > 0]
        n = np.triu(y[own - 1].astype(float).T @ y[own].astype(float), 1)
        a, b = np.nonzero(n)
        return _table({"a": (a + 1).astype(np.int32), "b": (b + 1).astype(np.int32), "n": n[a, b].astype(np.int64)})

    return _blocked(draws, 1).groupBy("block").applyInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n11"))


def _every(periods: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A block's periods without a gap, and their hits; a period that is not there has none."""
    _, at, y = _hits(periods)
    whole = np.arange(at[0], at[-1] + 1)
    hits = np.zeros((len(whole), UNIVERSE), np.int64)
    hits[at - at[0]] = y
    return whole, hits


def _handed(totals: DataFrame, *by: str) -> DataFrame:
    """(block, number) totals of all blocks before; a row for each number and block, and for each of ``by``."""
    # the table has 49 rows for 2,048 periods: small against the panel
    past = Window.partitionBy(*by, "number").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    all_ = totals.withColumn("h_last", F.last("high", ignorenulls=True).over(past)).withColumn("first_step", F.coalesce(F.col("low") - F.col("h_last"), F.col("low"), F.lit(0)))
    total = lambda c: F.coalesce(F.sum(c).over(past), F.lit(0)).alias("h_" + c)
    return all_.select(
        *by, "block", "number", F.coalesce("h_last", F.lit(-1)).alias("h_last"), F.coalesce(F.min("low").over(past), F.lit(-1)).alias("h_first"), *[total(c) for c in ("c", "n1", "k1", "c_after", "n_after")],
        F.coalesce(F.max(F.greatest("first_step", "step")).over(past), F.lit(0)).alias("h_step"), F.coalesce(F.lag("ewma").over(Window.partitionBy(*by, "number").orderBy("block")), F.lit(0.0)).alias("h_ewma"),
    )


def _known(block: int, size: int, periods: pa.Table, handed: pa.Table, alpha: float, widths: tuple[int, ...]) -> Known:
    """What is known of each number before each of a block's own periods (see ``history``); -1 stands for never and for none."""
    order, at, y = _hits(periods)
    place = np.argsort(handed["number"].to_numpy())
    return _seen(block, size, order, at, y, {c: handed[c].to_numpy()[place] for c in handed.column_names if c.startswith("h_")}, alpha, widths)


def _seen(block: int, size: int, order: np.ndarray, at: np.ndarray, y: np.ndarray, h: dict[str, np.ndarray], alpha: float, widths: tuple[int, ...]) -> Known:
    """``_known`` of hits in the order of their periods, and totals in the order of numbers."""
    own = np.flatnonzero(at // size == block)
    first = own[0] if len(own) else 0
    up_to = np.vstack([np.zeros((1, UNIVERSE), np.int64), np.cumsum(y, 0)])  # hits before each row and after the last
    since_then = lambda w: up_to[own] - up_to[np.maximum(own - w, 0)]
    state, state_before, after, twice = _earlier(y)[own], _earlier(y, 2)[own], (own > 0)[:, None], (own > 1)[:, None]
    order, at, y = order[own], at[own, None], y[own]
    so_far = lambda x: _earlier(np.cumsum(x, 0))
    t, keep = (at % size).astype(float), 1 - alpha
    here = up_to[own] - up_to[first]

    def last_seen(_: Known) -> np.ndarray:
        last = np.vstack([h["h_last"][None, :], np.where(y == 1, at, -1)[:-1]])
        return np.maximum.accumulate(last, 0)[: len(at)]

    def first_seen(_: Known) -> np.ndarray:
        never = np.iinfo(np.int64).max
        low = np.vstack([np.full((1, UNIVERSE), never), np.minimum.accumulate(np.where(y == 1, at, never), 0)[:-1]])[: len(at)]
        return np.where(h["h_first"] >= 0, h["h_first"], np.where(low < never, low, -1))

    def max_step(k: Known) -> np.ndarray:
        way = np.where(y == 1, np.where(k["last_seen"] >= 0, at - k["last_seen"], at), 0)
        longest = np.vstack([np.zeros((1, UNIVERSE), np.int64), np.maximum.accumulate(way, 0)[:-1]])[: len(at)]
        return np.maximum(longest, h["h_step"])

    def n_from(_: Known) -> np.ndarray:
        n1, n_after = up_to[np.maximum(own - 1, 0)] - up_to[max(first - 1, 0)] + h["h_n1"], so_far(after.astype(np.int64)) + h["h_n_after"]
        return np.where(state == 1, n1, n_after - n1)

    def n_to(_: Known) -> np.ndarray:
        k1, c_after = so_far(y & state) + h["h_k1"], here + h["h_c_after"]
        if len(at) and not after[0]:
            c_after[1:] -= y[0]  # the first period of all follows none
        return np.where(state == 1, k1, c_after - k1)

    def ewma(_: Known) -> np.ndarray:
        start = P0 if block == 0 else h["h_ewma"] + P0 * keep**size if block == 1 else h["h_ewma"]
        return keep**t * (start + so_far(y * (alpha * keep ** -(t + 1))))

    makers = {
        "state": lambda _: np.where(after, state, -1), "state_before": lambda _: np.where(twice, state_before, -1), "count_before": lambda _: here + h["h_c"], "first_seen": first_seen, "last_seen": last_seen,
        "gap_asof": lambda k: at - 1 - k["last_seen"], "n_from": n_from, "n_to": n_to, "ewma": ewma, "max_step": max_step,
    }
    for w in widths:
        makers |= {f"sum_{w}": lambda _, w=w: since_then(w), f"rate_{w}": lambda k, w=w: np.where(at > 0, k[f"sum_{w}"] / np.maximum(np.minimum(at, w), 1), 0.0)}
    return Known({"draw_index": at, "y": y, "order": order}, makers)


def by_block(draws: DataFrame, make: Callable[[Known, pa.Table], pa.Table], schema: str, alpha: float = AUDITED_ALPHA, widths: tuple[int, ...] = (), blocks: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """The rows that ``make`` builds from what is known before each period of a block of ``draws``, and from the block's periods.

    ``draws`` (draw_index from 0 without a gap, numbers, ``more``) are dealt out by block once; their totals, 49 rows a block,
    are added up over blocks and meet the block again. ``blocks`` (block) leaves all other blocks out.
    """
    size = BLOCK
    blocked = _blocked(draws, max((0, *widths)), *more)
    handed = _handed(blocked.groupBy("block").applyInArrow(_totals(alpha, size), _TOTALS))
    if blocks is not None:
        blocked, handed = (x.join(F.broadcast(blocks), "block") for x in (blocked, handed))  # a few blocks

    def run(key: tuple, periods: pa.Table, totals: pa.Table) -> pa.Table:
        if not totals.num_rows:  # the periods before a block that is still to come
            return _no_rows(schema)
        periods = _opened(periods)
        return make(_known(key[0].as_py(), size, periods, totals, alpha, widths), periods)

    return blocked.groupBy("block").cogroup(handed.groupBy("block")).applyInArrow(run, schema)


@dataclass(frozen=True)
class Packed:
    """Blocks as a written table, a row each: periods, their numbers as bits, and the totals before them.

    A block's row is some 20 KB for the 100,000 cells of its panel, so that whoever passes over the panel again makes its
    features again and reads and writes next to nothing. ``year`` is 0 where the draws have no dates.
    """

    table: DataFrame
    alpha: float
    widths: tuple[int, ...]

    def between(self, begin: int, end: int) -> DataFrame:
        """The rows of the blocks that have periods with ``begin <= draw_index < end``."""
        return self.table.where((F.col("block") >= begin // BLOCK) & (F.col("block") <= (end - 1) // BLOCK))

    def reader(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[Known]]:
        """For use in tasks: what is known before each period of every block of a partition, and each period's ``year``, one column."""
        alpha, widths, size = self.alpha, self.widths, BLOCK

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[Known]:
            for b in batches:
                for row in range(b.num_rows):
                    block = b.column("block")[row].as_py()
                    at, bits, year, totals = (np.asarray(b.column(c)[row].values) for c in ("at", "bits", "year", "totals"))
                    totals = totals.reshape(len(_HANDED), UNIVERSE)
                    handed = {c: x if c == "h_ewma" else x.astype(np.int64) for c, x in zip(_HANDED, totals, strict=True)}
                    y = bits[:, None] >> np.arange(1, UNIVERSE + 1) & 1
                    known = _seen(block, size, np.arange(len(at)), at, y, handed, alpha, widths)
                    yield known | {"year": year[known["order"], None]}

        return run


_HANDED = ("h_last", "h_first", "h_c", "h_n1", "h_k1", "h_c_after", "h_n_after", "h_step", "h_ewma")


def packed(draws: DataFrame, alpha: float = AUDITED_ALPHA, widths: tuple[int, ...] = AUDITED_WINDOWS) -> Packed:
    """All blocks of ``draws``; totals are whole numbers far below 2 ** 53 and go as doubles beside the average."""
    reach = max(widths)
    dated = "draw_date" in draws.columns
    year = F.year("draw_date") if dated else F.lit(0)
    blocked = _blocked(draws.select("draw_index", "numbers", year.alias("year")), reach, "year")
    handed = _handed(blocked.groupBy("block").applyInArrow(_totals(alpha, BLOCK), _TOTALS))
    schema = "block long, at array<long>, bits array<long>, year array<int>, totals array<double>"

    def run(key: tuple, periods: pa.Table, totals: pa.Table) -> pa.Table:
        if not totals.num_rows:
            return pa.table({c: pa.array([], k) for c, k in (("block", pa.int64()), ("at", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())), ("year", pa.list_(pa.int32())), ("totals", pa.list_(pa.float64())))})
        periods = _opened(periods)
        order, at, y = _hits(periods)
        place = np.argsort(totals["number"].to_numpy())
        bits = (y << np.arange(1, UNIVERSE + 1)).sum(1)
        values = np.concatenate([totals[c].to_numpy()[place].astype(float) for c in _HANDED])
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.table({"block": [key[0].as_py()], "at": one(at, pa.int64()), "bits": one(bits, pa.int64()), "year": one(periods["year"].to_numpy()[order].astype(np.int32), pa.int32()), "totals": one(values, pa.float64())})

    return Packed(stored(blocked.groupBy("block").cogroup(handed.groupBy("block")).applyInArrow(run, schema), "blocks"), alpha, widths)


def _kind(name: str) -> str:
    if name in ("number", "y", "state", "state_before", "previous_1", "previous_2"):
        return "int"
    return "double" if name in ("ewma", "mean_gap", "recent_minus_long", "slope") or name.startswith(("rate_", "freq_", "z_", "transition_", "long_")) else "long"


def flat(known: Known, names: tuple[str, ...]) -> dict[str, pa.Array]:
    """Columns of a row for every period and number, nulls for never and none."""
    t = len(known["y"])
    out = {}
    for name in names:
        if name == "number":
            x = np.tile(np.arange(1, UNIVERSE + 1), t)
        else:
            x = np.broadcast_to(known[name], (t, UNIVERSE)).ravel()
        x = x.astype({"int": np.int32, "long": np.int64, "double": np.float64}[_kind(name)])
        out[name] = pa.array(x, mask=x < 0) if name in ("state", "state_before", "first_seen", "last_seen") else pa.array(x)
    return out


def history(draws: DataFrame, alpha: float = AUDITED_ALPHA, rates: tuple[int, ...] = (), sums: tuple[int, ...] = (), blocks: DataFrame | None = None, only: tuple[str, ...] = (), start: int = 0) -> DataFrame:
    """What is known of each number before each period of ``draws`` (draw_index from 0 without a gap, numbers).

    block, draw_index, number, y; state and state_before (hit one and two periods ago, null at the start); count_before,
    first_seen and last_seen; gap_asof; n_from and n_to (earlier periods that followed the present state, and hits among
    them); ewma, the exponential average seeded with 6/49; max_step, the longest way between hits or from the start to
    the first; rate_w, the share of hits among the last w periods, or as many as there are; sum_w, their number.
    ``blocks`` (block) leaves all other blocks out; ``only`` names the columns wanted; rows are those from period ``start``.
    """
    size = BLOCK
    names = only or ("block", "draw_index", "number", "y", "state", "state_before", "count_before", "first_seen", "last_seen", "gap_asof", "n_from", "n_to", "ewma", "max_step", *[f"rate_{w}" for w in rates], *[f"sum_{w}" for w in sums])

    def make(known: Known, _: pa.Table) -> pa.Table:
        known = since(known, start)
        return _table(flat(known | {"block": known["draw_index"] // size}, names))

    return by_block(draws, make, ", ".join(f"{c} {_kind(c)}" for c in names), alpha, tuple({*rates, *sums}), blocks)


def since(known: Known, start: int) -> Known:
    """The periods from ``start`` on."""
    keep = known["draw_index"][:, 0] >= start
    if keep.all():
        return known
    return Known({k: v[keep] for k, v in known.items()}, {name: lambda _, name=name: known[name][keep] for name in known.makers})


def transition_rate(known: Known, prior: float = TRANSITION_PRIOR) -> np.ndarray:
    return (known["n_to"] + prior * P0) / (known["n_from"] + prior)


def long_rate(known: Known, prior: float = LONG_PRIOR) -> np.ndarray:
    return (known["count_before"] + prior * P0) / (known["draw_index"] + prior)


def standardised(x: np.ndarray) -> np.ndarray:
    """Population z-scores over a period's numbers; 0 where the spread vanishes."""
    apart = x - x.mean(1, keepdims=True)
    sd = np.sqrt((apart * apart).mean(1, keepdims=True))
    return np.where(sd <= 1e-15, 0.0, apart / np.where(sd <= 1e-15, 1.0, sd))


def to_digits(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` as ``F.round`` has it: halves of its shortest decimal go up. A whole number and a division do for all that is no half."""
    scaled = x * 10.0**digits
    whole = np.rint(scaled)
    out = whole / 10.0**digits + 0.0
    # below 10 ** 13 the product is off by less than 0.001
    for i in np.argwhere((np.abs(scaled) >= 1e13) | (np.abs(scaled - whole) > 0.499)):
        out[tuple(i)] = float(Decimal(repr(float(x[tuple(i)]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, Context(400))) + 0.0
    return out


def audited(draws: DataFrame, blocks: DataFrame | None = None, only: tuple[str, ...] = (), start: int = 0, digits: int | None = None) -> DataFrame:
    """The audited snapshot of every period: raw rates and their z-scores over the 49 numbers, to so many ``digits`` where these are given."""
    names = only or ("draw_index", "number", "y", *AUDITED_RAW, *(f"z_{c}" for c in AUDITED_RAW))

    def make(known: Known, _: pa.Table) -> pa.Table:
        known = audited_known(since(known, start), names)
        if digits is not None:
            known = known | {c: to_digits(known[c], digits) for c in names if _kind(c) == "double"}
        return _table(flat(known, names))

    return by_block(draws, make, ", ".join(f"{c} {_kind(c)}" for c in names), AUDITED_ALPHA, AUDITED_WINDOWS, blocks)


AUDITED_RAW = ("gap_asof", "ewma", "transition_rate", "long_rate", *(f"rate_{w}" for w in AUDITED_WINDOWS))


def audited_known(known: Known, names: tuple[str, ...]) -> Known:
    """``known`` with its rates, and with the z-scores that are among ``names``."""
    known = known | {"transition_rate": transition_rate(known), "long_rate": long_rate(known)}
    return known | {f"z_{c}": standardised(known[c].astype(float)) for c in AUDITED_RAW if f"z_{c}" in names}


def following(draws: DataFrame) -> DataFrame:
    """The audited snapshot of the period that is still to come; of the history only its block and the totals before it are looked at."""
    t = draws.agg(F.count("*").alias("draw_index"))
    row = t.select("draw_index", F.array().cast("array<int>").alias("numbers"))
    block = t.select(F.floor(F.col("draw_index") / BLOCK).alias("block"))
    return audited(draws.select("draw_index", "numbers").unionByName(row), block).join(F.broadcast(t), "draw_index").drop("y")  # one row


BASE = (*(f"freq_{w}" for w in BASE_WINDOWS), "ewma", "current_gap", "max_gap", "mean_gap", "recent_minus_long", "slope", "previous_1", "previous_2")


def base_known(known: Known) -> Known:
    """``known`` with the base set's columns, but for the calendar."""
    count, freq = known["count_before"], {f"freq_{w}": known[f"rate_{w}"] for w in BASE_WINDOWS}
    return known | freq | {
        "current_gap": known["gap_asof"], "max_gap": np.maximum(known["max_step"], known["gap_asof"]), "mean_gap": np.where(count > 1, (known["last_seen"] - known["first_seen"]) / np.maximum(count - 1, 1), 0.0),
        "recent_minus_long": freq["freq_20"] - freq["freq_200"], "slope": (freq["freq_20"] - freq["freq_100"]) / 80, "previous_1": known["state"], "previous_2": np.maximum(known["state_before"], 0),
    }


def base(draws: DataFrame) -> DataFrame:
    """The base set: window frequencies, exponential average, gaps, slope, previous hits and the last known date's calendar."""
    names = ("draw_index", "number", "y", *BASE)

    def make(known: Known, periods: pa.Table) -> pa.Table:
        order, date = np.argsort(periods["draw_index"].to_numpy()), periods["draw_date"].combine_chunks()
        before = np.searchsorted(periods["draw_index"].to_numpy()[order], known["draw_index"][:, 0]) - 1
        known, before = base_known(since(known, 1)), before[known["draw_index"][:, 0] >= 1]  # the first period has no date before it
        return _table(flat(known, names) | {"known_date": date.take(pa.array(np.repeat(order[before], UNIVERSE)))})

    p = by_block(draws, make, ", ".join(f"{c} {_kind(c)}" for c in names) + ", known_date date", BASE_ALPHA, BASE_WINDOWS, more=("draw_date",))
    return p.select(*names, *[f("known_date").alias(c) for c, f in (("year", F.year), ("month", F.month), ("weekday", F.weekday))])


def by_block_twice(draws: DataFrame, change: Callable[[pa.Table], pa.Table], make: Callable[[list[tuple[Known, Known]]], pa.Table], schema: str, kinds: tuple[tuple[float, tuple[int, ...]], ...], last: int) -> DataFrame:
    """The rows that ``make`` builds of the blocks up to period ``last``, from what is known in ``draws`` and in the same draws after ``change``, for each of ``kinds`` (alpha, widths).

    ``change`` takes some periods as they lie in a task. Totals are those of all blocks of either history; both meet in the block's task.
    """
    size = BLOCK
    blocked = _blocked(draws, max(max(widths) for _, widths in kinds))

    def totals(key: tuple, periods: pa.Table) -> pa.Table:
        periods = _opened(periods)
        made = [_totals(alpha, size)(key, p) for p in (periods, change(periods)) for alpha, _ in kinds]
        return pa.concat_tables([t.append_column("kind", pa.array(np.full(len(t), k, np.int32))) for k, t in enumerate(made)])

    handed = _handed(blocked.groupBy("block").applyInArrow(totals, f"{_TOTALS}, kind int"), "kind").where(F.col("block") <= last // size)

    def run(key: tuple, periods: pa.Table, totals: pa.Table) -> pa.Table:
        if not totals.num_rows:  # the periods before a block that is still to come
            return _no_rows(schema)
        periods, of = _opened(periods), totals["kind"].to_numpy()
        known = lambda p, k, alpha, widths: _known(key[0].as_py(), size, p, totals.filter(pa.array(of == k)), alpha, widths)
        other = change(periods)
        return make([(known(periods, k, *kind), known(other, len(kinds) + k, *kind)) for k, kind in enumerate(kinds)])

    return blocked.where(F.col("block") <= last // size).groupBy("block").cogroup(handed.groupBy("block")).applyInArrow(run, schema)
