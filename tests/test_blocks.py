"""What blocks of periods make, held against plainer ways to the same numbers."""

from __future__ import annotations

import os
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from panelwright.operators import features, fits, forest, permutation, resampling, strategies
from panelwright.plans import queries
from panelwright.sources.draws import lowest


SF = "/root/testdata/sf0.001"


def _known(t: int = 400) -> features.Known:
    y = np.zeros((t, 49), np.int64)
    np.put_along_axis(y, lowest(np.arange(t) * 3 + 11, 6) - 1, 1, 1)
    handed = {f"h_{c}": np.full(49, -1 if c in ("last", "first") else 0) for c in ("last", "first", "c", "n1", "k1", "c_after", "n_after", "step", "ewma")}
    return features._seen(0, 2048, np.arange(t), np.arange(t), y, handed, 0.1, (20, 50, 100))


def test_matrices_are_made_when_asked_for():
    """gaps need neither averages nor windows."""
    known = features.since(_known(), 300)
    assert known["gap_asof"].shape == (100, 49) and "ewma" not in known and "sum_50" not in known
    assert (known["gap_asof"] == _known()["gap_asof"][300:]).all()
    with pytest.raises(KeyError):
        known["no_such"]


def test_first_places_and_losses():
    """ranks by one sort of integers are those of a stable sort, and losses those of one entry at a time."""
    h = features.since(_known(), 100)
    rng = np.random.default_rng(3)
    for x in [*strategies._strategy_scores(h).values(), *strategies._baselines(h).values(), np.full((5, 49), 7.0), rng.integers(0, 3, (50, 49)) / 3, rng.normal(size=(50, 49)), 100 + rng.random((50, 49)) * 1e-11]:
        assert (strategies.first_places(x, 10) == np.argsort(-x, axis=1, kind="stable")[:, :10]).all()
    x, y = strategies._strategy_scores(h)["mixed_hot_cold"], h["y"]
    got = strategies._losses(x, y, 1e-6)
    for i in range(0, len(y), 37):
        p = 6 * (x[i] - x[i].min() + 1e-9) / (x[i] - x[i].min() + 1e-9).sum()
        q = np.clip(p, 1e-6, 1 - 1e-6)
        assert got["brier"][i] == pytest.approx(((q - y[i]) ** 2).mean()) and got["log_loss"][i] == pytest.approx(-np.log(np.where(y[i] == 1, q, 1 - q)).mean())


@pytest.mark.parametrize("block", (32, 2048))
def test_sums_of_parts_are_those_of_periods(spark, draws, monkeypatch, block):
    """parts that reach over blocks, and periods in several parts."""
    monkeypatch.setattr(features, "BLOCK", block)
    rows = [r.asDict() for r in strategies.periods(draws, 10, against="uniform_random").collect()]
    of = lambda i: np.nonzero(np.stack([i >= 0, i % 2 == 1, i >= 50, i < 0], 1))
    got = {(r["strategy"], r["part"]): r for r in strategies.period_sums(draws, of, 10).groupBy("strategy", "part").agg(*[F.sum(c).alias(c) for c in ("n", "hits_6", "brier", "log_loss", "brier_0")]).collect()}
    for s in strategies.STRATEGIES:
        for part, keep in enumerate((lambda i: True, lambda i: i % 2 == 1, lambda i: i >= 50)):
            own = [r for r in rows if r["strategy"] == s and keep(r["draw_index"])]
            assert got[s, part]["n"] == len(own) and got[s, part]["hits_6"] == sum(r["hits_6"] for r in own)
            assert all(got[s, part][c] == pytest.approx(sum(r[c] for r in own)) for c in ("brier", "log_loss", "brier_0"))
    assert len(got) == 3 * len(strategies.STRATEGIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_parts_are_joined_to_nothing(spark):
    """a block brings its share of each part, the uniform strategy's beside it."""
    for name in ("block_improvement", "period_slices"):
        assert "Join" not in queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_digits_are_those_of_spark(spark):
    """rounding inside blocks gives the doubles of F.round, halves, signs and large values included."""
    rng = np.random.default_rng(0)
    x = np.array([*rng.normal(size=2000), *(rng.normal(size=2000) * 10.0 ** rng.integers(-12, 18, 2000)), *((rng.integers(-(10**11), 10**11, 1000) + 0.5) / 1e9), *(rng.integers(-2000, 2000, 500) / 2**12), 0.0, -0.0, 5e-10, -5e-10, 2.5e-9, 9999.9999999995, -1e300])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 9) + 0.0).collect()]
    assert features.to_digits(x, 9).tolist() == want
    assert features.to_digits(x[:4000].reshape(80, 50), 9).ravel().tolist() == want[:4000]


@pytest.mark.parametrize("n", (1, 39, 40, 41, 300, 2048))
def test_block_hits(n):
    """sums of eight counts at a time, the fullest masks included."""
    rng = np.random.default_rng(n)
    outcome = rng.integers(0, 2**50, n).astype(np.uint64)
    masks = rng.integers(0, 2**50, (n, 3)).astype(np.uint64)
    masks[:, 2] = outcome[:] = 2**50 - 2
    outcome[::2] = rng.integers(0, 2**50, len(outcome[::2]))
    powers = np.outer(permutation.MULTIPLIERS, np.arange(n)) % n
    got = permutation._block_hits(outcome, masks, 5, powers, 4)
    for r in range(5):
        to = (permutation.MULTIPLIERS[(r * 31 + 5) % len(permutation.MULTIPLIERS)] * np.arange(n) + r * 7919 + 5 * 104_729) % n if r else np.arange(n)
        assert got[r].tolist() == np.bitwise_count(masks & outcome[to][:, None]).sum(0, dtype=np.int64).tolist()


def test_histories_by_brute_force(monkeypatch):
    """extremes of a history made in chunks are those of its draws; a draw has six numbers, and all sets are alike."""
    monkeypatch.setattr(resampling, "CHUNK", 170)
    size = 1003
    rng = np.random.default_rng([9, 3])
    made = [resampling.fair(rng, min(170, size - start)) for start in range(0, size, 170)]
    sets = [{int(k) for k in row if k} for numbers, _, _ in made for row in numbers]
    assert all(len(s) == 6 for s in sets)
    assert [int(m) for _, masks, _ in made for m in masks] == [sum(1 << k for k in s) for s in sets]
    gap = 0
    for k in range(1, 50):
        at = [i for i, s in enumerate(sets) if k in s]
        gap = max(gap, at[0], size - 1 - at[-1], *np.diff(at))
    shared, sums = [len(a & b) for a, b in zip(sets, sets[1:], strict=False)], [sum(s) for s in sets]
    want = (max(abs(sum(k in s for s in sets) - size * 6 / 49) for k in range(1, 50)), gap, np.mean(sums), np.std(sums, ddof=1), sum(s >= 2 for s in shared) / size, max(shared))
    assert resampling.history_metrics(size, 9, 3) == pytest.approx(want)
    assert resampling.history_metrics(1, 9, 3)[1:] == pytest.approx((1, resampling.fair(np.random.default_rng([9, 3]), 1)[2][0], 0, 0, 0))


def test_all_histories_are_made(monkeypatch, draws):
    """F5 of round 4: the sequence is held against 10,000 fair histories, not 200."""
    asked = []
    monkeypatch.setattr(resampling, "simulate", lambda spark, periods, replicates: asked.append((periods, replicates)) or spark.range(replicates).selectExpr("id as replicate", *(f"cast(id as double) as {m}" for m in resampling.METRICS)))
    got = {r["metric"]: r["p"] for r in queries.monte_carlo_comparison(draws).collect()}
    assert asked == [(80, 10_000)] and got.keys() == set(resampling.METRICS)


def test_the_longest_way_by_brute_force(monkeypatch):
    """Ways that lie inside a chunk, reach over chunks, open or close the history, of numbers that come often, once or never."""
    rng = np.random.default_rng(3)
    for trial in range(60):
        size, chunk = int(rng.integers(1, 900)), int(rng.integers(100, 400))
        numbers, masks, _ = resampling.fair(rng, size)
        for k in rng.choice(np.arange(1, 50), trial % 4, replace=False):  # numbers that stay away for a while, and may take their time to come at all
            low, high = np.sort(rng.integers(0, size + 1, 2))
            masks[low:high] &= ~np.uint64(1 << int(k))
        want, last, longest = 0, np.full(49, -1), 0
        for k in range(1, 50):
            at = np.flatnonzero(masks & np.uint64(1 << k))
            want = max([want, *at[:1], *np.diff(at), size - 1 - at[-1] if len(at) else size])
        for start in range(0, size, chunk):
            longest = resampling._longest_way(masks[start : start + chunk], start, last, longest)
        assert max(longest, np.where(last >= 0, size - 1 - last, size).max()) == want
        assert resampling._counts(masks).tolist() == [np.count_nonzero(masks & np.uint64(1 << k)) for k in range(1, 50)]


def test_fair_draws_are_alike():
    numbers, _, _ = resampling.fair(np.random.default_rng(1), 200_000)
    sets = np.sort(numbers, 1)[:, 2:].astype(int)
    pairs = Counter((a, b) for i, j in combinations(range(6), 2) for a, b in zip(sets[:, i].tolist(), sets[:, j].tolist(), strict=True))
    each = 200_000 * 15 / 1176
    assert len(pairs) == 1176 and sum((n - each) ** 2 / each for n in pairs.values()) < 1176 + 5 * (2 * 1176) ** 0.5


def test_draws_are_dealt_out_packed(spark, monkeypatch):
    """F3 of round 4: a row holds all that a task has of a block, not one draw; periods out of order, with gaps and without numbers keep what is theirs."""
    rng = np.random.default_rng(8)
    sets = {i: sorted(int(x) + 1 for x in rng.choice(49, 6, replace=False)) for i in range(5_000) if not 3_000 <= i < 3_010}
    sets[4_999] = []
    rows = [(i, s, 2000 + i % 7) for i, s in sets.items()]
    frame = spark.createDataFrame(rows, "draw_index long, numbers array<int>, year int").repartitionByRange(2, "draw_index").sortWithinPartitions("draw_index")
    packed = features._blocked(frame, 60, "year").toArrow()
    assert packed.num_rows <= 6
    some = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], frame.schema).repartition(3)
    for table in (packed, features._blocked(some, 60, "year").toArrow()):
        got = {}
        for block in sorted(set(table["block"].to_pylist())):
            one = features._opened(table.filter(pa.compute.equal(table["block"], block)))
            got[block] = sorted(zip(*(one[c].to_pylist() for c in ("draw_index", "bits", "year")), strict=True))
        assert got == {b: [(i, sum(1 << n for n in s), y) for i, s, y in rows if b * 2048 - 60 <= i < (b + 1) * 2048] for b in range(3)}


def test_totals_of_a_block_without_some_numbers():
    """First and last hits are null where a number stays away, and the longest way is 0 with one hit."""
    periods = pa.table({"draw_index": [2, 0, 1], "numbers": pa.array([[1, 2], [1, 3], [2, 49]], pa.list_(pa.int32()))})
    got = {r["number"]: r for r in features._totals(0.1, 2048)((pa.scalar(0),), periods).to_pylist()}
    assert [(got[n]["c"], got[n]["low"], got[n]["high"], got[n]["step"], got[n]["c_after"]) for n in (1, 2, 3, 4, 49)] == [(2, 0, 2, 2, 1), (2, 1, 2, 1, 2), (1, 0, 0, 0, 0), (0, None, None, 0, 0), (1, 1, 1, 0, 1)]


def test_a_forest_hashes_periods_once(monkeypatch):
    """a task draws weights by period, not by row, and rows that arrive in many batches count as in one."""
    asked = []
    drawn = forest.weights
    monkeypatch.setattr(forest, "weights", lambda tree, period: asked.append(len(period)) or drawn(tree, period))
    rng = np.random.default_rng(5)
    t, y = np.repeat(np.arange(60), 49), (rng.random(60 * 49) < 0.12).astype(np.int32)
    x = rng.normal(size=(len(t), len(fits.FEATURES)))
    rows = pa.RecordBatch.from_arrays([pa.array(t), pa.array(y), *map(pa.array, x.T)], ["draw_index", "y", *fits.FEATURES])
    now = forest.Grown([forest.Forest("a", 50, 5, trees=3)], np.zeros(3, np.int64), np.full((3, 128), -1), np.zeros((3, 128), np.int64), np.zeros((3, 128)))
    run = forest._histograms(now, 0, np.ones(3))
    (one,), (many,) = list(run(iter([rows]))), list(run(rows[i : i + 100] for i in range(0, len(t), 100)))
    assert one.equals(many) and asked == [60, 60]
    w, bins, got = drawn(np.arange(3), t), forest.binned(x), one.to_pydict()
    cells = {key: (a, b) for *key, a, b in zip(*got.values(), strict=True) for key in [tuple(key)]}
    for tree in range(3):
        for f in np.flatnonzero(forest.tried(np.array(tree), np.array(1))):
            for k in range(forest.BINS):
                own = (bins[:, f] == k) & (t >= 5) & (t < 50)
                assert cells.get((tree, 1, f, k), (0, 0)) == (w[own, tree].sum(), (w[own, tree] * y[own]).sum())
