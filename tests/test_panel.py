"""Panel, validation and features against plain Python on a small table."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.functions import adjust, special
from panelwright.operators import features, panel, randomness, strategies, validation
from panelwright.sources.draws import numbered, subset, wide


def matrix(draws) -> np.ndarray:
    out = np.zeros((80, 49), int)
    for r in draws.collect():
        out[r["draw_index"], np.array(r["numbers"]) - 1] = 1
    return out


def test_panel_is_dense(draws):
    p = panel.panel(draws)
    assert p.count() == 80 * 49
    assert p.agg(F.sum("y")).first()[0] == 80 * 6


def test_gap_statistics(draws):
    y = matrix(draws)
    for r in panel.gap_statistics(draws).collect():
        at = np.flatnonzero(y[:, r["number"] - 1])
        assert r["count"] == len(at)
        if len(at):
            closed = np.diff(at)
            assert (r["current_gap"], r["last_index"]) == (79 - at[-1], at[-1])
            assert r["max_gap"] == max([at[0], 79 - at[-1], *closed])
            assert r["mean_gap"] == (pytest.approx(closed.mean()) if len(closed) else None)
        else:
            assert (r["current_gap"], r["max_gap"], r["mean_gap"], r["last_index"]) == (80, 80, None, -1)


def test_empty_table_has_all_numbers(draws):
    got = panel.gap_statistics(draws.limit(0)).collect()
    assert len(got) == 49
    assert all((r["count"], r["max_gap"], r["last_index"]) == (0, 0, -1) for r in got)


def test_features_follow_the_recursion(draws):
    y = matrix(draws)
    e = np.full(49, 6 / 49)
    got = {(r["draw_index"], r["number"]): r for r in features.audited(draws).collect()}
    for t in range(80):
        for n in range(49):
            r = got[t, n + 1]
            assert r["ewma"] == pytest.approx(e[n], abs=1e-12)
            assert r["rate_20"] == pytest.approx(y[max(0, t - 20) : t, n].mean() if t else 0)
            assert r["long_rate"] == pytest.approx((y[:t, n].sum() + 12 * 6 / 49) / (t + 12))
        e = 0.06 * y[t] + 0.94 * e


def test_the_future_changes_nothing(draws):
    changed = draws.withColumn("numbers", F.when(F.col("draw_index") >= 60, F.array(*[F.lit(i) for i in range(1, 7)])).otherwise(F.col("numbers")))
    cols = [c for c in features.audited(draws).columns if c != "y"]
    a, b = (features.audited(d).where("draw_index <= 60").select(cols).sort("draw_index", "number").collect() for d in (draws, changed))
    assert a == b


def test_validation_finds_injected_defects(draws):
    good = wide(draws).withColumn("seq", F.col("draw_index"))
    validation.validate(good)
    bad = good.withColumn("number_1", F.when(F.col("seq") == 3, 50).otherwise(F.col("number_1"))).withColumn("special_number", F.when(F.col("seq") == 4, F.col("number_2")).otherwise(F.col("special_number"))).where("seq <> 7")
    got = {r["code"]: (r["severity"], r["n_rows"]) for r in validation.issues(bad).collect()}
    assert got == {"main_out_of_range": ("error", 1), "not_ascending": ("error", 1), "special_repeated": ("error", 1), "missing_draw_ids": ("warning", 1)}
    with pytest.raises(ValueError, match="main_out_of_range"):
        validation.validate(bad)
    with pytest.raises(ValueError, match="no rows"):
        validation.validate(good.limit(0))


def test_cooccurrence_covers_all_subsets(draws):
    pairs = panel.cooccurrence(draws, 2)
    assert pairs.count() == math.comb(49, 2)
    assert pairs.agg(F.sum("count")).first()[0] == 80 * math.comb(6, 2)


def test_runs_and_autocorrelation(draws):
    y = matrix(draws)
    for r in randomness.number_tests(draws).collect():
        v = y[:, r["number"] - 1]
        if 0 < v.sum() < 80:
            assert r["runs"] == 1 + (np.diff(v) != 0).sum()
            assert r["autocorrelation"] == pytest.approx(np.corrcoef(v[1:], v[:-1])[0, 1])


def test_uniform_losses_have_closed_form(draws):
    rows = strategies.scored(draws, 60).where("strategy = 'uniform_random'")
    got = strategies.per_period(rows).collect()
    assert len(got) == 20
    assert all(r["brier"] == pytest.approx(6 / 49 * 43 / 49) for r in got)


@pytest.mark.parametrize("ranges", [None, 1, 2, 7, 64, 5000])
def test_numbering_in_ranges(spark, ranges):
    """Keys in no order, with a dense and a thin part; thousands of ranges are no deeper a plan than a few."""
    keys = [(k * 7919) % 10_007 if k % 3 else -(k**2) for k in range(6000)]
    keys = sorted(set(keys), key=lambda k: (k * 31) % 977)
    got = numbered(spark.createDataFrame([(k,) for k in keys], "k long"), "k", ranges=ranges).collect()
    assert sorted((r["draw_index"], r["k"]) for r in got) == list(enumerate(sorted(keys)))
    assert numbered(spark.createDataFrame([], "k long"), "k", ranges=ranges).count() == 0


def test_tails():
    assert special.chi_square_sf(34.3585434, 48) == pytest.approx(0.93079, abs=1e-4)
    x = 7.3
    assert special.chi_square_sf(x, 6) == pytest.approx(math.exp(-x / 2) * (1 + x / 2 + x * x / 8))
    assert special.chi_square_sf(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)))
    assert special.student_two_sided(1.0, 1) == pytest.approx(0.5)
    assert special.binomial_sf(3, 10, 0.3) == pytest.approx(sum(math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(4, 11)))
    assert special.clopper_pearson(0, 10)[0] == 0
    assert special.clopper_pearson(5, 10)[0] == pytest.approx(0.18708603, abs=1e-7)


def test_minimum_likelihood_against_enumeration():
    for n, p in ((20, 0.3), (15, 6 / 49)):
        law = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
        for k in range(n + 1):
            assert special.binomial_minimum_likelihood(k, n, p) == pytest.approx(min(1.0, sum(x for x in law if x <= law[k] * (1 + 1e-7))), abs=1e-9)


@pytest.mark.parametrize("values", [np.linspace(-3, 8, 49), np.array([1e9] + [-1e9] * 48), np.zeros(49)])
def test_projection(spark, values):
    df = spark.createDataFrame([(values.tolist(),)], "v array<double>")
    p = np.array(df.select(adjust.projected(df["v"]).alias("p")).first()["p"])
    assert p.sum() == pytest.approx(6)
    assert ((p >= 0) & (p <= 1)).all()
    # the nearest point: one shift for all entries strictly inside, entries at 0 lie below it and entries at 1 above
    inner = (p > 0) & (p < 1)
    shift = (values - p)[inner]
    assert np.ptp(shift) <= 1e-9 if inner.any() else True
    if inner.any():
        assert (values[p == 0] <= shift[0] + 1e-9).all() and (values[p == 1] >= shift[0] + 1 - 1e-9).all()


def test_history_in_blocks(spark, monkeypatch):
    """Blocks much shorter than the history give what one pass over it does."""
    monkeypatch.setattr(features, "BLOCK", 32)
    rng = np.random.default_rng(4)
    sets = [sorted(rng.choice(np.arange(1, 13), 6, replace=False).tolist()) + ([] if i % 7 else [49]) for i in range(150)]
    got = {(r["draw_index"], r["number"]): r for r in features.history(spark.createDataFrame(list(enumerate(sets)), "draw_index long, numbers array<int>").repartition(3), 0.5, rates=(5, 20), sums=(10,)).collect()}
    assert len(got) == 150 * 49
    for n in (1, 7, 12, 20, 49):
        y = [int(n in s) for s in sets]
        ewma, step, last = 6 / 49, 0, None
        for t in range(150):
            r = got[t, n]
            now = y[t - 1] if t else 0
            after = [i for i in range(1, t) if y[i - 1] == now]
            assert (r["y"], r["count_before"], r["gap_asof"], r["last_seen"], r["max_step"]) == (y[t], sum(y[:t]), t if last is None else t - 1 - last, last, step)
            assert (r["n_from"], r["n_to"]) == (len(after), sum(y[i] for i in after))
            assert r["ewma"] == pytest.approx(ewma, abs=1e-9)
            assert r["rate_20"] == pytest.approx(np.mean(y[max(0, t - 20) : t]) if t else 0) and r["sum_10"] == sum(y[max(0, t - 10) : t])
            assert r["first_seen"] == (y.index(1) if 1 in y[:t] else None) and r["state"] == (y[t - 1] if t else None)
            if y[t]:
                step, last = max(step, t if last is None else t - last), t
            ewma = 0.5 * y[t] + 0.5 * ewma


def test_corrections(spark):
    df = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.5,)], "p double")
    got = adjust.adjusted(df).orderBy("p").collect()
    assert [round(r["holm"], 6) for r in got] == [0.04, 0.06, 0.06, 0.5]
    assert [round(r["bh"], 6) for r in got] == [0.04, 0.04, 0.04, 0.5]
    assert [round(r["bonferroni"], 6) for r in got] == [0.04, 0.08, 0.12, 1.0]


def test_sets_of_large_keys(spark):
    """Keys whose hashes pass 64 bits as products give the sets of whole-number arithmetic."""
    keys = [0, 1, 17, 900_000 * 2_654_435 + 97, 54_000_000 * 2_654_435 + 97]
    got = spark.createDataFrame([(k,) for k in [*keys, None]], "k long").select("k", subset(F.col("k"), 7).alias("s")).collect()
    for r in got:
        want = r["k"] is not None and sorted(range(1, 50), key=lambda n: (((r["k"] * 7919 + n * 104729) * (n * 31 + r["k"] % 1009 + 17)) % 1000003, n))[:7]
        assert r["s"] == (want or None)


def test_ranks_share_ties():
    x = np.array([[3, 1, 3, 2], [5, 5, 5, 5], [4, 3, 2, 1]])
    assert strategies.percent_rank_average(x).tolist() == [[0.875, 0.25, 0.875, 0.5], [0.625] * 4, [1.0, 0.75, 0.5, 0.25]]


def test_history_does_not_sort_the_panel(spark, draws):
    """Rows for each number are made once, of blocks: no exchange, sort or window takes them in."""
    plan = strategies.periods(draws, 60)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(h" not in plan and "percent_rank" not in plan and "FlatMapCoGroupsInArrow" in plan
    both = strategies.periods(draws, 60, against="frequency_random").collect()
    base = {r["draw_index"]: r for r in both if r["strategy"] == "frequency_random"}
    assert all((r["hits_0"], r["brier_0"]) == (base[r["draw_index"]]["hits_6"], base[r["draw_index"]]["brier"]) for r in both)


def test_gaps_lags_and_followers_over_short_blocks(spark, monkeypatch):
    """Counts made inside blocks, where numbers stay away for several blocks, against one pass; the plans sort no hits."""
    monkeypatch.setattr(features, "BLOCK", 16)
    rng = random.Random(7)
    sets = [sorted(rng.sample(range(1, 12 if 20 < t < 75 else 48), 6)) for t in range(100)]
    d = spark.createDataFrame(list(enumerate(sets)), "draw_index long, numbers array<int>").repartition(3)
    got = {r["number"]: r for r in panel.gap_statistics(d).collect()}
    for n in range(1, 50):
        at = [t for t, s in enumerate(sets) if n in s]
        gaps = [b - a for a, b in zip(at, at[1:], strict=False)]
        r, current = got[n], 99 - at[-1] if at else 100
        assert (r["count"], r["current_gap"], r["max_gap"], r["last_index"]) == (len(at), current, max([*gaps, current, *at[:1]]), at[-1] if at else -1)
        assert r["mean_gap"] == (pytest.approx(sum(gaps) / len(gaps)) if gaps else None)
    lagged = {(r["number"], r["lag"]): r["both"] for r in features.lagged_hits(d, 10).collect()}
    want = {(n, k): c for n in range(1, 50) for k in range(1, 11) if (c := sum(n in sets[t] and n in sets[t - k] for t in range(k, 100)))}
    assert lagged == want
    followed = {(r["a"], r["b"]): r["n11"] for r in features.followed_hits(d).collect()}
    assert followed == {(a, b): c for a in range(1, 50) for b in range(a + 1, 50) if (c := sum(a in x and b in y for x, y in zip(sets, sets[1:], strict=False)))}
    for df in (panel.gap_statistics(d), features.lagged_hits(d, 10), features.followed_hits(d)):
        assert "Generate explode(numbers" not in df._jdf.queryExecution().toString()


def test_tops_and_counts_by_hand():
    p = np.tile(np.arange(49, 0, -1) / 100.0, (3, 1))
    p[1] = 0.2
    y = np.zeros((3, 49), np.int64)
    y[:, [0, 7, 40]] = 1
    got = pa.table(strategies.tops_and_counts(p, y, (6, 10))).to_pylist()
    assert got[-1] == {"q": None, "n": 3, "k": 0, "hits_6": 3, "hits_10": 6}
    assert {(r["q"], r["n"], r["k"]) for r in got[:-1] if r["k"]} == {(0.49, 2, 2), (0.42, 2, 2), (0.09, 2, 2), (0.2, 51, 3)} and sum(r["n"] for r in got[:-1]) == 147
