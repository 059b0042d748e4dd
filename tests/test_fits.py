"""Many fits at once, variants of a fit, and permutation tests, against plain numpy."""

from __future__ import annotations

import datetime
import itertools
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions.adjust import projected, projected_rows
from panelwright.operators import features, fits, forest, models, permutation

P = len(fits.FEATURES)


def tiny(periods: int = 60, seed: int = 1) -> pd.DataFrame:
    """A panel with hits that follow the first two features."""
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(periods):
        x = rng.standard_normal((49, P))
        score = 0.9 * x[:, 0] - 0.5 * x[:, 1] + 0.02 * np.arange(49) + rng.gumbel(size=49)
        top = set(np.argsort(-score)[:6].tolist())
        rows += [(t, n + 1, int(n in top), *x[n]) for n in range(49)]
    return pd.DataFrame(rows, columns=["draw_index", "number", "y", *fits.FEATURES])


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(tiny()).repartition(3).withColumn("year", F.expr("2000 + draw_index div 7")).cache()


def gradient(rows: pd.DataFrame, fit: fits.Fit, coef: np.ndarray, effect: np.ndarray, weight: np.ndarray | float = 1.0) -> float:
    """The largest slope of a fit's objective at its coefficients, from its rows alone: 0 at the optimum, which is unique."""
    x, n = np.column_stack([np.ones(len(rows)), rows[list(fits.FEATURES)]]), rows["number"].to_numpy() - 1
    r = (rows["y"] - 1 / (1 + np.exp(-(x @ coef + effect[n])))) * weight
    g = x.T @ r - np.where(np.arange(P + 1) > 0, coef / fit.c, 0)
    used = [True, *(f not in fit.drop for f in fits.FEATURES)]
    own = np.bincount(n, r, minlength=49) - effect / fit.c if fit.number else np.zeros(1)
    return max(np.abs(g[used]).max(), np.abs(own).max())


def test_every_fit_is_at_its_own_optimum(panel):
    plan = [fits.Fit("a", 40), fits.Fit("b", 60, c=5.0), fits.Fit("c", 50, 10, c=0.01), fits.Fit("d", 60, drop=fits.FEATURES[1:3]), fits.Fit("e", 30, number=False), fits.Fit("f", 45, drop=fits.FEATURES, c=1.0)]
    got, rows = fits.fitted(panel, plan, steps=12), tiny()
    for k, f in enumerate(plan):
        own = rows[(rows.draw_index >= f.begin) & (rows.draw_index < f.end)]
        assert gradient(own, f, got.coef[k], got.effect[k]) < 1e-6
        assert not any(got.coef[k][1 + fits.FEATURES.index(c)] for c in f.drop)
        assert f.number or not got.effect[k].any()
    assert got.moved.max() < 1e-9
    # separate fits are the same
    for f, coef in zip(plan[:2], got.coef, strict=False):
        assert fits.fitted(panel, [f], steps=12).coef[0] == pytest.approx(coef, abs=1e-10)


def test_the_default_steps_come_near_even_where_features_tell_much(panel):
    few, many = fits.fitted(panel, [fits.Fit("a", 60)]), fits.fitted(panel, [fits.Fit("a", 60)], steps=12)
    assert few.moved[0] < 1e-3 and np.abs(few.coef - many.coef).max() < 1e-6


def test_ordinals_other_than_periods(panel):
    got = fits.fitted(panel, [fits.Fit(str(y), y) for y in (2003, 2006)], at="year", steps=12)
    rows = tiny()
    for k, y in enumerate((2003, 2006)):
        assert gradient(rows[2000 + rows.draw_index // 7 < y], got.fits[k], got.coef[k], got.effect[k]) < 1e-6


def test_fits_refuse_what_cannot_be_fitted(panel):
    for bad in ([], [fits.Fit("a", 9, c=0)], [fits.Fit("a", 9, number=False, drop=fits.FEATURES)], [fits.Fit("a", 9)] * (fits.MOST_FITS + 1)):
        with pytest.raises(ValueError):
            fits.fitted(panel, bad)
    with pytest.raises(ValueError):
        fits.refits(60, 60, 1)
    none = fits.fitted(panel.where("draw_index < 0"), [fits.Fit("a", 9)])
    assert none.coef[0][0] == pytest.approx(np.log(6 / 43)) and not none.coef[0][1:].any()


def test_every_period_is_scored_by_its_own_refit(panel):
    plan, blocks = fits.refits(40, 60, 7)
    assert [(f.end, f.begin) for f in plan] == [(40, 0), (47, 0), (54, 0)] and [b[2:] for b in blocks] == [(40, 47), (47, 54), (54, 60)]
    models = fits.fitted(panel, plan)
    got = fits.scored(panel, models, blocks).toPandas()
    assert len(got) == 20 * 49 and not got.duplicated(["draw_index", "number"]).any()
    rows = tiny().merge(got, on=["draw_index", "number"])
    x = np.column_stack([np.ones(len(rows)), rows[list(fits.FEATURES)]])
    which = (rows.draw_index.to_numpy() - 40) // 7
    assert (rows.block.astype(int) == 40 + 7 * which).all()
    want = 1 / (1 + np.exp(-((x * models.coef[which]).sum(1) + models.effect[which, rows.number - 1])))
    assert rows.p.to_numpy() == pytest.approx(want, abs=1e-12)
    # losses of each period
    lost = fits.losses(fits.scored(panel, models, blocks), "block").toPandas().set_index("draw_index")
    for t, own in rows.groupby("draw_index"):
        q = own.p.to_numpy()
        low, high = q.min() - 1, q.max()
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if np.clip(q - mid, 0, 1).sum() > 6 else (low, mid)
        q = np.clip(q - low, 0, 1) * 0.9 + 0.1 * 6 / 49
        y = own.y_x.to_numpy()
        assert lost.brier[t] == pytest.approx(((q - y) ** 2).mean(), abs=1e-9)
        assert lost.log_loss[t] == pytest.approx(-np.log(np.where(y == 1, q, 1 - q)).mean(), abs=1e-9)
        assert lost.hits_6[t] == y[np.lexsort((own.number, -np.round(q, 10)))[:6]].sum()


@pytest.fixture(scope="module")
def whole(panel):
    model = fits.fitted(panel, [fits.Fit("all", 60, number=False)], steps=12)
    return fits.period_sums(panel, model).cache(), model


def test_bootstrap_against_refits_of_copied_periods(panel, whole):
    sums, model = whole
    replicates = 40
    got = {r["variant"]: np.array(r["coef"]) for r in fits.stepped(fits.bootstrap_sums(sums, replicates), model).collect()}
    rows, limits = tiny(), fits.poisson_limits()
    spread = []
    for r in range(replicates):
        mixed = [(t * 7919 + r * 104_729) % 1_000_003 for t in range(60)]
        u = np.array([(m * m + (t % 1009 + 17) * (r * 31 + 7)) % 1_000_003 / 1_000_003 for t, m in enumerate(mixed)])
        count = (u[:, None] >= limits).sum(1)
        weight = count[rows.draw_index]
        coef = model.coef[0].copy()
        x = np.column_stack([np.ones(len(rows)), rows[list(fits.FEATURES)]])
        ridge = np.where(np.arange(P + 1) > 0, 1 / fits.C, 0)
        steps = []
        for _ in range(8):
            p = 1 / (1 + np.exp(-x @ coef))
            change = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ ((rows.y - p) * weight) - ridge * coef)
            coef = coef + change
            steps.append(coef)
        assert got[r] == pytest.approx(steps[0], abs=1e-9)  # the one step that is taken
        spread.append(np.abs(got[r] - steps[-1]).max())
    assert np.median(spread) < 0.02 < np.std([c[1] for c in got.values()])  # far nearer to the refit than replicates are to each other


def test_bootstrap_counts_follow_their_law(spark):
    t = spark.range(3000).selectExpr("id as draw_index", *[f"1.0D as {c}" for c in fits.SUMS])
    totals = np.array([r["g0"] for r in fits.bootstrap_sums(t, 400).collect()])
    assert abs(totals.mean() - 3000) < 15 and 40 < totals.std() < 70  # a Poisson total's deviation is 54.8


def test_deletions_against_sums_of_what_is_left(whole):
    sums, _ = whole
    rows = sums.toPandas().set_index("draw_index").sort_index()
    got = fits.deletion_sums(sums, 5, 4).toPandas().set_index("variant")
    assert sorted(got.index) == [-4, -3, -2, -1, 1, 2, 3, 4, 5]
    for v, r in got.iterrows():
        left = rows.iloc[:-v] if v > 0 else rows[(np.arange(60) * 4 // 60) != -1 - v]
        assert r[fits.SUMS].to_numpy(float) == pytest.approx(left[fits.SUMS].sum().to_numpy(), abs=1e-8)


def test_recommendations(spark):
    following = spark.createDataFrame([(n, *[float((n * k) % 11) for k in range(1, P + 1)]) for n in range(1, 50)], ["number", *fits.FEATURES])
    coefs = [(0, [0.0] * (P + 1)), (1, [5.0, 1.0] + [0.0] * (P - 1)), (2, [0.0] + [(-1.0) ** k * k for k in range(P)])]
    got = {r["variant"]: r["picked"] for r in fits.recommended(spark.createDataFrame(coefs, "variant long, coef array<double>"), following).collect()}
    for v, c in coefs:
        score = {n: sum(a * ((n * k) % 11) for k, a in enumerate(c[1:], 1)) for n in range(1, 50)}
        assert got[v] == sorted(sorted(score, key=lambda n: (-score[n], n))[:6])


def test_multipliers_permute_every_length():
    for n in (1, 2, 7, 100, 1023, 2047, 2048):
        for a in permutation.MULTIPLIERS[:5]:
            assert len({(a * i + 12345) % n for i in range(n)}) == n


def test_permuted_hits_and_step_down_by_brute_force(spark):
    rng = np.random.default_rng(2)
    n, models, runs = permutation.BLOCK + 300, 3, 30
    outcome = np.array([sum(1 << int(x) for x in rng.choice(np.arange(1, 50), 6, replace=False)) for _ in range(n)])
    masks = np.array([[sum(1 << int(x) for x in rng.choice(np.arange(1, 50), 6, replace=False)) for _ in range(models)] for _ in range(n)])
    masks[::3, 1] = outcome[::3]  # the second model knows a third of the outcomes
    rows = spark.createDataFrame([(i, int(o), [int(m) for m in row]) for i, (o, row) in enumerate(zip(outcome, masks, strict=True))], "place long, outcome long, masks array<long>").repartition(5)
    hits = permutation.permuted_hits(rows, runs).cache()
    got = {(r["replicate"], r["k"]): r["hits"] for r in hits.collect()}
    want = Counter()
    for r, (i, row) in itertools.product(range(runs + 1), enumerate(masks)):
        block, place = divmod(i, permutation.BLOCK)
        length = min(permutation.BLOCK, n - block * permutation.BLOCK)
        to = (permutation.MULTIPLIERS[(r * 31 + block) % len(permutation.MULTIPLIERS)] * place + r * 7919 + block * 104_729) % length if r else place
        for k in range(models):
            want[r, k] += (int(row[k]) & int(outcome[block * permutation.BLOCK + to])).bit_count()
    assert got == dict(want)
    order = sorted(range(models), key=lambda k: (-want[0, k], k))
    family, least = {}, 0.0
    for j, k in enumerate(order):
        reach = sum(max(want[r, m] for m in order[j:]) >= want[0, k] for r in range(1, runs + 1))
        least = family[k] = max(least, (1 + reach) / (runs + 1))
    for r in permutation.step_down(hits).collect():
        assert r["hits"] == want[0, r["k"]] and r["family_p"] == pytest.approx(family[r["k"]])
        assert r["raw_p"] == pytest.approx((1 + sum(want[i, r["k"]] >= want[0, r["k"]] for i in range(1, runs + 1))) / (runs + 1))
    assert family[1] == pytest.approx(1 / (runs + 1))


def test_masks(spark):
    got = spark.createDataFrame([([1, 49, 6],), ([],)], "n array<int>").select(permutation.mask(F.col("n")).alias("m")).collect()
    assert [r["m"] for r in got] == [(1 << 1) + (1 << 49) + (1 << 6), 0]


def brute_tree(rows: pd.DataFrame, tree: int, f: forest.Forest) -> dict[int, tuple]:
    """Splits of one tree by trying every feature and bin of every node."""
    bins, y = forest.binned(rows[list(fits.FEATURES)].to_numpy()), rows.y.to_numpy()
    period = rows.draw_index.to_numpy()
    w = forest.weights(np.array([tree]), period)[:, 0] * np.where(y == 1, 43 / 6 if f.balanced else 1.0, 1.0)
    w = np.where((period >= f.begin) & (period < f.end), w, 0.0)
    out, waiting = {}, [(1, w > 0, 0)]
    while waiting:
        node, own, level = waiting.pop()
        best = None
        if level < f.depth:
            for x in np.flatnonzero(forest.tried(np.array(tree), np.array(node))):
                for edge in np.unique(bins[own, x]):
                    left, right = own & (bins[:, x] <= edge), own & (bins[:, x] > edge)
                    a, b = w[left].sum(), w[right].sum()
                    if a >= f.leaf and b >= f.leaf and b > 0:
                        ha, hb = (w * y)[left].sum(), (w * y)[right].sum()
                        gain = round(ha * ha / a + hb * hb / b - (ha + hb) ** 2 / (a + b), 9)
                        if gain > 0 and (best is None or (-gain, x, edge) < best[0]):
                            best = ((-gain, x, edge), left, right)
        if best is None:
            out[node] = ("leaf", (w * y)[own].sum() / w[own].sum())
        else:
            out[node] = (int(best[0][1]), int(best[0][2]))
            waiting += [(2 * node, best[1], level + 1), (2 * node + 1, best[2], level + 1)]
    return out


def test_forest_against_a_search_of_all_splits(panel):
    plan = [forest.Forest("a", 40, trees=3, depth=3, leaf=30), forest.Forest("b", 60, 10, trees=2, depth=2, leaf=10, balanced=True)]
    got, rows = forest.grown(panel, plan), tiny()
    for tree, o in enumerate(got.owner):
        for node, want in brute_tree(rows, tree, plan[o]).items():
            if want[0] == "leaf":
                assert got.feature[tree, node] == -1 and got.rate[tree, node] == pytest.approx(want[1], abs=1e-9)
            else:
                assert (got.feature[tree, node], got.edge[tree, node]) == want
    p = forest.scored(panel, got, [("x", "a", 40, 60), ("y", "b", 50, 55)]).toPandas()
    assert Counter(p.block) == {"x": 20 * 49, "y": 5 * 49}
    for name, o in (("x", 0), ("y", 1)):
        own = rows.merge(p[p.block == name], on=["draw_index", "number"])
        bins = forest.binned(own[list(fits.FEATURES)].to_numpy())
        for k in range(0, len(own), 37):
            rates = []
            for tree in np.flatnonzero(got.owner == o):
                node = 1
                while got.feature[tree, node] >= 0:
                    node = 2 * node + int(bins[k, got.feature[tree, node]] > got.edge[tree, node])
                rates.append(got.rate[tree, node])
            assert own.p[k] == pytest.approx(np.mean(rates))
    held = rows.merge(p[p.block == "x"], on=["draw_index", "number"])
    assert ((held.p - held.y_x) ** 2).mean() < 6 / 49 * 43 / 49  # it learns


def test_a_forest_without_rows_is_uniform(panel):
    none = forest.grown(panel.where("draw_index < 0"), [forest.Forest("a", 9, trees=2)])
    assert set(forest.scored(panel.where("draw_index = 3"), none, [("x", "a", 0, 9)]).toPandas().p) == {6 / 49}


def test_a_period_has_one_weight_in_a_tree():
    w = forest.weights(np.arange(200), np.arange(500))
    assert w.shape == (500, 200) and abs(w.mean() - 1) < 0.02 and 0.9 < w.var() < 1.1
    assert (forest.tried(np.arange(50)[:, None], np.arange(1, 64)[None, :]).sum(-1) == forest.TRIED).all()


def test_packed_blocks_give_what_the_written_panel_gives(spark, monkeypatch):
    """Fits, losses, sums of ranges and replicates from blocks, against the panel's rows; no row of the panel is made."""
    monkeypatch.setattr(features, "BLOCK", 128)
    start, rng = 5, np.random.default_rng(4)
    draws = spark.createDataFrame([(i, sorted(int(x) + 1 for x in rng.choice(49, 6, replace=False)), datetime.date(2020, 1, 1) + datetime.timedelta(3 * i)) for i in range(300)], "draw_index long, numbers array<int>, draw_date date").repartition(3)
    rows = features.audited(draws, only=("draw_index", "number", "y", *fits.FEATURES), start=start).join(draws.select("draw_index", F.year("draw_date").alias("year")), "draw_index").cache()
    blocks = features.packed(draws)
    assert blocks.table.count() == 3
    plan = [fits.Fit("a", 150), fits.Fit("b", 270, c=3.0), fits.Fit("c", 260, 20, drop=fits.FEATURES[:2]), fits.Fit("d", 300, number=False)]
    want, got = fits.fitted(rows, plan), fits.fitted(blocks, plan, start=start)
    assert got.coef == pytest.approx(want.coef, abs=1e-10) and got.effect == pytest.approx(want.effect, abs=1e-10)
    years = [fits.Fit(str(y), y) for y in (2020, 2021)]
    assert fits.fitted(blocks, years, at="year", start=start).coef == pytest.approx(fits.fitted(rows, years, at="year").coef, abs=1e-10)
    spans = [("x", "a", 150, 300), ("y", "b", 30, 271)]
    table = lambda df: {(r["block"], r["draw_index"]): (r["hits_6"], r["brier"], r["log_loss"]) for r in df.collect()}
    lost, again = table(fits.losses(fits.scored(rows, want, spans), "block")), table(fits.block_losses(blocks, got, spans, start))
    assert lost.keys() == again.keys() and all(again[k] == pytest.approx(v, abs=1e-10) for k, v in lost.items())
    moved = lambda df: {r["number"]: (r["n"], r["brier"], r["log_loss"]) for r in df.collect()}
    a, b = moved(models.online(features.audited(draws, only=("draw_index", "number", "y", *fits.FEATURES)))), moved(models.online_blocks(blocks))
    assert len(a) == 49 and a.keys() == b.keys() and all(b[k] == pytest.approx(v, abs=1e-10) for k, v in a.items())
    one = fits.fitted(blocks, plan[3:], start=start)
    sums = fits.period_sums(rows, one)
    by_variant = lambda df: {r["variant"]: np.array(r[1:]) for r in df.select("variant", *fits.SUMS).collect()}
    for a, b in ((fits.deletion_sums(sums, 4, 3), fits.deletion_sums(fits.range_sums(blocks, one, 4, 3, start), 4, 3)), (fits.bootstrap_sums(sums, 50), fits.block_bootstrap_sums(blocks, one, 50, start))):
        a, b = by_variant(a), by_variant(b)
        assert a.keys() == b.keys() and all(b[k] == pytest.approx(v, abs=1e-8) for k, v in a.items())


def test_packed_blocks_grow_the_trees_of_the_written_panel(spark, monkeypatch):
    """F1 of round 4: splits, rates and losses of forests from blocks, against the panel's rows; some nodes are leaves."""
    monkeypatch.setattr(features, "BLOCK", 128)
    start, rng = 5, np.random.default_rng(6)
    draws = spark.createDataFrame([(i, sorted(int(x) + 1 for x in rng.choice(49, 6, replace=False))) for i in range(300)], "draw_index long, numbers array<int>").repartition(3)
    rows = features.audited(draws, only=("draw_index", "number", "y", *fits.FEATURES), start=start).cache()
    blocks = features.packed(draws)
    plan = [forest.Forest("a", 200, trees=4, depth=5, leaf=900), forest.Forest("b", 260, 20, trees=3, depth=3, leaf=10, balanced=True)]
    want, got = forest.grown(rows, plan), forest.grown(blocks, plan, start)
    assert (want.feature == got.feature).all() and (want.edge == got.edge).all() and got.rate == pytest.approx(want.rate)
    assert (got.feature[:4, 4:32] < 0).any() and (got.feature[:4, 4:32] >= 0).any()
    spans = [("x", "a", 200, 300), ("y", "b", 230, 290)]
    table = lambda df: {(r["block"], r["draw_index"]): (r["hits_6"], r["brier"], r["log_loss"]) for r in df.collect()}
    lost, again = table(fits.losses(forest.scored(rows, want, spans), "block")), table(forest.block_losses(blocks, got, spans, start))
    assert len(lost) == 160 and lost.keys() == again.keys() and all(again[k] == pytest.approx(v, abs=1e-10) for k, v in lost.items())


def test_projection_of_rows_is_that_of_arrays(spark):
    v = np.random.default_rng(3).normal(size=(40, 49)) * np.repeat([0.01, 1, 30, 0], 10)[:, None]
    want = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "i int, v array<double>").select("i", projected(F.col("v")).alias("p")).collect()
    got = projected_rows(v)
    assert all(got[r["i"]] == pytest.approx(r["p"], abs=1e-12) for r in want) and got.sum(1) == pytest.approx(6)
