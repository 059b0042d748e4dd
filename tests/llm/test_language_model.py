"""The language model against brute force: seating laws, the whole posterior of a tiny corpus, scores of small texts."""

import itertools
import math

import numpy as np
import pytest

from panelwright.llm import language_model as model

D, S, PD, PS = model.DISCOUNT, model.STRENGTH, model.PARENT_DISCOUNT, model.PARENT_STRENGTH


def seatings(customers, discount):
    """S(c, t) for each t, by listing the ways to seat customers one after another."""
    found = {}

    def go(left, tables, weight):
        if not left:
            found[len(tables)] = found.get(len(tables), 0) + weight
            return
        go(left - 1, [*tables, 1], weight)
        for i, n in enumerate(tables):
            go(left - 1, [*tables[:i], n + 1, *tables[i + 1 :]], weight * (n - discount))

    go(customers, [], 1.0)
    return found


def rise(start, step, n):
    return math.prod(start + step * i for i in range(n))


def test_seating_numbers():
    table = model._stirling(0.75, 64)
    for c in range(1, 7):
        for t, x in seatings(c, 0.75).items():
            assert math.exp(table[c, t]) == pytest.approx(x)


@pytest.mark.parametrize("discount", [D, PD])
@pytest.mark.parametrize("pull", [0.01, 1.0, 40.0, 150.0, 600.0, 1e4, 1e6])
def test_many_customers_have_the_law_of_the_table(discount, pull):
    c = model.TABLED
    t, weight = model._many(c, pull, discount)
    full = model._stirling(discount, c)[c, 1:] + np.arange(1, c + 1) * math.log(pull)
    full = np.exp(full - full.max())
    got = np.zeros(c)
    got[t - 1] = np.exp(weight - weight.max())
    assert got / got.sum() == pytest.approx(full / full.sum(), abs=1e-9)


def test_more_customers_than_the_table_has():
    """The series and the integral against the recurrence of Stirling numbers, carried on to 4,000 customers."""
    c, t = 4000, np.arange(1, 4001)
    row = np.append(0.0, np.full(c, -np.inf))
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(1, c + 1):
            stay = np.log(np.maximum(k - 1 - D * t, 0)) + row[1:]
            row = np.append(-np.inf, np.logaddexp(row[:-1], np.where(t < k, stay, -np.inf)))
    for pull in (0.001, 1.0, 500.0, 1500.0, 3000.0, 1e5):
        at, weight = model._many(c, pull, D)
        full, got = np.exp(row[1:] + t * math.log(pull) - (row[1:] + t * math.log(pull)).max()), np.zeros(c)
        got[at - 1] = np.exp(weight - weight.max())
        assert got / got.sum() == pytest.approx(full / full.sum(), abs=1e-9)


def test_drawn_tables_have_their_law():
    rng = np.random.default_rng(1)
    for c, pull in ((2, 0.4), (7, 2.0), (70, 5.0), (model.TABLED, 30.0), (5000, 30.0)):
        n = 20_000 if c <= model.TABLED else 1000
        drawn = model.seat(rng, np.full(n, c), np.full(n, pull), D)
        t, weight = model._many(c, pull, D) if c > model.TABLED else (np.arange(1, c + 1), model._stirling(D, max(c, 64))[c, 1 : c + 1] + np.arange(1, c + 1) * math.log(pull))
        p = np.exp(weight - weight.max())
        p /= p.sum()
        mean = (p * t).sum()
        spread = math.sqrt((p * t * t).sum() - mean**2)
        assert drawn.mean() == pytest.approx(mean, abs=5 * spread / math.sqrt(n))


def test_unseated_mass_has_its_transform():
    rng = np.random.default_rng(3)
    for mass in (0.3, 2.6):
        x = model.tilted(rng, mass, PD, 100_000)
        assert np.exp(-x).mean() == pytest.approx(math.exp(-mass * (2**PD - 1)), abs=0.005)


def test_sweeps_sample_the_posterior():
    """Means of all tables over many sweeps are those of all seatings of a tiny corpus, listed one by one."""
    word, context, count = np.array([1, 1, 2, 2], np.uint64), np.array([0, 1, 0, 1]), np.array([4, 2, 3, 1])
    law = {c: seatings(c, D) for c in range(1, 5)}
    parent = {c: seatings(c, PD) for c in range(1, 8)}
    total, mean = 0.0, np.zeros(6)
    for t in itertools.product(*[range(1, c + 1) for c in count]):
        own = math.prod(law[c][k] for c, k in zip(count, t, strict=True)) * rise(S, D, t[0] + t[2]) * rise(S, D, t[1] + t[3])
        there = t[0] + t[1], t[2] + t[3]
        for k in itertools.product(*[range(1, n + 1) for n in there]):
            w = own * parent[there[0]][k[0]] * parent[there[1]][k[1]] * rise(PS, PD, sum(k)) / rise(PS, 1, sum(there)) / 3 ** sum(k)
            total += w
            mean += w * np.array([*t, *k])
    seating, sums = model.Seating(0, word, context, count), []
    for k in range(4000):
        x = seating.sums()
        seating.sweep(k, model.Totals(x[:2], x[2:4], x[4], int(x[5])))
        sums.append([*seating.tables, *seating.parent_tables])
    assert np.mean(sums[20:], axis=0) == pytest.approx(mean / total, abs=0.08)


def scored(spark, taught, asked):
    rows = [(i, t, False) for i, t in enumerate(taught)] + [(1000 + i, t, True) for i, t in enumerate(asked)]
    got = {r["doc_id"]: r["score"] for r in model.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    return [got[1000 + i] for i in range(len(asked))]


def test_scores_where_every_pair_occurs_once(spark):
    """All tables are certain then, and so are the scores."""
    taught = ["a b c"]
    seen = {("", "a"), ("a", "b"), ("b", "c"), ("c", "")}
    p = lambda w: ((1 - PD) * (w in ("a", "b", "c", "")) + (PS + 4 * PD) / 5) / (PS + 4)
    chance = lambda u, w: (((1 - D) if (u, w) in seen else 0) + (S + D) * p(w)) / (S + 1) if u != "x" else p(w)
    asked = ["A b C", "a c", "x", "c x a", "", "b"]
    for text, got in zip(asked, scored(spark, taught, asked), strict=True):
        tokens = [*text.lower().split(), ""]
        assert got == pytest.approx(sum(math.log10(chance(u, w)) for u, w in zip(["", *tokens], tokens, strict=False)), rel=1e-12)


def test_contexts_are_whole_words(spark):
    """Words before that end alike, or would share one of a few restaurants, keep their own followers."""
    names = [f"n{i}ab" for i in range(40)]
    taught = [f"{x} f{i}" for i, x in enumerate(names)] * 10
    right = scored(spark, taught, [f"{x} f{i}" for i, x in enumerate(names)])
    wrong = scored(spark, taught, [f"{x} f{(i + 1) % 40}" for i, x in enumerate(names)])
    assert min(right) > max(wrong) + 1


def test_tables_of_repeated_pairs_stay_in_their_bounds(spark):
    """P(a | a) of "a a a a" lies between its least and greatest value over all seatings."""
    got = scored(spark, ["a a a a"], ["a a", "a"])
    chances = []
    for t in range(1, 4):
        for k in range(1, t + 2):
            p = (t + 1 - PD * k + (PS + PD * (k + 1)) / 3) / (PS + t + 2)
            chances.append((3 - D * t + (S + D * (t + 1)) * p) / (S + 4))
    assert min(chances) <= 10 ** (got[0] - got[1]) <= max(chances)
