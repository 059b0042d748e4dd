"""Recorded events, payloads, block bootstrap and binomial tails against plain Python."""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import special
from panelwright.operators import evidence, ledger, panel, resampling, validation


def test_results_corrections_and_repetitions(spark):
    rows = [(1, "a", 1), (2, "a", 1), (3, "a", 2), (4, "b", None), (5, "b", None), (6, "a", 1), (7, "b", 3)]
    e = spark.createDataFrame(rows, "event_id long, key string, body int")
    got = {r["event_id"]: r["kind"] for r in evidence.result_events(e, ["key"], "event_id", "body").collect()}
    assert got == {1: "result", 2: "repeated", 3: "correction", 4: "result", 5: "repeated", 6: "correction", 7: "correction"}


def test_lookup_anchor_stages_and_protocol(spark):
    schema = "ledger long, event_id long, k long, value double"
    p = spark.createDataFrame([(1, 1, 7, 0.0), (1, 2, 8, 0.0), (1, 3, 8, 0.0), (2, 20, 7, 0.0)], schema)
    r = spark.createDataFrame([(1, 10, 7, 0.0), (1, 11, 8, 0.0), (1, 12, 9, 0.0), (2, 13, 7, 0.0)], schema)
    found = {x["event_id"]: (x["lookup"], x["prediction"]) for x in evidence.with_prediction(r, p, ["ledger", "k"]).collect()}
    assert found == {10: ("found", 1), 11: ("ambiguous", None), 12: ("missing", None), 13: ("found", 20)}
    anchors = spark.createDataFrame([(1, 30, 7, 9.0), (1, 31, 7, 1.0), (2, 32, 8, 9.0)], schema)
    got = {x["event_id"]: x["anchor"] for x in evidence.with_anchor(p, anchors, ["ledger", "k"], F.col("value") > 5).collect()}
    assert got == {1: 30, 2: None, 3: None, 20: None}
    faults = {x["ledger"]: (x["repeated_predictions"], x["unpredicted_results"], x["early_results"], x["sound"]) for x in evidence.protocol(p, r, "ledger", ["ledger", "k"]).collect()}
    assert faults == {1: (1, 1, 0, False), 2: (0, 0, 1, False)}
    s = sorted((x["ledger"], x["stage"], x["n"], x["complete"]) for x in evidence.stages(r, "ledger", "event_id", 2).collect())
    assert s == [(1, 1, 2, True), (1, 2, 1, False), (2, 1, 1, False)]
    assert evidence.stages(r.limit(0), "ledger", "event_id").count() == 0


def test_payloads(spark):
    sound = {"status": "ANNOUNCED", "id": "5", "date": "2020-01-03", "numbers": [9, 1, 3, 7, 5, 11, 2]}
    cases = {
        None: sound,
        "not_announced": sound | {"status": "PENDING"},
        "other_draw": sound | {"id": "6"},
        "other_date": {k: v for k, v in sound.items() if k != "date"},
        "not_integers": sound | {"numbers": [9, 1, 3, 7, 5, 11, True]},
        "not_seven": sound | {"numbers": [9, 1, 3]},
        "out_of_range": sound | {"numbers": [9, 1, 3, 7, 5, 11, 50]},
        "repeated": sound | {"numbers": [9, 1, 3, 7, 5, 11, 11]},
    }
    rows = [(str(k), "5", json.dumps(v)) for k, v in cases.items()] + [("malformed", "5", "{"), ("malformed", "5", None)]
    rows += [("not_integers", "5", json.dumps(sound | {"numbers": n})) for n in ([9, 1, 3, 7, 5, 11, "2"], [9, 1, 3, 7, 5, 11, 2.5], None)]
    df = spark.createDataFrame(rows, "want string, draw_id string, payload string").withColumn("draw_date", F.lit("2020-01-03").cast("date"))
    for r in evidence.read_payloads(df).collect():
        assert str(r["fault"]) == r["want"]
        assert (r["numbers"], r["special_number"]) == (([1, 3, 5, 7, 9, 11], 2) if r["fault"] is None else (None, None))


def test_compared(spark):
    e = spark.createDataFrame([(1, 0.5), (2, 0.25), (3, None)], "k int, v double")
    a = spark.createDataFrame([(1, 0.5), (2, 0.5), (4, 1.0)], "k int, v double")
    assert tuple(evidence.compared(e, a, ["k"], "v").first()) == (2, 1, 1, 1, 0.25)
    assert tuple(evidence.compared(e.limit(0), a.limit(0), ["k"], "v").first()) == (0, 0, 0, 0, None)


@pytest.mark.parametrize("n", [20, 47, 4_096 + 33])
def test_block_bootstrap(spark, n):
    v = [(i * i) % 7 for i in range(n)]
    places, means = -(-n // 20), []
    for r in range(30):
        starts = [int(hashlib.md5(f"{r}:{j}".encode()).hexdigest()[:15], 16) % (n - 19) for j in range(places)]
        means.append(np.mean([x for s in starts for x in v[s : s + 20]][:n]))
    got = resampling.block_bootstrap(spark.createDataFrame(list(enumerate(v)), "position long, value int"), 30).first()
    assert tuple(got) == pytest.approx((n, np.mean(v), *np.percentile(means, [2.5, 97.5])))


def test_block_bootstrap_of_a_short_series(spark):
    assert resampling.block_bootstrap(spark.createDataFrame([(0, 1)], "position long, value int")).count() == 0


@pytest.mark.parametrize(("k", "n"), [(0, 10), (3, 10), (10, 10), (40, 300), (70, 300)])
def test_binomial_tails(k, n):
    p = 6 / 49
    m = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
    assert special.binomial_doubled(k, n, p) == pytest.approx(min(1, 2 * min(sum(m[: k + 1]), sum(m[k:]))))
    assert special.binomial_minimum_likelihood(k, n, p) == pytest.approx(min(1, sum(x for x in m if x <= m[k] * (1 + 1e-7))))
    low, high = special.clopper_pearson(k, n)
    upper = lambda q: sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k, n + 1))
    lower = lambda q: sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1))
    assert low == 0 if k == 0 else upper(low) == pytest.approx(0.025)
    assert high == 1 if k == n else lower(high) == pytest.approx(0.025)


def test_rolling_mean_over_ranges(spark):
    n = 8_192 + 60
    rows = [(i, [1, 2, 3, 4, 5, i % 40 + 6]) for i in range(n)]
    got = {r[0]: r[1] for r in panel.rolling_mean(spark.createDataFrame(rows, "draw_index long, numbers array<int>"), 50).collect()}
    totals = [sum(x) for _, x in rows]
    assert len(got) == n
    for i in (0, 48, 49, 8_190, 8_191, 8_192, 8_193, 8_240, n - 1):
        assert got[i] == (None if i < 49 else pytest.approx(np.mean(totals[i - 49 : i + 1])))


def test_missing_ids(spark):
    ids = ["107000001", "107000002", "107000005", "107000007", "107000007", "108000010", None, "x"]
    got = sorted(tuple(r) for r in validation.missing_ids(spark.createDataFrame([(i,) for i in ids], "draw_id string")).collect())
    assert got == [("107", 107000003), ("107", 107000004), ("107", 107000006)]
    far = spark.createDataFrame([("107000001",), ("1079999999",)], "draw_id string")
    with pytest.raises(Exception, match="too many to list"):
        validation.missing_ids(far).collect()


def test_chains_carry_the_hash_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i % 3, 1_000 - i, f"b{i}") for i in range(60)] + [(None, 1, "x")]
        c = ledger.chain(spark.createDataFrame(rows, "ledger long, event_id long, body string")).cache()
        assert c.count() == 60
        assert [tuple(r)[1:] for r in ledger.verify(c).orderBy("ledger").collect()] == [(20, 0, 0, 0, 0)] * 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
