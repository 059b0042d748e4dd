"""Streams give what batches give, also after a restart from the checkpoint."""

from __future__ import annotations

import pytest

from panelwright.operators import features, ledger, panel
from panelwright.streaming import draws as stream


def test_number_state_equals_batch(spark, draws, tmp_path):
    p = panel.panel(draws).select("draw_index", "number", "y")
    schema, got = p.schema, {}
    with_next = draws.select("draw_index", "numbers").union(spark.createDataFrame([(80, [])], "draw_index long, numbers array<int>"))
    want = {r["number"]: r for r in features.history(with_next, 0.06).where("draw_index = 80").collect()}

    def keep(batch, _):
        got.update({r["number"]: r for r in batch.collect()})

    for k, part in enumerate(("draw_index < 30", "draw_index between 30 and 79", "draw_index = 12")):  # the last comes late
        p.where(part).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        q = stream.number_state(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        if k == 1:
            for n, r in got.items():
                assert (r["next"], r["count"], r["late"]) == (80, want[n]["count_before"], 0)
                assert r["ewma"] == pytest.approx(want[n]["ewma"], abs=1e-12)
    assert all(r["late"] == 1 and r["count"] == want[n]["count_before"] for n, r in got.items())


def test_keep_latest(spark, tmp_path):
    rows = spark.range(200).selectExpr("id % 7 as k", "id as seq", "id * 3 as v").repartition(4)
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.keep_latest(source, "k", "seq", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = ledger.latest(spark.read.parquet(str(tmp_path / "out") + "/*"), "k", "seq").collect()
    assert {r["k"]: r["v"] for r in got} == {k: max(i for i in range(200) if i % 7 == k) * 3 for k in range(7)}


def test_ledger_faults(spark):
    events = spark.createDataFrame([(1, i, f"e{i}") for i in range(10)] + [(2, 100 + i, "x") for i in range(3)], "ledger long, event_id long, body string")
    c = ledger.chain(events)
    faults = lambda df: {r["ledger"]: tuple(r)[1:] for r in ledger.verify(df).collect()}
    assert faults(c) == {1: (10, 0, 0, 0, 0), 2: (3, 0, 0, 0, 0)}
    assert faults(c.withColumn("body", c.body.substr(1, 1)))[1][3] == 10
    assert faults(c.where("sequence <> 4"))[1][:3] == (9, 6, 1)
