"""Guards against looking ahead, digests of tables, numbered lines of files, histories that take a key once, order of dates."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.operators import binding, features, leakage, validation
from panelwright.sinks.tables import History, stored
from panelwright.sources import lines


def test_leaks_are_found_and_audited_features_have_none(draws):
    assert {r["leaked"] for r in leakage.leaks(features.audited, draws, 40).collect()} == {False}
    ahead = lambda d: features.audited(d).join(d.select(F.col("draw_index") - 1, F.element_at("numbers", 1).alias("next")).toDF("draw_index", "next"), "draw_index")
    found = {r["draw_index"]: r["leaked"] for r in leakage.leaks(ahead, draws, 40).collect()}
    assert not any(found[t] for t in range(39)) and (found[39] or found[40])
    mean = lambda d: d.withColumn("m", F.avg(F.element_at("numbers", 1)).over(Window.partitionBy())).drop("numbers", "special_number", "draw_date", "draw_id")
    assert all(r["leaked"] for r in leakage.leaks(mean, draws, 40).collect())
    got = {r["item"]: (r["periods"], r["leaked"], r["status"]) for r in leakage.checklist(draws, {"good": features.audited, "bad": mean}, 40).collect()}
    assert got == {"good": (41, 0, "PASS"), "bad": (41, 41, "FAIL")}


def test_leaks_are_found_inside_blocks(draws, monkeypatch):
    """F4 of round 4: both histories' features meet in their block; what looks at its own or the next period leaks at the cut, and nothing else does."""
    monkeypatch.setattr(features, "BLOCK", 16)
    changed = {r["draw_index"]: r["numbers"] for r in leakage.changed_from(draws, 40).collect()}
    bits = lambda sets: [sum(1 << n for n in s) for s in sets]
    before = [(r["draw_index"], r["numbers"]) for r in draws.collect()]
    table = pa.table({"draw_index": [i for i, _ in before], "bits": bits(s for _, s in before)})
    assert leakage.changed_periods(table, 40)["bits"].to_pylist() == bits(changed[i] for i, _ in before)
    assert all(changed[r["draw_index"]] == r["numbers"] for r in draws.collect() if r["draw_index"] < 40)

    def ahead(k):
        return {"next": np.vstack([k["y"][1:], k["y"][-1:]])}

    kind = (features.AUDITED_ALPHA, features.AUDITED_WINDOWS)
    of = lambda *names: lambda k: {c: features.audited_known(k, names)[c] for c in names}
    sets = {"good": leakage.InBlock(of("gap_asof", "z_ewma", "rate_100"), *kind), "own": leakage.InBlock(of("y"), *kind), "ahead": leakage.InBlock(ahead, *kind), "base": leakage.InBlock(lambda k: {c: features.base_known(k)[c] for c in features.BASE}, features.BASE_ALPHA, features.BASE_WINDOWS, 1)}
    got = {r["item"]: (r["periods"], r["leaked"], r["status"]) for r in leakage.block_checklist(draws, sets, 40).collect()}
    assert got == {"good": (41, 0, "PASS"), "own": (41, 1, "FAIL"), "ahead": (41, 2, "FAIL"), "base": (40, 0, "PASS")}
    assert got["good"] == tuple(leakage.checklist(draws, {"x": features.audited}, 40).first())[1:]


def test_history_must_lie_before_the_target(draws):
    leakage.assert_before(draws, "1", "2030-01-01", 80)
    for bad in (("100000005", "2030-01-01", 1), ("1", "2020-01-01", 1), ("1", "2030-01-01", 81)):
        with pytest.raises(ValueError):
            leakage.assert_before(draws, *bad)
    with pytest.raises(ValueError, match="before"):
        leakage.assert_before(draws.withColumn("draw_date", F.when(F.col("draw_index") > 0, F.col("draw_date"))), "1", "2030-01-01", 1)


def test_digests_are_of_multisets(spark):
    rows = [(k % 3, f"v{k % 7}", None if k % 5 == 0 else k % 4) for k in range(200)]
    make = lambda r: spark.createDataFrame(r, "part int, a string, b int").repartition(4)
    cols = [F.col("a"), F.col("b")]
    digest = lambda r: {x["part"]: tuple(x)[1:] for x in binding.digested(make(r), cols, "part").collect()}
    base = digest(rows)
    assert digest(random.Random(1).sample(rows, 200)) == base  # order
    assert all(digest(other) != base for other in (rows[1:], rows + rows[:1], [(0, "v1", None), *rows[1:]], [(0, "-", 0), *rows[1:]]))
    whole = {tuple(r) for r in binding.merged(binding.digested(make(rows), cols, "part")).collect()}
    assert whole == {tuple(r) for r in binding.digested(make(rows), cols).collect()}
    appended = binding.merged(binding.digested(make(rows[:150]), cols).union(binding.digested(make(rows[150:]), cols)))
    assert {tuple(r) for r in appended.collect()} == whole
    found = binding.digested(make([(1 if p == 0 else p + 1, a, b) for p, a, b in rows]), cols, "part")
    states = {r["part"]: r["state"] for r in binding.unbound(binding.digested(make(rows), cols, "part"), found, "part").collect()}
    assert states == {0: "lost", 1: "changed", 2: "changed", 3: "added"} or states == {0: "lost", 1: "changed", 3: "added", 2: "changed"}
    assert binding.unbound(binding.digested(make(rows), cols, "part"), binding.digested(make(rows), cols, "part"), "part").isEmpty()
    # fields are kept apart
    assert {r["first"] for r in binding.digested(spark.createDataFrame([("ab", "c")], "a string, b string"), cols).collect()} != {r["first"] for r in binding.digested(spark.createDataFrame([("a", "bc")], "a string, b string"), cols).collect()}


def test_sets_of_names(spark):
    names = lambda *v: spark.createDataFrame([(x,) for x in v], "name string")
    assert binding.set_difference(names("a", "b", "b"), names("b", "a"), "name").isEmpty()
    assert {tuple(r) for r in binding.set_difference(names("a", "b"), names("b", "c", "c"), "name").collect()} == {("a", "left"), ("c", "right")}


def test_history_takes_a_key_once(spark, tmp_path):
    h = History(spark, f"file://{tmp_path}/h", "key string, n long")
    rows = lambda key, *n: spark.createDataFrame([(key, x) for x in n], "key string, n long")
    assert h.read().count() == 0 and h.keys() == []
    assert h.add("b1", rows("b1", 1, 2)) and h.add("b2", rows("b2", 3))
    assert not h.add("b1", rows("b1", 9)) and sorted(r["n"] for r in h.read().collect()) == [1, 2, 3]
    # an attempt that wrote its part and was lost before the commit is not seen, and can be made again
    rows("b3", 7).write.parquet(f"{tmp_path}/h/parts/b3-lost")
    assert sorted(r["n"] for r in h.read().collect()) == [1, 2, 3]
    assert h.add("b3", rows("b3", 4)) and sorted(r["n"] for r in h.read().collect()) == [1, 2, 3, 4]
    assert h.keys() == ["b1", "b2", "b3"]
    assert [r["key"] for r in h.pending(rows("b3", 1).union(rows("b4", 1)), "key").collect()] == ["b4"]
    with pytest.raises(ValueError):
        h.add("../x", rows("x", 1))


def test_a_streaming_batch_that_runs_twice_is_added_once(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(5).selectExpr("cast(id as string) as key", "id as n").write.parquet(str(source))
    h = History(spark, f"file://{tmp_path}/h", "key string, n long")
    seen = []

    def twice(batch, number):
        seen.append([h.add(f"batch-{number}", batch), h.add(f"batch-{number}", batch)])

    stream = lambda: spark.readStream.schema("key string, n long").parquet(str(source)).writeStream.foreachBatch(twice)
    stream().option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    stream().option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()  # its progress was lost
    assert seen == [[True, False], [False, False]]
    assert sorted(r["n"] for r in h.read().collect()) == [0, 1, 2, 3, 4]


def test_stored_tables_keep_their_rows(spark):
    t = stored(spark.range(10).withColumn("x", F.lit(None).cast("string")), "test")
    assert t.count() == 10 and t.dtypes == [("id", "bigint"), ("x", "string")] and len(t.inputFiles()) > 0


HEAD = "﻿期別, 開獎日期 ,獎號1,獎號2,獎號3,獎號4,獎號5,獎號6,特別號"


def test_lines_are_numbered_over_splits_and_encodings(spark, tmp_path):
    text = [HEAD.lstrip("﻿")] + [f"{109000000 + k},2020/01/{1 + k % 28:02d},6,5,4,3,2,1,{7 + k % 40},彩券{k}" for k in range(3000)]
    (tmp_path / "a.csv").write_bytes("\n".join(text).encode("cp950"))
    (tmp_path / "b.csv").write_bytes(("﻿" + "\r\n".join(text[:1500])).encode("utf-8"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = lines.numbered_lines(spark, str(tmp_path)).collect()
        assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by = {(r["file"].rsplit("/", 1)[-1], r["line"]): r["value"] for r in got}
    assert len(got) == len(by) == 4501
    assert all(by["a.csv", k + 1] == x for k, x in enumerate(text)) and all(by["b.csv", k + 1] == x for k, x in enumerate(text[:1500]))
    table = lines.import_table(spark, str(tmp_path), "export", "1")
    first = table.where("draw_id = '109000003'").first()
    assert table.count() == 3000 and [first[f"number_{i}"] for i in range(1, 7)] == [1, 2, 3, 4, 5, 6] and first["draw_date"] == datetime.date(2020, 1, 4)


def test_line_faults_by_brute_force(spark, tmp_path):
    rng = random.Random(6)
    out, day = [], datetime.date(2020, 1, 1)
    for k in range(400):
        day += datetime.timedelta(3)
        row = [str(109000000 + k), day.isoformat(), *map(str, sorted(rng.sample(range(1, 49), 6))), "49"]
        kind = rng.randrange(12)
        if kind == 0:
            row[rng.randrange(2, 9)] = rng.choice(["0", "50", "x", "", row[2]])
        elif kind == 1:
            row[0] = rng.choice(["109000000", "x", row[0]])
        elif kind == 2:
            row[1] = rng.choice(["2020-13-01", "2020-1-1", "2019-01-01", row[1]])
        elif kind == 3:
            row = row[:5]
        out.append(row)
    names = ["draw_id", "draw_date", *[f"number_{i}" for i in range(1, 7)], "special_number"]
    body = [",".join(r) for r in out]
    body.insert(7, "")
    (tmp_path / "t.csv").write_text("\n".join([",".join(names), *body]) + "\n")
    want, seen, last = {}, set(), None
    for line, raw in enumerate(body, 2):
        if not raw:
            continue
        r = dict(zip(names, raw.split(","), strict=False))
        try:
            if len(r["draw_date"]) != 10:
                raise ValueError
            key = (datetime.date.fromisoformat(r["draw_date"]), int(r["draw_id"]))
            n, s = [int(r[f"number_{i}"]) for i in range(1, 7)], int(r["special_number"])
        except (ValueError, KeyError):
            key = None
        fault = None
        if r["draw_id"] in seen:
            fault = "duplicate_id"
        elif key is None:
            fault = "malformed"
        elif last is not None and key <= last:
            fault = "not_chronological"
        elif len(set(n)) != 6 or min(n) < 1 or max(n) > 49:
            fault = "invalid_numbers"
        elif not 1 <= s <= 49 or s in n:
            fault = "invalid_special"
        seen.add(r["draw_id"])
        last = key or last
        if fault:
            want[line] = fault
    rows = lines.table_of(lines.numbered_lines(spark, str(tmp_path / "t.csv")), names)
    assert {r["line"]: r["fault"] for r in lines.line_faults(rows).collect()} == want and len(set(want.values())) >= 4
    with pytest.raises(ValueError, match=f"line {min(want)}: {want[min(want)]}"):
        lines.validate_lines(rows)
    lines.validate_lines(rows.where(~F.col("line").isin(*want)))


@pytest.mark.parametrize("width", [65_536, 4])
def test_order_of_dates_over_missing_numbers(spark, monkeypatch, width):
    """Neighbours are those that the table has, however far apart their numbers are."""
    monkeypatch.setattr(validation, "RANGE", width)
    rng = random.Random(3)
    seq = sorted(rng.sample(range(200), 60)) + [10**7, 10**7 + 50]
    rows = [(s, datetime.date(2020, 1, 1) + datetime.timedelta(rng.randrange(50)) if rng.random() > 0.1 else None) for s in seq]
    got = {r["seq"] for r in validation._out_of_order(spark.createDataFrame(rows, "seq long, draw_date date").repartition(3)).collect()}
    assert got == {b[0] for a, b in zip(rows, rows[1:], strict=False) if a[1] and b[1] and b[1] < a[1]}
