"""Archives and ledger files."""

from __future__ import annotations

import zipfile

import pytest

from panelwright.sources import archives, ledgers

HEAD = "game,draw_id,draw_date," + ",".join(f"n{i}" for i in range(1, 7)) + ",special\n"
COLUMNS = ["game", "draw_id", "draw_date", *[f"number_{i}" for i in range(1, 7)], "special_number"]


def test_archives(spark, tmp_path):
    game = "大樂透"
    with zipfile.ZipFile(tmp_path / "2020.zip", "w") as z:
        z.writestr(f"{game}_2020.csv", "﻿" + HEAD + f"{game},109000001,2020/01/03,6,5,4,3,2,1,7\n\n")
        z.writestr("other.csv", f"{game} as text\n")
        z.writestr(f"{game}_加開獎項_2020.csv", HEAD + f"{game},109000001,2020/01/03,9,9,9,9,9,9,9\n")
    with zipfile.ZipFile(tmp_path / "2021.zip", "w") as z:  # garbled names: the member is known by its first bytes
        z.writestr("x1.csv", (HEAD + f"{game},109000001,2020/01/03,1,2,3,4,5,6,8\n{game},110000001,2021/01/05,1,2,3,4,5\n").encode("cp950"))
        z.writestr("x2.csv", "another\n")
        z.writestr("x3.csv", f"about {game},\n")
    rows = archives.scan_archives(spark, str(tmp_path), game).orderBy("archive", "row").collect()
    assert [(r["archive"], r["row"], len(r["fields"]), r["fields"][1]) for r in rows] == [("2020", 0, 13, "109000001"), ("2021", 0, 13, "109000001"), ("2021", 1, 13, "110000001")]
    got = {r["draw_id"]: r for r in archives.import_archives(spark, str(tmp_path), game, COLUMNS, "official").collect()}
    assert sorted(got) == ["109000001", "110000001"]
    assert (got["109000001"]["special_number"], got["109000001"]["source_version"], got["109000001"]["number_1"]) == (8, "2021", 1)
    assert got["110000001"]["number_1"] is None


def test_an_archive_without_one_table_fails(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "2020.zip", "w") as z:
        z.writestr("a.csv", "nothing\n")
    with pytest.raises(Exception, match="one is needed"):
        archives.scan_archives(spark, str(tmp_path), "game").collect()


def test_ledger_files(spark, tmp_path):
    lines = ['{"a":1,"b":"x"}', "", "[1]", '{"b":1,"a":2}', '{"a":', '{"a":NaN}']
    (tmp_path / "l.jsonl").write_text("\n".join(lines) + "\n")
    got = ledgers.read_ledger(spark, str(tmp_path), "a int, b string", strict=False).collect()
    assert sorted((r["a"] or 0, r["fault"] or "") for r in got) == [(0, "blank"), (0, "not_canonical"), (0, "not_canonical"), (0, "not_json"), (0, "not_object"), (1, "")]
    with pytest.raises(Exception, match="ledger line is"):
        ledgers.read_ledger(spark, str(tmp_path), "a int, b string").count()
