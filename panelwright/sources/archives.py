"""Yearly ZIP archives of draw tables in legacy encodings, scanned as rows of text."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings that are tried in turn, bytes of a member that are looked at for the game's name, and columns that are read.
ENCODINGS, SNIFFED, WIDTH = ("utf-8-sig", "utf-8", "cp950"), 2_048, 13
#: What names of the tables of extra prizes hold; they lie beside the main tables.
EXTRA = "加開獎項"


def decoded(raw: bytes, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """``raw`` by the first encoding that takes all of it; ValueError if none does."""
    for e in encodings:
        try:
            return raw.decode(e)
        except UnicodeDecodeError:
            continue
    raise ValueError(f"not text in any of {', '.join(encodings)}")


def member_of(archive: zipfile.ZipFile, game: str, extra: str = EXTRA) -> str:
    """The one CSV member whose name begins with ``game`` and an underscore and does not hold ``extra``, the mark of the table of extra prizes.

    Where names are garbled and none does: the one with a line that begins with ``game`` as its first field in the first
    bytes.
    """
    names = [n for n in archive.namelist() if n.lower().endswith(".csv")]
    found = [n for n in names if n.rsplit("/", 1)[-1].startswith(f"{game}_") and extra not in n]
    if not found:
        marks = [f"\n{game},".encode(e) for e in ("utf-8", "cp950")]
        for n in names:
            with archive.open(n) as f:
                head = f.read(SNIFFED)
            if any(m in head for m in marks):
                found.append(n)
    if len(found) != 1:
        raise ValueError(f"{len(found)} members for {game}: one is needed")
    return found[0]


def scan_archives(spark: SparkSession, path: str, game: str, width: int = WIDTH) -> DataFrame:
    """(archive, row, fields) of ``game``'s table in each ZIP file of ``path``, a folder or a pattern; ``row`` counts from 0, the header is left out.

    ``fields`` has ``width`` texts, null where a line is shorter; columns past it are not read, and blank lines are no
    rows. A task opens whole archives, one year each. An archive without exactly one table of the game fails the scan.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    lines = csv.reader(io.StringIO(decoded(z.read(member_of(z, game)))))
                    rows = [r for r in lines if r][1:]
                year = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                yield pd.DataFrame({"archive": year, "row": range(len(rows)), "fields": [(r + [None] * width)[:width] for r in rows]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, row long, fields array<string>")


def import_archives(spark: SparkSession, path: str, game: str, columns: list[str], source: str) -> DataFrame:
    """Cleaned draws of all archives under ``path``: ``columns`` names the fields in order; the archive's name is the source version.

    Of rows with the same id and date, that of the last archive stays.
    """
    from panelwright.operators import validation

    raw = scan_archives(spark, path, game, len(columns))
    seq = F.struct("archive", "row").alias("seq")
    named = raw.select(seq, "archive", *[F.col("fields")[i].alias(c) for i, c in enumerate(columns)])
    return validation.clean(named, source, "", "archive").drop("seq")
