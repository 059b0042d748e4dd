"""Source divergence audit by in-mapper stripes: what each source of a language says more often than the others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm._store import arrow_rows, forget, partitions, pick, slices, stored, text_bytes
from panelwright.llm._words import LETTERS, hashes, strings, terms

#: Documents of a language that hold a term, at least, for the term to be kept.
LEAST_DOCUMENTS = 3
#: Chances are whole multiples of one in so many, plus one.
SCALE = 1_000_000_000
#: Terms reported of each group.
TERMS = 200
#: Cells (a term's count in a source) that a task holds before it spills its stripes to the exchange.
CELLS = 1_000_000

_STRIPES = "part int, lang string, sources array<string>, term_bytes binary, term_lengths binary, cells binary, df binary, source binary, count binary"
_MERGED = "lang string, sources array<string>, term_bytes binary, term_lengths binary, cells binary, source binary, count binary, n_terms long, totals array<long>"


def _summed(term: pa.Array, group: np.ndarray, *values: np.ndarray) -> tuple:
    """Cells of equal term and group added up: the distinct terms, each cell's term and group, and sums."""
    coded = term.dictionary_encode()
    n = max(1, len(coded.dictionary))
    cell, at = np.unique(group * n + coded.indices.to_numpy(), return_inverse=True)
    sums = []
    for v in values:
        sums.append(np.zeros(len(cell), np.int64))
        np.add.at(sums[-1], at, v)
    return coded.dictionary, cell % n, cell // n, *sums


class _Stripes:
    """A hash table from terms to stripes: documents with the term, and its count, by language and source."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.chunks: list[tuple] = []
        self.cells = self.settled = 0

    def add(self, langs: list[str], sources: list[str], texts: pa.Array) -> None:
        """Whole documents."""
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)], np.int64)
        term, first = terms(texts, LETTERS)
        if not len(term):
            return
        coded = term.dictionary_encode()
        n = len(coded.dictionary)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        pair, count = np.unique(owner * n + coded.indices.to_numpy(), return_counts=True)
        owner, code = np.divmod(pair, n)
        cell, at = np.unique(group[owner] * n + code, return_inverse=True)
        sums = np.zeros(len(cell), np.int64)
        np.add.at(sums, at, count)
        self.chunks.append((coded.dictionary.take(pa.array(cell % n)), cell // n, np.bincount(at), sums))
        self.cells += len(cell)
        if self.cells > 2 * self.settled + CELLS // 4:
            self.settle()

    def settle(self) -> tuple:
        """The chunks as one."""
        term = pa.concat_arrays([c[0] for c in self.chunks])
        found, code, group, documents, count = _summed(term, *(np.concatenate([c[i] for c in self.chunks]) for i in (1, 2, 3)))
        self.chunks = [(found.take(pa.array(code)), group, documents, count)]
        self.cells = self.settled = len(code)
        return found, code, group, documents, count

    def out(self, parts: int) -> Iterator[dict]:
        """A row for each part and language: its terms end to end and their stripes; the table is empty afterwards."""
        if not self.chunks:
            return
        found, code, group, documents, count = self.settle()
        self.clear()
        langs = sorted({lang for lang, _ in self.groups})
        names = list(self.groups)
        lang_of = np.array([langs.index(lang) for lang, _ in names], np.int64)
        part = (hashes(found) % np.uint64(parts)).astype(np.int64)[code]
        order = np.lexsort((group, code, lang_of[group], part))
        part, code, group, documents, count = (x[order] for x in (part, code, group, documents, count))
        run = part * len(langs) + lang_of[group]
        edges = np.flatnonzero(np.diff(run, prepend=-1, append=-1))
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            fresh = np.flatnonzero(np.diff(code[i:j], prepend=-1))
            own, source = np.unique(group[i:j], return_inverse=True)
            yield {"part": int(part[i]), "lang": langs[lang_of[group[i]]], "sources": [names[g][1] for g in own]} | _packed(found.take(pa.array(code[i:j][fresh])), fresh, j - i, source, count[i:j]) | {"df": np.add.reduceat(documents[i:j], fresh).astype("<i8").tobytes()}


def _packed(term: pa.Array, first: np.ndarray, cells: int, source: np.ndarray, count: np.ndarray) -> dict:
    data, edges = text_bytes(term)
    return {
        "term_bytes": data.tobytes(), "term_lengths": np.diff(edges).astype("<i4").tobytes(), "cells": np.diff(np.append(first, cells)).astype("<i4").tobytes(),
        "source": source.astype("<i4").tobytes(), "count": count.astype("<i8").tobytes(),
    }


def _unpacked(row: dict) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, cells of each, and the cells' sources and counts."""
    read = lambda name, kind: np.frombuffer(row[name], kind).astype(np.int64)
    return strings(read("term_lengths", "<i4"), row["term_bytes"]), read("cells", "<i4"), read("source", "<i4"), read("count", "<i8")


def _fold(parts: int):
    """Stripes of the documents (text, lang, source) of a partition, dealt out by term."""
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("sources", pa.list_(pa.string())), *[(c, pa.binary()) for c in ("term_bytes", "term_lengths", "cells", "df", "source", "count")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Stripes()

        def spilled() -> Iterator[pa.RecordBatch]:
            for row in table.out(parts):
                yield pa.RecordBatch.from_pylist([row], schema)

        for b in batches:
            lang, source = b.column(1).to_pylist(), b.column(2).to_pylist()
            for row, stop in slices(b, 0):
                table.add(lang[row:stop], source[row:stop], b.column(0)[row:stop])
                if table.cells > CELLS:
                    yield from spilled()
        yield from spilled()

    return run


def _merged(least: int):
    """Whole stripes of a partition's rows, which come sorted by part and language: terms in the order of their bytes."""
    schema = pa.schema([("lang", pa.string()), ("sources", pa.list_(pa.string())), *[(c, pa.binary()) for c in ("term_bytes", "term_lengths", "cells", "source", "count")], ("n_terms", pa.int64()), ("totals", pa.list_(pa.int64()))])

    def merge(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        sources = sorted({s for r in rows for s in r["sources"]})
        code_of = {s: i for i, s in enumerate(sources)}
        term, cells, source, count, df = [], [], [], [], []
        for r in rows:
            t, c, s, n = _unpacked(r)
            term.append(t)
            cells.append(c)
            source.append(np.array([code_of[x] for x in r["sources"]], np.int64)[s])
            count.append(n)
            df.append(np.frombuffer(r["df"], "<i8"))
        coded = pa.concat_arrays(term).dictionary_encode()
        code, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        documents = np.zeros(n, np.int64)
        np.add.at(documents, code, np.concatenate(df))
        kept = np.flatnonzero(documents >= least)
        if not len(kept):
            return
        kept = kept[pc.sort_indices(coded.dictionary.take(pa.array(kept))).to_numpy()]
        place = np.full(n, -1)
        place[kept] = np.arange(len(kept))
        at = place[np.repeat(code, np.concatenate(cells))]
        source, count = np.concatenate(source)[at >= 0], np.concatenate(count)[at >= 0]
        cell, back = np.unique(at[at >= 0] * len(sources) + source, return_inverse=True)
        sums, totals = np.zeros(len(cell), np.int64), np.zeros(len(sources), np.int64)
        np.add.at(sums, back, count)
        np.add.at(totals, source, count)
        at, source = np.divmod(cell, len(sources))
        packed = _packed(coded.dictionary.take(pa.array(kept)), np.flatnonzero(np.diff(at, prepend=-1)), len(at), source, sums)
        yield pa.RecordBatch.from_pylist([{"lang": rows[0]["lang"], "sources": sources, "n_terms": len(kept), "totals": totals.tolist()} | packed], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if rows and (r["part"], r["lang"]) != (rows[0]["part"], rows[0]["lang"]):
                    yield from merge(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield from merge(rows)

    return run


def chance(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), by long division in thousands: 64-bit integers do while total is below 9e15."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), np.asarray(count) + 1
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return 1 + out


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _emitted(top: int):
    """(lang, source, part, item, value) of a language's stripes: each pair's sum over these terms, and each source's ``top`` terms of them."""

    def pairs(names: list[str], lang: str, p0: np.ndarray, n_terms: int, at: np.ndarray, cells: np.ndarray, source: np.ndarray, count: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A term that neither source has, or one of them, counts by how many such there are; only those of both go one by one."""
        n = len(names)
        seen, index, times = np.unique(source * (count.max(initial=0) + 1) + count, return_index=True, return_counts=True)
        owner, chances = source[index], p[index]
        alone = np.bincount(source, minlength=n)
        first = np.cumsum(cells) - cells
        by_source = np.argsort(source, kind="stable")
        stops = np.cumsum(alone)
        for a in range(n):
            mine = by_source[stops[a] - alone[a] : stops[a]]
            own = owner == a
            total = (_far(chances[own][:, None], p0[None, :]) * times[own][:, None]).sum(0)
            np.add.at(total, owner, _far(p0[a], chances) * times)
            total += (n_terms - alone[a] - alone) * _far(p0[a], p0)
            # all cells of the terms that this source has
            width = cells[at[mine]]
            other = np.repeat(first[at[mine]], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            x, b, y = np.repeat(p[mine], width), source[other], p[other]
            np.add.at(total, b, _far(x, y) - _far(x, p0[b]) - _far(p0[a], y) + _far(p0[a], p0[b]))
            rest = np.flatnonzero(np.arange(n) != a)
            yield said(lang, [names[a]] * len(rest), "pair", pa.array([names[i] for i in rest], pa.string()), total[rest])

    def said(lang: str, source: list[str], part: str, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        k = len(value)
        return pa.record_batch([pa.array([lang] * k, pa.string()), pa.array(source, pa.string()), pa.array([part] * k, pa.string()), item, pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                names, lang = [g["source"] for g in r["groups"]], r["lang"]
                sums = np.array([g["n"] for g in r["groups"]], np.int64)
                none = np.zeros(0, np.int64)
                if r["term_bytes"] is None:  # a language without terms
                    yield from pairs(names, lang, np.ones(len(names), np.int64), 0, none, none, none, none, none)
                    continue
                term, cells, source, count = _unpacked(r)
                place = {s: k for k, s in enumerate(names)}
                source = np.array([place[s] for s in r["sources"]], np.int64)[source]
                at = np.repeat(np.arange(len(term)), cells)
                p, p0 = chance(count, sums[source] + r["v"]), chance(np.zeros(len(names), np.int64), sums + r["v"])
                q = chance(np.add.reduceat(count, np.cumsum(cells) - cells), int(sums.sum()) + r["v"])[at]
                yield from pairs(names, lang, p0, len(term), at, cells, source, count, p)
                more = np.flatnonzero(p > q)
                value = _far(p[more], q[more])
                order = np.lexsort((at[more], -value, source[more]))
                own = source[more][order]
                begin = np.searchsorted(own, own)
                chosen = order[np.arange(len(own)) - begin < top]
                if len(chosen):
                    yield said(lang, [names[s] for s in source[more][chosen]], "term", term.take(pa.array(at[more][chosen])), value[chosen])

    return run


def divergences(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's terms are from other sources' and from its language's.

    Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased; a language keeps those that at least
    ``least`` of its documents hold. With N a group's (or a language's) occurrences of kept terms and V their number, a
    term's chance is p = 1 + floor(1e9 (count + 1) / (N + V)), and f = floor((p - q)^2 / q). Part ``pair``: f summed over
    the language's kept terms, p the source's, q that of another source, the item; 0 where no term is kept. Part ``term``:
    f of each term that the source has more often than its language, q the language's, the first ``top`` of them. Ranks
    begin at 1 for each source and part, greatest value first, then items in the order of their bytes.

    1. Each partition folds whole documents into a table from terms to stripes (documents with the term, and the term's
       count by source), which spills to the exchange whenever it holds CELLS counts.
    2. Stripes meet by term, in as many parts as there are shuffle partitions; a task holds one part of one language. A
       frequent term comes once from each spill, so no key is hot. Whole stripes are written.
    3. Sums of the written stripes give N and V; stripes then emit their share of every divergence.

    A language's sources are one array, as each pair of them is a row of the result. Sums above 64 bits raise an error.
    A null text, language or source is read as an empty one. Groups without a term, and without a kept one, take part in
    pairs. Repeated rows and ids are documents each; ids and other columns are not looked at. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = pick(docs, "text", "lang", "source").select("text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    n = partitions(spark)
    spills = rows.mapInArrow(_fold(n), _STRIPES)
    stripes = stored(spills.repartitionById(n, "part").sortWithinPartitions("part", "lang").mapInArrow(_merged(least), _MERGED), "divergence-stripes")
    sums = stripes.select("lang", F.explode(F.arrays_zip(F.col("sources").alias("source"), F.col("totals").alias("n"))).alias("s")).groupBy("lang", "s.source").agg(F.sum("s.n").alias("n"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["n"])
    groups = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups"))
    kept = stripes.groupBy("lang").agg(F.sum("n_terms").alias("v"))
    groups = stored(groups.join(kept, "lang", "left").na.fill(0, ["v"]), "divergence-groups")  # a written table: Spark knows its size when it chooses the join
    inputs = stripes.join(groups, "lang").unionByName(groups.where("v = 0"), allowMissingColumns=True)
    values = stored(inputs.mapInArrow(_emitted(top), "lang string, source string, part string, item string, value long"), "divergence-values")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    whole = values.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = whole.withColumn("rank", F.row_number().over(order))
    found = values.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = stored(pairs.union(found), "divergences")
    forget(spark, stripes, groups, values)
    return out
