"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm._store import arrow_rows, pick, slices, stored
from panelwright.llm._words import ALNUM, Words, mix, words

WINDOW = 10
#: Benchmark text in one table of patterns; a larger benchmark takes one pass over the documents for each so many bytes.
PATTERN_BYTES = 1 << 25
#: Positions that one lane of a search walks through.
LANE = 256
U64 = np.uint64


class Search:
    """Occurrences of patterns of one length: a shift for each block of words, buckets by the patterns' last block."""

    def __init__(self, patterns: list[tuple[bytes, ...]], hashes: np.ndarray):
        self.patterns, self.hashes = patterns, hashes
        self.m = hashes.shape[1]
        self.b = min(2, self.m)
        far = self.m - self.b + 1
        size = 1 << max(12, (16 * len(patterns)).bit_length())
        self.mask = U64(size - 1)
        self.shift = np.full(size, far, np.int64)
        for end in range(self.b - 1, self.m):
            at = self.block(hashes[:, end - 1] if self.b > 1 else None, hashes[:, end])
            np.minimum.at(self.shift, (at & self.mask).astype(np.int64), self.m - 1 - end)
        last = self.block(hashes[:, -2] if self.b > 1 else None, hashes[:, -1])
        self.bucket = np.argsort(last, kind="stable")
        self.suffix = last[self.bucket]

    def block(self, before: np.ndarray | None, end: np.ndarray) -> np.ndarray:
        return end if before is None else mix(before * U64(0x9E3779B97F4A7C15) + end)

    def candidates(self, w: Words) -> np.ndarray:
        """Positions of last words at which the shift is 0; many lanes walk at once, each by its own shifts."""
        first, stop = w.first[:-1] + self.m - 1, w.first[1:]
        first, stop = first[first < stop], stop[first < stop]
        lanes = -(-(stop - first) // LANE)
        start = np.repeat(first, lanes) + LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        end = np.minimum(start + LANE, np.repeat(stop, lanes))
        found = []
        while len(start):
            block = self.block(w.hash[start - 1] if self.b > 1 else None, w.hash[start])
            shift = self.shift[(block & self.mask).astype(np.int64)]
            if (hit := shift == 0).any():
                found.append(start[hit])
            start = start + np.maximum(shift, 1)
            alive = start < end
            start, end = start[alive], end[alive]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def occurrences(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, pattern) of each occurrence."""
        at = self.candidates(w)
        block = self.block(w.hash[at - 1] if self.b > 1 else None, w.hash[at])
        low, high = np.searchsorted(self.suffix, block), np.searchsorted(self.suffix, block, "right")
        n = high - low
        at, low = np.repeat(at, n) - (self.m - 1), np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pattern = self.bucket[low]
        same = np.ones(len(at), bool)
        for i in range(self.m):
            same[same] = w.hash[at[same] + i] == self.hashes[pattern[same], i]
        at, pattern = at[same], pattern[same]
        # equal hashes: now the words themselves
        data = w.data.tobytes() if len(at) else b""
        sure = [all(data[w.start[i + k] : w.end[i + k]] == x for k, x in enumerate(self.patterns[p])) for i, p in zip(at.tolist(), pattern.tolist(), strict=True)]
        sure = np.array(sure, bool)
        return at[sure], pattern[sure]


class Patterns:
    """All windows of some benchmark items, with the items of each, by length."""

    def __init__(self, items: list[str], texts: pa.Array, window: int):
        w = words(texts, ALNUM)
        data = w.data.tobytes()
        owners: dict[int, dict[tuple[bytes, ...], tuple[int, set[str]]]] = defaultdict(dict)
        for k, item in enumerate(items):
            i, j = int(w.first[k]), int(w.first[k + 1])
            n = min(window, j - i)
            for a in range(i, j - n + 1) if n else ():
                key = tuple(data[w.start[x] : w.end[x]] for x in range(a, a + n))
                owners[n].setdefault(key, (a, set()))[1].add(item)
        self.searches = []
        for n, found in owners.items():
            rows = np.array([a for a, _ in found.values()], np.int64)
            self.searches.append((Search(list(found), w.hash[rows[:, None] + np.arange(n)]), [sorted(x) for _, x in found.values()]))


def _chunks(benchmark: DataFrame, limit: int) -> Iterator[tuple[list[str], pa.Array]]:
    """The benchmark's items, so many bytes of text at a time."""
    items, texts, held = [], [], 0
    for r in benchmark.toLocalIterator():
        if r["text"] is None:
            continue
        items.append("" if r["item_id"] is None else r["item_id"])
        texts.append(r["text"])
        held += len(texts[-1].encode())
        if held >= limit:
            yield items, pa.array(texts, pa.string())
            items, texts, held = [], [], 0
    if items:
        yield items, pa.array(texts, pa.string())


def _scan(patterns: Patterns, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, spans, items = [], [], []
            before, known = b.column(2).to_pylist(), b.column(3).to_pylist()
            for row, stop in slices(b, 1):
                w = words(b.column(1)[row:stop], ALNUM)
                n_words += w.counts.tolist()
                edge = np.zeros(len(w.hash) + 1, np.int32)
                hits: dict[int, set[str]] = defaultdict(set)
                for search, owners in patterns.searches:
                    at, pattern = search.occurrences(w)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + search.m, -1)
                    for d, p in set(zip((np.searchsorted(w.first, at, "right") - 1).tolist(), pattern.tolist(), strict=True)):
                        hits[d].update(owners[p])
                inside = np.cumsum(edge[:-1]) > 0
                for d in range(stop - row):
                    old = before[row + d]
                    if not old and d not in hits:
                        spans.append([])
                        items.append(known[row + d])
                        continue
                    mark = inside[w.first[d] : w.first[d + 1]].copy()
                    for s in old:
                        mark[s["start"] : s["end"]] = True
                    step = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
                    spans.append([{"start": i, "end": j} for i, j in step.reshape(-1, 2).tolist()])
                    items.append(sorted({*known[row + d], *hits.get(d, ())}))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            text = b.column(1) if keep_text else pa.nulls(b.num_rows, b.column(1).type)
            yield pa.record_batch([b.column(0), text, pa.array(spans, kind), pa.array(items, pa.list_(pa.string())), pa.array(n_words, pa.int64())], ["doc_id", "text", "spans", "items", "n_words"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) of each row of ``docs``: the benchmark windows that occur in its whole text.

    Words are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A window is ``window``
    consecutive words of an item, or a shorter item's all; spans are the maximal runs of document words inside any
    occurrence (word numbers, end exclusive), items the sorted ids, as strings, of the items with an occurring window.

    The windows go to every task in tables of at most ``pattern_bytes`` of benchmark text; a larger benchmark takes
    several passes, whose marks are written in between. Null or empty texts, and items, have no words: no spans, no
    items. Repeated rows are searched each; equal windows of several items count for all of them. Other columns are
    ignored. An empty table on either side gives its rows without hits, or none.
    """
    arrow_rows(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, spans array<struct<start:long,end:long>>, items array<string>, n_words long"
    none = F.array().cast("array<struct<start:long,end:long>>"), F.array().cast("array<string>")
    now = pick(docs, "doc_id", "text").select("doc_id", "text", none[0].alias("spans"), none[1].alias("items"))
    tables = _chunks(pick(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), "text"), pattern_bytes)
    table = next(tables, ([], pa.array([], pa.string())))
    while table is not None:
        after = next(tables, None)
        now = now.mapInArrow(_scan(Patterns(*table, window), after is not None), schema)
        if after is not None:
            now = stored(now, "decontaminated").drop("n_words")
        table = after
    return now.drop("text")


def report(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) from what ``decontaminate`` found."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
