"""Substring dedup: equal and near paragraphs, pieces cut by content and runs of words, removed where an earlier document has them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm._graph import components
from panelwright.llm._store import arrow_rows, forget, partitions, pick, slices, stored
from panelwright.llm._words import SPACED, Words, mix, windows, words
from panelwright.llm.ngram_join import FILTER_BITS, key_filter, ngram_join, passing

WORDS = 5
NUMER, DENOM = 75, 100
#: Bands of so many minima: paragraphs with a Jaccard similarity of 0.75 collide in one of them in 99.97 of 100 cases.
BANDS, ROWS = 10, 2
#: Words of the shortest paragraph that is compared by similarity.
PARAGRAPH = 20
#: A piece ends where a word's hash is the least of so many to either side: 9 words on average, wherever the passage stands.
REACH = 4
#: Removed runs of fewer words stay in the text: stock phrases and single short lines are no repeated passage.
RUN = 30
#: Words of the shingles of which each run of RUN words names the least: runs that are equal name the same.
SHINGLE = 16
U64 = np.uint64
_MARKS = "doc_id long, begins array<long>, ends array<long>, first long"
_SALTS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def paragraphs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of every paragraph: words between line ends; each belongs to one text."""
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lines = np.concatenate([[0], np.cumsum(w.data == 0x0A)])[w.start]
    begin = np.ones(n, bool)
    begin[1:] = lines[1:] != lines[:-1]
    begin[w.first[:-1][w.counts > 0]] = True
    at = np.flatnonzero(begin)
    return at, np.append(at[1:], n)


def pieces(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of every piece between two cuts of one text; what stands before the first or after the last cut is none."""
    n = len(w.hash)
    cut = np.ones(n, bool)
    h = mix(w.hash)
    for i in range(1, REACH + 1):
        # strictly less than before, at most equal after: of equal words in a row the first cuts
        cut[i:] &= h[i:] < h[:-i]
        cut[:-i] &= h[:-i] <= h[i:]
    owner = w.owner
    at = np.flatnonzero(cut)
    near = np.minimum(at - w.first[owner[at]], w.first[owner[at] + 1] - 1 - at) < REACH  # the context is in another text, or nowhere
    at = at[~near]
    same = owner[at[1:]] == owner[at[:-1]]
    return at[:-1][same], at[1:][same]


def _span_keys(w: Words, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit key of each span's words in order, the same wherever the span stands."""
    if not len(begin):
        return np.zeros(0, U64)
    place = np.arange(len(w.hash)) - np.repeat(begin, end - begin) if len(begin) and end[-1] - begin[0] == len(w.hash) and (begin[1:] == end[:-1]).all() else None
    if place is None:
        index = np.repeat(begin - np.concatenate([[0], np.cumsum(end - begin)[:-1]]), end - begin) + np.arange((end - begin).sum())
        place, h = index - np.repeat(begin, end - begin), w.hash[index]
    else:
        h = w.hash
    sums = np.add.reduceat(mix(h + (place.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)), np.concatenate([[0], np.cumsum(end - begin)[:-1]]))
    return mix(sums + (end - begin).astype(U64))


def runs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every run of RUN words inside one text, its key, and the least key of the shingles in it."""
    at = np.arange(max(len(w.hash) - RUN + 1, 0))
    owner = w.owner
    at = at[owner[at] == owner[at + RUN - 1]]
    if not len(at):
        return at, np.zeros(0, U64), np.zeros(0, U64)
    h, k = w.hash, 1
    while k < SHINGLE:
        h, k = mix(h[:-k] * U64(0x9E3779B97F4A7C15) + h[k:]), 2 * k
    least, k, width = h, 1, RUN - SHINGLE + 1
    while k < width:
        step = min(k, width - k)
        least, k = np.minimum(least[:-step], least[step:]), k + step
    # the first and the last shingle have all the run's words
    return at, mix(h[at] * U64(0x9E3779B97F4A7C15) + h[at + RUN - SHINGLE]), least[at]


def _packed(parts: int, key: np.ndarray, *cols: np.ndarray, by: np.ndarray | None = None) -> pa.RecordBatch:
    part = (mix(key if by is None else by) % U64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    edge = np.flatnonzero(np.diff(part, prepend=-1))
    stops = np.append(edge[1:], len(part))
    blob = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(edge, stops, strict=True)], pa.binary())
    return pa.record_batch([pa.array(part[edge]), *(blob(x[order]) for x in (key, *cols))], ["part", *(f"c{i}" for i in range(len(cols) + 1))])


def _unpacked(batches: Iterator[pa.RecordBatch], *kinds) -> list[np.ndarray]:
    cols: list[list] = [[] for _ in kinds]
    for b in batches:
        for i, kind in enumerate(kinds):
            cols[i] += [np.frombuffer(x.as_buffer(), kind) for x in b.column(i + 1)]
    return [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(cols, kinds, strict=True)]


def _ids(b: pa.RecordBatch, row: int, stop: int) -> np.ndarray:
    return np.asarray(b.column(0)[row:stop].cast(pa.int64()))


def _piece_keys(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, stop in slices(b, 1):
                w = words(b.column(1)[row:stop], SPACED)
                lines = paragraphs(w)
                whole = lines[1] - lines[0] >= PARAGRAPH
                begin, end = (np.concatenate([x, y[whole]]) for x, y in zip(pieces(w), lines, strict=True))
                if len(begin):
                    owner = w.owner[begin]
                    yield _packed(parts, _span_keys(w, begin, end), _ids(b, row, stop)[owner], (begin - w.first[owner]).astype(np.int32), (end - begin).astype(np.int32))

    return run


def _named(parts: int):
    """Packed (least, doc_id) of the runs of each text, once for runs in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, stop in slices(b, 1):
                w = words(b.column(1)[row:stop], SPACED)
                at, _, least = runs(w)
                if len(at):
                    owner = w.owner[at]
                    fresh = np.append(True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]))
                    yield _packed(parts, least[fresh], _ids(b, row, stop)[owner[fresh]])

    return run


def _met(parts: int):
    """Packed (key, doc_id), dealt out by document: what its runs name and runs of another document too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc = _unpacked(batches, U64, np.int64)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        end = np.append(begin[1:], len(key))[: len(begin)]
        keep = np.repeat(doc[begin] != doc[end - 1], end - begin)
        if keep.any():
            yield _packed(parts, key[keep], doc[keep], by=doc[keep].view(U64))

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, keys): one row for each document."""
    key, doc = _unpacked(batches, U64, np.int64)
    order = np.argsort(doc, kind="stable")
    key, doc = key[order], doc[order]
    edge = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])[: len(doc)])
    stops = np.append(edge[1:], len(doc))
    for i in range(0, len(edge), 5000):
        blobs = [key[a:b].tobytes() for a, b in zip(edge[i : i + 5000].tolist(), stops[i : i + 5000].tolist(), strict=True)]
        yield pa.record_batch([pa.array(doc[edge[i : i + 5000]]), pa.array(blobs, pa.binary())], ["doc_id", "keys"])


def _run_keys(parts: int):
    """Packed keys of the runs that name what another document's runs name, dealt out by that, so that runs in a row meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, stop in slices(b, 1):
                w = words(b.column(1)[row:stop], SPACED)
                at, key, least = runs(w)
                edge = np.searchsorted(at, w.first)
                hit = [np.flatnonzero(np.isin(least[i:j], np.frombuffer(named, U64))) + i for i, j, named in zip(edge[:-1], edge[1:], b.column(2)[row:stop].to_pylist(), strict=True)]
                hit = np.concatenate(hit)
                if len(hit):
                    begin, owner = at[hit], w.owner[at[hit]]
                    yield _packed(parts, key[hit], _ids(b, row, stop)[owner], (begin - w.first[owner]).astype(np.int32), np.full(len(hit), RUN, np.int32), by=least[hit])

    return run


def _equal_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, begins, ends, first): all runs of RUN words that a document with a smaller id has too, wherever they stand."""
    n = 2 * partitions(docs.sparkSession)  # a task sorts its part in memory
    packed = "part int, c0 binary, c1 binary"
    met = docs.mapInArrow(_named(n), packed).repartition(n, "part").mapInArrow(_met(n), packed)
    met = stored(met.repartition(n, "part").mapInArrow(_by_document, "doc_id long, keys binary"), "dedup-met")
    some = docs.join(met, "doc_id").select("doc_id", "text", "keys")
    keyed = some.mapInArrow(_run_keys(n), "part int, c0 binary, c1 binary, c2 binary, c3 binary")
    return keyed.repartition(n, "part").mapInArrow(_later, _MARKS)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, begins, ends, first): packed, the units of each document that a document with a smaller id has too, joined, and the smallest such id."""
    key, doc, begin, length = _unpacked(batches, U64, np.int64, np.int32, np.int32)
    order = np.lexsort((doc, key))
    key, doc, begin, length = key[order], doc[order], begin[order], length[order]
    start = np.append(True, key[1:] != key[:-1])[: len(key)]
    first = doc[np.flatnonzero(start)][np.cumsum(start) - 1] if len(key) else doc
    keep = np.flatnonzero(doc != first)
    keep = keep[np.lexsort((begin[keep], doc[keep]))]
    doc, begin, end, first = doc[keep], begin[keep].astype(np.int64), begin[keep].astype(np.int64) + length[keep], first[keep]
    if len(doc):
        # apart by document, spans that touch are one
        apart = np.cumsum(np.append(False, doc[1:] != doc[:-1])) * (end.max() + 1)
        far = np.maximum.accumulate(end + apart)
        new = np.flatnonzero(np.append(True, (begin + apart)[1:] > far[:-1]) | np.append(True, doc[1:] != doc[:-1]))
        end = (far - apart)[np.append(new[1:], len(doc)) - 1]
        doc, begin, first = doc[new], begin[new], np.minimum.reduceat(first, new)
    edge = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])[: len(doc)])
    stops = np.append(edge[1:], len(doc))
    for i in range(0, len(edge), 5000):
        cut = list(zip(edge[i : i + 5000].tolist(), stops[i : i + 5000].tolist(), strict=True))
        lists = [pa.array([x[a:b] for a, b in cut], pa.list_(pa.int64())) for x in (begin, end)]
        yield pa.record_batch([pa.array(doc[edge[i : i + 5000]]), *lists, pa.array([int(first[a:b].min()) for a, b in cut], pa.int64())], ["doc_id", "begins", "ends", "first"])


def _signatures(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A row of band keys for each run of shingles that ``edge`` begins."""
    least = [np.minimum.reduceat(mix(h * s), edge) for s in _SALTS]
    return np.stack([mix(sum((x * U64(2 * i + 3) for i, x in enumerate(least[k * ROWS : (k + 1) * ROWS])), U64(k + 1))) for k in range(BANDS)], 1)


def _long(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paragraphs of enough words: first word, end, key; all shingles, and where each paragraph's begin among them."""
    begin, end = paragraphs(w)
    keep = end - begin >= PARAGRAPH
    begin, end = begin[keep], end[keep]
    h, at = windows(w, WORDS)
    low, high = np.searchsorted(at, begin), np.searchsorted(at, end - WORDS + 1)
    index = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange((high - low).sum()) if len(begin) else np.zeros(0, np.int64)
    return begin, end, _span_keys(w, begin, end), h[index], np.concatenate([[0], np.cumsum(high - low)])


def _bands(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, stop in slices(b, 1):
                w = words(b.column(1)[row:stop], SPACED)
                _, _, key, h, edge = _long(w)
                if len(key):
                    band = _signatures(h, edge[:-1])
                    yield _packed(parts, band.reshape(-1), np.repeat(key, BANDS))

    return run


def _colliding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of different paragraphs in one band's bucket: each with the smallest key and with the next one there."""
    band, key = _unpacked(batches, U64, U64)
    order = np.lexsort((key, band))
    band, key = band[order], key[order]
    fresh = np.append(True, (band[1:] != band[:-1]) | (key[1:] != key[:-1]))[: len(key)]
    band, key = band[fresh], key[fresh].view(np.int64)
    start = np.append(True, band[1:] != band[:-1])[: len(band)]
    head = key[np.flatnonzero(start)][np.cumsum(start) - 1] if len(key) else key
    later = np.flatnonzero(~start)
    pairs = np.unique(np.concatenate([np.stack([head[later], key[later]], 1), np.stack([key[later - 1], key[later]], 1)]), axis=0)
    yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _occurrences(mask: np.ndarray, sets: bool):
    """(key, doc_id, begin, end) of the paragraphs that the filter lets pass, or (key, shingles), each once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for row, stop in slices(b, 1):
                w = words(b.column(1)[row:stop], SPACED)
                begin, end, key, h, edge = _long(w)
                hit = np.flatnonzero(passing(mask, (key % U64(FILTER_BITS)).astype(np.int64)))
                if sets:
                    hit = np.array([i for i in hit if (k := int(key[i])) not in seen and not seen.add(k)], np.int64)
                    yield pa.record_batch([pa.array(key[hit].view(np.int64)), pa.array([np.unique(h[edge[i] : edge[i + 1]]).tobytes() for i in hit], pa.binary())], ["key", "shingles"])
                else:
                    owner = w.owner[begin[hit]]
                    yield pa.record_batch([pa.array(key[hit].view(np.int64)), pa.array(_ids(b, row, stop)[owner]), pa.array(begin[hit] - w.first[owner]), pa.array(end[hit] - w.first[owner])], ["key", "doc_id", "begin", "end"])

    return run


def _texts(mask: np.ndarray):
    """(key, text) of the paragraphs that the filter lets pass, each once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for row, stop in slices(b, 1):
                w = words(b.column(1)[row:stop], SPACED)
                begin, end, key, _, _ = _long(w)
                hit = np.flatnonzero(passing(mask, (key % U64(FILTER_BITS)).astype(np.int64)))
                hit = np.array([i for i in hit if (k := int(key[i])) not in seen and not seen.add(k)], np.int64)
                text = pa.array([w.data[i:j].tobytes() for i, j in zip(w.start[begin[hit]], w.end[end[hit] - 1], strict=True)], pa.binary())
                yield pa.record_batch([pa.array(key[hit].view(np.int64)), text.cast(pa.string())], ["key", "text"])

    return run


def _unmet(docs: DataFrame, pairs: DataFrame, groups: DataFrame) -> DataFrame | None:
    """(a, b): links that the exact join of sets finds among paragraphs whose buckets keep several components.

    ``pairs`` has each paragraph of a bucket with the bucket's smallest, so a bucket with several components has a pair
    across two; every member of such components takes part, and with it every pair of a bucket that is not joined yet.
    The join is told of the components, so that what links join already is not paired again.
    """
    spark = docs.sparkSession
    apart = pairs
    for end in "ab":
        apart = apart.join(groups.withColumnsRenamed({"node": end, "component": f"{end}_c"}), end, "left").withColumn(f"{end}_c", F.coalesce(f"{end}_c", end))
    apart = stored(apart.select("a", "b", "a_c", "b_c").where("a_c <> b_c"), "dedup-apart")
    if apart.isEmpty():
        forget(spark, apart)
        return None
    single = [apart.select(F.col(end).alias("key")) for end in "ab"]
    touched = apart.select(F.col("a_c").alias("component")).union(apart.select(F.col("b_c").alias("component"))).distinct()
    wanted = stored(single[0].union(single[1]).union(groups.join(touched, "component", "left_semi").select(F.col("node").alias("key"))).distinct(), "dedup-open")
    texts = docs.mapInArrow(_texts(key_filter(F.col("key"), wanted)), "key long, text string").join(wanted, "key", "left_semi").dropDuplicates(["key"])
    texts = stored(texts, "dedup-texts")
    found = ngram_join(texts, "key", "text", groups.join(wanted.withColumnRenamed("key", "node"), "node", "left_semi")).where("doc_id <> component_id")
    out = stored(found.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")), "dedup-met-late")
    forget(spark, apart, wanted, texts)
    return out


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(DENOM * both >= NUMER * (len(x) + len(y) - both))
        yield pa.record_batch(batch.filter(pa.array(keep, pa.bool_())).columns[:2], ["a", "b"])


def _hubs(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b) not in ``pairs``: each paragraph with the one that has the most links among those that share a first of its pairs.

    Variants of one paragraph have it as their hub, and seldom the smallest key: so few comparisons join most of a family.
    """
    ends = [links.select(F.col(end).alias("node")) for end in "ab"]
    degree = ends[0].union(ends[1]).groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    near = pairs.select(F.col("a").alias("head"), F.col("b").alias("node")).union(pairs.select(F.col("a").alias("head"), F.col("a").alias("node")).distinct())
    hubs = near.join(degree, "node").groupBy("head").agg(F.max(F.struct("n", "node"))["node"].alias("hub")).where("hub <> head")
    found = near.join(hubs, "head").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    return found.distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, as a written table."""
    for end in "ab":
        pairs = pairs.join(sets.select(F.col("key").alias(end), F.col("shingles").alias(f"{end}_s")), end)
    return stored(pairs.select("a", "b", "a_s", "b_s").mapInArrow(_similar, "a long, b long"), "dedup-links")


def _near_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, begins, ends, first): the paragraphs that are near copies of one in a document with a smaller id."""
    n = partitions(docs.sparkSession)
    pairs = docs.mapInArrow(_bands(n), "part int, c0 binary, c1 binary").repartition(n, "part").mapInArrow(_colliding, "a long, b long").distinct()
    pairs = stored(pairs, "dedup-pairs")
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    sets = docs.mapInArrow(_occurrences(key_filter(F.col("key"), wanted), True), "key long, shingles binary")
    sets = stored(sets.join(wanted, "key", "left_semi").dropDuplicates(["key"]), "dedup-sets")
    links = _compared(pairs, sets)
    links = links.union(_compared(stored(_hubs(pairs, links), "dedup-hubs"), sets))
    groups = stored(components(links, "dedup-groups"), "dedup-groups")
    forget(docs.sparkSession, sets)
    late = _unmet(docs, pairs, groups)
    if late is not None:
        forget(docs.sparkSession, groups)
        groups = stored(components(links.union(late), "dedup-groups"), "dedup-groups")
    found = docs.mapInArrow(_occurrences(key_filter(F.col("node"), groups), False), "key long, doc_id long, begin long, end long")
    found = stored(found.join(groups.withColumnRenamed("node", "key"), "key"), "dedup-found")
    first = found.groupBy("component").agg(F.min("doc_id").alias("first"))
    found = found.join(first, "component").where("doc_id <> first")
    return found.groupBy("doc_id").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"), F.min("first").alias("first"))


def _merged(run_words: int):
    """(doc_id, spans, n_removed, source_doc_id) from all marks of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for begins, ends in zip(b.column(1), b.column(2), strict=True):
                i = np.concatenate([np.asarray(x.values) for x in begins.values] or [[]]).astype(np.int64)
                j = np.concatenate([np.asarray(x.values) for x in ends.values] or [[]]).astype(np.int64)
                order = np.argsort(i, kind="stable")
                i, j = i[order], np.maximum.accumulate(j[order])
                new = np.append(True, i[1:] > j[:-1])[: len(i)]
                at = np.flatnonzero(new)
                low, high = i[at], j[np.append(at[1:], len(j)) - 1]
                spans.append([{"start": x, "end": y} for x, y in zip(low.tolist(), high.tolist(), strict=True) if y - x >= run_words])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([b.column(0), pa.array(spans, kind), pa.array([sum(s["end"] - s["start"] for s in x) for x in spans], pa.int64()), b.column(3)], ["doc_id", "spans", "n_removed", "source_doc_id"])

    return run


def substring_dedup(docs: DataFrame, run_words: int = RUN) -> DataFrame:
    """(doc_id, spans, n_removed, source_doc_id): one row for each document of which passages go because an earlier one has them.

    Words stand between white space, A-Z lower-cased; spans are word numbers, end exclusive. Three kinds of text units are
    compared. Paragraphs (lines of at least PARAGRAPH words): equal ones are one component; of others MinHash bands of
    5-word shingles propose pairs, exact Jaccard similarity of 0.75 or more links them, and of each component the document
    with the smallest id keeps its paragraphs. Runs of RUN words, wherever they stand: each names the least of its shingles;
    runs whose name another document has too are compared by 64-bit hashes of all their words, so every one that a document
    with a smaller id has is found, to the passage's real ends. Pieces, which the content cuts alike wherever a passage
    stands: equal ones are one component, and again the smallest id keeps them. Adjoining
    removed units make runs, and runs of at least ``run_words`` words are removed. source_doc_id is the smallest id from
    which any unit of the document repeats. A repeat inside one document alone is no cause.

    Rows that repeat an id are one document. Null ids take no part; a null or empty text has no unit. Other columns are
    ignored. An empty table gives an empty one. Groups of copies are met once for each unit: a bucket yields pairs with
    its smallest key, between neighbours and with the paragraph that has the most links so far. Where links of those leave
    a bucket in several components, the exact join of shingle sets, in bounded blocks, compares all of its paragraphs that
    they do not join.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    docs = pick(docs, "doc_id", "text").where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = 2 * partitions(spark)  # a task sorts its part in memory
    equal = stored(docs.mapInArrow(_piece_keys(n), "part int, c0 binary, c1 binary, c2 binary, c3 binary").repartition(n, "part").mapInArrow(_later, _MARKS), "dedup-pieces")
    alike = stored(_equal_runs(docs), "dedup-runs")
    near = stored(_near_paragraphs(docs), "dedup-near")
    marks = equal.union(alike).union(near).groupBy("doc_id").agg(F.collect_list("begins").alias("begins"), F.collect_list("ends").alias("ends"), F.min("first").alias("first"))
    out = marks.mapInArrow(_merged(run_words), "doc_id long, spans array<struct<start:long,end:long>>, n_removed long, source_doc_id long")
    return out.where("n_removed > 0")
