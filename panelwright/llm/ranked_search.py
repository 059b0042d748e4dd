"""Ranked lexical search for many queries at once: term sets that queries share are evaluated once for each document."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm._store import arrow_rows, forget, new_path, pick, slices, stored
from panelwright.llm._words import ALNUM, terms

#: Documents returned for each item.
TOP = 50
#: Text of one set of items; more items take one further pass over the documents for each so many bytes.
ITEM_BYTES = 1 << 22
#: Accumulators (nodes times documents) that a task holds at once.
CELLS = 1 << 21


@dataclass
class Shared:
    """A graph of sums: leaves are the terms, each node adds two earlier ones, each item adds the nodes of its list."""

    n_terms: int
    left: np.ndarray
    right: np.ndarray
    levels: list[tuple[int, int]]
    members: np.ndarray
    first: np.ndarray

    @property
    def size(self) -> int:
        return self.n_terms + len(self.left)

    def evaluate(self, leaves: np.ndarray) -> np.ndarray:
        """Items by documents, from terms by documents: every node's partial accumulators are made once."""
        acc = np.empty((self.size, leaves.shape[1]), np.int64)
        acc[: self.n_terms] = leaves
        for i, j in self.levels:
            at = slice(self.n_terms + i, self.n_terms + j)
            np.add(acc[self.left[i:j]], acc[self.right[i:j]], out=acc[at])
        return np.add.reduceat(acc[self.members], self.first, axis=0)


def shared(items: list[list[int]], n_terms: int) -> Shared:
    """Mines the term sets that several items share.

    Each item is a list of its terms, those of the most items first. In every round, neighbours that stand together in
    several items' lists become a node, the most frequent such pairs first, no symbol in two pairs of a round; a
    node's members are a shared set, which later rounds let grow. Rounds end when no pair recurs. Lists shrink with
    every round, so mining is linear in the items' terms but for the rounds. Every item has a term.
    """
    often = Counter(t for x in items for t in x)
    lists = [sorted(x, key=lambda t: (-often[t], t)) for x in items]
    left, right, levels = [], [], []
    while True:
        pairs = Counter(p for x in lists for p in zip(x, x[1:], strict=False))
        busy, chosen = set(), {}
        begin = len(left)
        for (a, b), n in sorted(pairs.items(), key=lambda kv: (-kv[1], kv[0])):
            if n < 2:
                break
            if a not in busy and b not in busy:
                busy |= {a, b}
                chosen[a, b] = n_terms + len(left)
                left.append(a)
                right.append(b)
        if not chosen:
            break
        levels.append((begin, len(left)))
        for k, x in enumerate(lists):
            out, i = [], 0
            while i < len(x):
                node = chosen.get((x[i], x[i + 1])) if i + 1 < len(x) else None
                out.append(x[i] if node is None else node)
                i += 1 if node is None else 2
            lists[k] = out
    sizes = np.array([len(x) for x in lists])
    return Shared(n_terms, np.array(left, np.int64), np.array(right, np.int64), levels, np.array([t for x in lists for t in x], np.int64), np.cumsum(sizes) - sizes)


def _chunks(items: DataFrame, limit: int) -> Iterator[tuple[list, list[list[int]], list[str]]]:
    """Item ids, their lists of terms and the terms, so many bytes of text at a time; items without terms are left out."""
    ids, lists, codes, held = [], [], {}, 0
    for r in items.toLocalIterator():
        words, _ = terms(pa.array(r["texts"], pa.string()), ALNUM)
        if own := words.unique().to_pylist():
            ids.append(r["item_id"])
            lists.append([codes.setdefault(t, len(codes)) for t in own])
            held += sum(len(t) for t in own)
        if held >= limit:
            yield ids, lists, list(codes)
            ids, lists, codes, held = [], [], {}, 0
    if ids:
        yield ids, lists, list(codes)


def _postings(known: list[str]):
    """(doc_id, n_terms, terms, counts) of each document with a term; the terms that items have, and how often each occurs."""
    table = pa.array(known, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, stop in slices(b, 1):
                words, first = terms(b.column(1)[row:stop], ALNUM)
                n = np.diff(first)
                code = pc.index_in(words, value_set=table).fill_null(-1).to_numpy()
                owner = np.repeat(np.arange(stop - row), n)
                pair, count = np.unique((owner * len(known) + code)[code >= 0], return_counts=True)
                owner, code = np.divmod(pair, len(known))
                edges = np.searchsorted(owner, np.arange(stop - row + 1))
                code, count = code.astype("<i4"), count.astype("<i4")
                full = np.flatnonzero(n)
                blobs = [pa.array([x[edges[i] : edges[i + 1]].tobytes() for i in full], pa.binary()) for x in (code, count)]
                yield pa.record_batch([b.column(0)[row:stop].take(pa.array(full)), pa.array(n[full], pa.int64()), *blobs], ["doc_id", "n_terms", "terms", "counts"])

    return run


def _frequencies(n_terms: int):
    """(term, df) of a partition's postings; term -1 has their number, -2 the number of all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, length = np.zeros(n_terms, np.int64), 0, 0
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4"), minlength=n_terms)
            documents += b.num_rows
            length += int(np.asarray(b.column(0)).sum())
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([df[at], [documents, length]]))], ["term", "df"])

    return run


class _Best:
    """Each item's best documents so far."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.rows: dict[int, list[tuple[np.ndarray, pa.Array]]] = defaultdict(list)
        self.held = np.zeros(items, np.int64)
        self.least = np.ones(items, np.int64)

    def take(self, scores: np.ndarray, ids: pa.Array) -> None:
        """``scores`` items by documents."""
        hit = scores >= self.least[:, None]
        for k in np.flatnonzero(hit.any(1)).tolist():
            at = np.flatnonzero(hit[k])
            self.rows[k].append((scores[k, at], ids.take(pa.array(at))))
            self.held[k] += len(at)
            if self.held[k] > 4 * self.top:
                self.settle(k)

    def settle(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """The best so far, equal scores by id."""
        found = pa.table({"score": np.concatenate([s for s, _ in self.rows[k]]), "doc_id": pa.concat_arrays([i for _, i in self.rows[k]])})
        order = pc.sort_indices(found, sort_keys=[("score", "descending"), ("doc_id", "ascending")], null_placement="at_end")[: self.top]
        found = found.take(order)
        score, ids = found["score"].to_numpy(), pa.concat_arrays(found["doc_id"].chunks)
        if len(score) == self.top:
            self.least[k] = score[-1]
        self.rows[k], self.held[k] = [(score, ids)], len(score)
        return score, ids


def _searched(graph: Shared, weight: np.ndarray, documents: int, length: int, top: int):
    """(item, doc_id, score) of a partition's best documents for each item."""
    most = max(1, CELLS // graph.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(graph.first), top)
        for b in batches:
            for i in range(0, b.num_rows, most):
                part = b.slice(i, most)
                code = [np.frombuffer(x, "<i4") for x in part.column(2).to_pylist()]
                count = [np.frombuffer(x, "<i4") for x in part.column(3).to_pylist()]
                # Python's integers: the product passes 64 bits where texts and tables are long
                m = np.array([50 + 50 * n * documents // length for n in part.column(1).to_pylist()], np.int64)
                owner = np.repeat(np.arange(part.num_rows), [len(x) for x in code])
                code, count = np.concatenate(code), np.concatenate(count).astype(np.int64)
                leaves = np.zeros((graph.n_terms, part.num_rows), np.int64)
                leaves[code, owner] = weight[code] * (1_000_000_000 * count // (1000 * count + 20 * m[owner]))
                best.take(graph.evaluate(leaves), part.column(0))
        for k in sorted(best.rows):
            score, ids = best.settle(k)
            yield pa.record_batch([pa.array(np.full(len(score), k)), pa.array(score), ids], ["item", "score", "doc_id"])

    return run


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of ``docs`` (doc_id, text) for each item of ``items`` (item_id, text).

    Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. With N the documents that have a
    term and L all their terms, a term in df of them weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))); a document of n
    terms has m = 50 + (50 n N) div L, and scores the sum over the item's different terms of
    w ((10^9 tf) div (1000 tf + 20 m)). Documents with a score above 0 are ranked by falling score, then by id, null last.

    1. One pass over the texts writes postings of the items' terms, and sums of them give N, L and df: a number a term.
    2. Term sets that items share are mined into a graph of sums (``shared``). Tasks read postings, make each node's
       partial accumulators once for a block of documents, and combine them along the graph into all items' scores.
    3. A task hands on its best documents of each item; ranks are given by item.

    Items go to the tasks in sets of at most ``item_bytes`` of different terms; further sets take further passes. Rows
    that repeat an item_id are one item with the terms of all. Items without a term have no row. Null and empty texts
    have no term. Rows that repeat a doc_id are documents each; a null doc_id stays null. Other columns are ignored. An
    empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    docs = pick(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    items = pick(items, "item_id", "text")
    grouped = items.groupBy("item_id").agg(F.sort_array(F.collect_list("text")).alias("texts"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    path = new_path(spark, "search-ranked")
    item_kind = items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {item_kind}, rank int, doc_id {kind}, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for ids, lists, known in _chunks(grouped, item_bytes):
        postings = stored(docs.mapInArrow(_postings(known), f"doc_id {kind}, n_terms long, terms binary, counts binary"), "search-postings")
        found = postings.select("n_terms", "terms").mapInArrow(_frequencies(len(known)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df = dict(zip(found["term"].to_pylist(), found["df"].to_pylist(), strict=True))
        documents, length = df.get(-1, 0), df.get(-2, 0)
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(known))], np.int64)
        best = postings.mapInArrow(_searched(shared(lists, len(known)), weight, documents, length, top), f"item long, score long, doc_id {kind}")
        names = spark.createDataFrame([(k, x) for k, x in enumerate(ids)], f"item long, item_id {item_kind}")
        ranked = best.join(F.broadcast(names), "item").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # the ids of one set of items
        ranked.select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
        forget(spark, postings)
    return spark.read.schema(schema).parquet(path)
