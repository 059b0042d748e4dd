"""Approximate nearest neighbours by collision counting over single projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm._store import pick, stored

#: Projections of a vector; a vector is verified when it collides with a query in at least NEED of them.
PROJECTIONS, NEED = 48, 30
#: A window reaches WIDTH / 2 times the radius to either side of the query: a vector at the radius collides in 83 of 100 projections.
WIDTH = 2.719
#: Virtual rehashing widens the radius by this factor.
GROW = 1.35
#: Vectors of one index block.
BLOCK = 8192
#: Queries in one broadcast, and vectors in the sample that bounds every query's radius.
PACK, SAMPLE = 16_384, 2_048
SEED = 11


class Index:
    """One block of vectors, with a sorted array for each projection."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        lines = np.random.default_rng(SEED).standard_normal((vectors.shape[1], PROJECTIONS))
        spots = vectors @ lines
        self.order = np.argsort(spots, axis=0, kind="stable").T.copy()
        self.spots = np.take_along_axis(spots.T, self.order, 1).copy()
        self.lines = lines

    def search(self, query_id: int, query: np.ndarray, k: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the up to k nearest of the block within ``radius``, which bounds the k-th distance overall."""
        n = len(self.ids)
        spot = query @ self.lines
        slack = 1e-9 * (1 + np.abs(spot).max())  # equal vectors' projections can differ in their last digits
        hits = np.zeros(n, np.int64)
        low = np.array([np.searchsorted(s, x) for s, x in zip(self.spots, spot, strict=True)])
        high = low.copy()
        open_, near = np.ones(n, bool), np.full(n, np.inf)
        r = radius / GROW**3
        while True:
            r = min(r * GROW, radius)
            half, parts = WIDTH * r / 2 + slack, []
            for j in range(PROJECTIONS):
                a = np.searchsorted(self.spots[j], spot[j] - half)
                b = np.searchsorted(self.spots[j], spot[j] + half, "right")
                a, b = min(a, low[j]), max(b, high[j])
                parts += [self.order[j, a : low[j]], self.order[j, high[j] : b]]
                low[j], high[j] = a, b
            hits += np.bincount(np.concatenate(parts), minlength=n)
            some = np.flatnonzero(open_ & (hits >= NEED))
            open_[some] = False
            near[some] = np.sqrt(((self.vectors[some] - query) ** 2).sum(1))
            near[self.ids == query_id] = np.inf
            if r >= radius or (near <= r).sum() >= k:
                break
        found = np.flatnonzero(np.isfinite(near))
        found = found[np.lexsort((self.ids[found], near[found]))[:k]]
        return self.ids[found], near[found]


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of ``queries`` the k nearest rows of ``vectors`` with another id.

    Nearness is the Euclidean distance in double precision, smallest first, ties to the smaller id; score is that
    distance. Every vector is indexed, in blocks: one sorted array for each of some random projections. A query's window
    in each array widens around its own projection until, of the vectors that collide in enough arrays and so are
    verified, k lie within the radius, or the radius reaches the query's k-th distance to a fixed-size sample of the
    vectors, beyond which nothing can matter. A vector within the radius is missed with a chance of under 1 in 1,000.
    Queries go out in packs of fixed size; each pack is one pass over the blocks, and each block gives k rows a query.

    No part take, on either side: null ids, null vectors, vectors with null, NaN or infinite components, zero vectors and
    those of another than the most frequent length. Fewer than k candidates: all that there are. Rows that repeat an id
    stay apart as candidates; as queries the first of them by its components counts. Other columns are ignored. An empty
    table on either side gives an empty one.
    """
    spark = vectors.sparkSession

    def sound(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return pick(df, id_col, vector_col).where(F.col(id_col).isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    schema = "query_id long, rank int, vec_id long, score double"
    base = sound(vectors)
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim = sizes["d"]
    base = base.where(F.size("v") == dim)
    asked = sound(queries).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    total = base.count()
    sample = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    sample_ids, sample_x = np.asarray(sample["id"]), _vectors(sample["v"].combine_chunks(), dim)
    blocks = stored(base.repartition(max(1, -(-total // BLOCK)), F.xxhash64("id", F.lit(1))), "vectors")

    def search(ids: np.ndarray, x: np.ndarray, radii: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # whatever a partition holds, it is indexed a block at a time
            held, n = [], 0

            def out() -> pa.RecordBatch:
                index = Index(np.concatenate([np.asarray(b.column(0)) for b in held]), np.vstack([_vectors(b.column(1), dim) for b in held]))
                found = [(q, *index.search(q, v, k, r)) for q, v, r in zip(ids.tolist(), x, radii.tolist(), strict=True)]
                return pa.record_batch([pa.array(np.repeat(ids, [len(f[1]) for f in found])), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], ["query_id", "vec_id", "score"])

            for b in batches:
                held.append(b)
                n += b.num_rows
                if n >= BLOCK:
                    yield out()
                    held, n = [], 0
            if n:
                yield out()

        return run

    found = None
    for ids, x in _packs(asked, dim):
        radii = np.empty(len(ids))
        for i in range(len(ids)):
            d = np.sort(np.sqrt(((sample_x[sample_ids != ids[i]] - x[i]) ** 2).sum(1)))
            # too small a sample bounds nothing: as far as any vector can be
            radii[i] = d[k - 1] * (1 + 1e-9) if len(d) >= k else np.inf
        if not np.isfinite(radii).all():
            longest = blocks.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y))).first()[0] ** 0.5
            radii = np.where(np.isfinite(radii), radii, (longest + np.sqrt((x**2).sum(1))) * 40)
        part = blocks.mapInArrow(search(ids, x, radii), "query_id long, vec_id long, score double")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packs(asked: DataFrame, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries, so many at a time."""
    ids, x = [], []
    for r in asked.toLocalIterator():
        ids.append(r["id"])
        x.append(r["v"])
        if len(ids) == PACK:
            yield np.array(ids, np.int64), np.array(x)
            ids, x = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(x).reshape(-1, dim)
