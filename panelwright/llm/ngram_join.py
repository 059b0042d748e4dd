"""N-gram Jaccard join by a token-group matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm._graph import components
from panelwright.llm._store import arrow_rows, forget, partitions, pick, slices, stored
from panelwright.llm._words import SPACED, mix, shingle_sets, words

WORDS = 5
#: A link needs DENOM * intersection >= NUMER * union.
NUMER, DENOM = 75, 100
#: A shingle among the first quarter of so many different sets counts as common; common shingles come last in the prefix order.
COMMON = 8
#: The order, which does not change results, knows so many common shingles, the most frequent: what is broadcast has a bound.
COMMON_MOST = 1 << 20
#: Keys by which a shingle's sets are counted: exact below, an estimate from the least keys beyond.
LEAST = 16
#: Members of a group, and bytes of their rows of bits, about; a longer row is a group alone.
BLOCK, BLOCK_BYTES = 128, 1 << 18
#: Bits of a row for each shingle, at least; rows are powers of two.
ROW_BITS = 8
#: Bits of the fixed-size filter that spares documents without candidates the shuffle of their sets.
FILTER_BITS = 1 << 25

U64 = np.uint64


def needed(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | int:
    """The smallest intersection with which sets of n and m shingles link."""
    return -(-NUMER * (n + m) // (NUMER + DENOM))


def _sets(batch: pa.RecordBatch, row: int, stop: int) -> list[np.ndarray]:
    return shingle_sets(words(batch.column(1)[row:stop], SPACED), WORDS)


def _digest(s: np.ndarray) -> int:
    """A signed 64-bit key of a set."""
    return int(mix(mix(s).sum(dtype=U64, keepdims=True) + U64(len(s))).view(np.int64)[0])


def _row_bits(s: np.ndarray) -> bytes:
    """A set as a row of bits, a power of two in all, so that longer rows fold onto shorter ones."""
    size = max(64, 1 << (ROW_BITS * len(s) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(s & U64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, set_key, bits) of each document."""
    for b in batches:
        n, key, bits = [], [], []
        for row, stop in slices(b, 1):
            for s in _sets(b, row, stop):
                n.append(len(s))
                key.append(_digest(s))
                bits.append(_row_bits(s))
        yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "n_shingles", "set_key", "bits"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows (a, b, n and bits of one, n and bits of the other) that the bound on their overlap lets link.

    What one set has and the other lacks is at least the number of bits that only the one's row has.
    """
    for batch in batches:
        keep = []
        for n, x, m, y in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), batch.column(5), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
            size = min(len(x), len(y))
            x, y = np.bitwise_or.reduce(x.reshape(-1, size)), np.bitwise_or.reduce(y.reshape(-1, size))
            both = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
            keep.append(both >= needed(n, m))
        yield pa.record_batch(batch.filter(pa.array(keep, pa.bool_())).columns[:2], ["a", "b"])


def _prefix(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles one of which any linking set shares among its own such: the first in an order that puts common ones last."""
    n = len(s)
    length = n - math.ceil(NUMER * n / DENOM) + 1
    if len(common):
        is_common = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
        s = np.concatenate([s[~is_common], s[is_common]])
    return s[:length]


def _packs(common: np.ndarray, parts: int):
    """Rows (part, tokens, keys, sizes): the prefix shingles of every different set of a partition, dealt out and packed.

    A common shingle is dealt out by shingle and set, any other by the shingle alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        tokens, keys, sizes, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            token, lengths = np.concatenate(tokens), np.array([len(x) for x in tokens])
            key, size = np.repeat(np.array(keys, np.int64), lengths), np.repeat(np.array(sizes, np.int32), lengths)
            salt = np.where(_among(common, token)[1], mix(key.view(U64)), U64(0))
            part = (mix(token + salt) % U64(parts)).astype(np.int32)
            return _dealt(part, {"tokens": token, "keys": key, "sizes": size})

        for b in batches:
            for row, stop in slices(b, 1):
                for s in _sets(b, row, stop):
                    if len(s) and (key := _digest(s)) not in seen:
                        seen.add(key)
                        tokens.append(_prefix(s, common))
                        keys.append(key)
                        sizes.append(len(s))
                        held += len(tokens[-1])
                if held > 500_000:
                    yield out()
                    tokens, keys, sizes, held = [], [], [], 0
        if held:
            yield out()

    return run


def _dealt(part: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each part, with its entries of every column as bytes."""
    order = np.argsort(part, kind="stable")
    edge = np.flatnonzero(np.diff(part[order], prepend=-1))
    stops = np.append(edge[1:], len(part))
    blobs = [pa.array([x[i:j].tobytes() for i, j in zip(edge, stops, strict=True)], pa.binary()) for x in (c[order] for c in columns.values())]
    return pa.record_batch([pa.array(part[order][edge]), *blobs], ["part", *columns])


def _among(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys are in a sorted table, and whether they are."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _read(batches: Iterator[pa.RecordBatch], **kinds: type) -> list[np.ndarray] | None:
    """The packed columns of a partition, end to end."""
    cols: list[list] = [[] for _ in kinds]
    for b in batches:
        for into, (c, kind) in zip(cols, kinds.items(), strict=True):
            into += [np.frombuffer(x.as_buffer(), kind) for x in b.column(b.schema.get_field_index(c))]
    return [np.concatenate(x) for x in cols] if cols[0] else None


def _runs(token: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of distinct (token, key) pairs, where each token begins in it, and how many keys it has."""
    order = np.lexsort((key, token))
    token, key = token[order], key[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
    order, token = order[fresh], token[fresh]
    begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    return order, begin, np.diff(np.append(begin, len(token)))


def _least(token: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each token's LEAST least keys, in order, where the tokens begin, and their numbers of keys."""
    order, begin, length = _runs(token, key)
    rank = np.arange(len(order)) - np.repeat(begin, length)
    order, length = order[rank < LEAST], np.minimum(length, LEAST)
    return token[order], key[order], np.cumsum(length) - length, length


def _counted(parts: int):
    """Rows (part, tokens, keys): of every shingle that stands in a prefix, the least keys of a pack; hot shingles take no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _packs(np.zeros(0, U64), 1)(batches):
            token, key = _read(iter([b]), tokens=U64, keys=U64)
            token, key, _, _ = _least(token, mix(key))
            yield _dealt((mix(token) % U64(parts)).astype(np.int32), {"tokens": token, "keys": key})

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of the prefix shingles that COMMON different sets hold; n is estimated beyond LEAST sets."""
    if (found := _read(batches, tokens=U64, keys=U64)) is not None:
        token, key, begin, length = _least(*found)
        last = key[begin + length - 1].astype(np.float64) + 1
        n = np.where(length < LEAST, length, (LEAST - 1) * 2.0**64 / last).astype(np.int64)
        keep = length >= COMMON
        yield pa.record_batch([pa.array(token[begin][keep].view(np.int64)), pa.array(n[keep])], ["token", "n"])


def _shared(common: np.ndarray, often: np.ndarray):
    """(token, key, n, sets) of the prefix shingles that two different sets hold; sets says of how many, about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := _read(batches, tokens=U64, keys=np.int64, sizes=np.int32)) is None:
            return
        token, key, size = found
        order, begin, length = _runs(token, key)
        at, known = _among(common, token[order][begin])
        sets = np.where(known, often[at] if len(often) else 0, length)
        keep = np.repeat(known | (length > 1), length)
        order, sets = order[keep], np.repeat(sets, length)[keep]
        for i in range(0, len(order), 100_000):
            o = order[i : i + 100_000]
            yield pa.record_batch([pa.array(token[o].view(np.int64)), pa.array(key[o]), pa.array(size[o]), pa.array(sets[i : i + 100_000])], ["token", "key", "n", "sets"])

    return run


def _some_sets(mask: np.ndarray):
    """(set_key, tokens) of the documents that the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.asarray(b.column(2))
            b = b.filter(pa.array(passing(mask, at)))
            for row, stop in slices(b, 1):
                some = _sets(b, row, stop)
                yield pa.record_batch([pa.array([_digest(s) for s in some], pa.int64()), pa.array([s.tobytes() for s in some], pa.binary())], ["set_key", "tokens"])

    return run


def _place(id_: Column) -> Column:
    """An id's bit in the filter: its low bits, which differ between running numbers as between hashes."""
    return F.pmod(id_, F.lit(FILTER_BITS))


def passing(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the filter has the bits ``at``."""
    return (mask[at >> 6] >> (at & 63).astype(U64) & U64(1)).astype(bool)


def key_filter(ids: Column, of: DataFrame) -> np.ndarray:
    """A bit for each value of a hash of the ids; of fixed size, however many there are."""
    at = of.select(_place(ids).alias("at"))
    words_ = at.groupBy(F.shiftright("at", 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits")).toArrow()
    mask = np.zeros(FILTER_BITS // 64, U64)
    mask[np.asarray(words_["w"])] = np.asarray(words_["bits"]).view(U64)
    return mask


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, ra, rb) of the rows (a, b, ra, one set, rb, another) that link: direct comparison."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(3), batch.column(5), strict=True):
            x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            keep.append(int((both[1:] == both[:-1]).sum()) >= needed(len(x), len(y)))
        kept = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.record_batch([kept.column(i) for i in (0, 1, 2, 4)], ["a", "b", "ra", "rb"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the members of two groups, one row each pair of groups, that their sizes and the bound let link.

    The bound holds a set's row of bits first against the union of a group's rows, and only what passes against each.
    Members that links join already are not paired again. A group paired with itself has no second list of members.
    """

    def rows(group: pa.Scalar) -> tuple[np.ndarray, ...]:
        x = group.values
        bits = x.field("bits")
        return *(np.asarray(x.field(c)) for c in ("key", "n", "g")), np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(len(x), -1)

    for batch in batches:
        left, right = [], []
        for one, other in zip(batch.column(0), batch.column(1), strict=True):
            a, n, g, x = rows(one)
            b, m, h, y = rows(other) if other.is_valid else (a, n, g, x)
            size = min(x.shape[1], y.shape[1])
            x, y = (np.bitwise_or.reduce(z.reshape(len(z), -1, size), 1) for z in (x, y))
            for i in np.flatnonzero(n - np.bitwise_count(x & ~np.bitwise_or.reduce(y)).sum(1) >= needed(n, np.maximum(m.min(), -(-NUMER * n // DENOM)))):
                at = np.flatnonzero((h != g[i]) & (needed(n[i], m) <= np.minimum(n[i], m)))
                at = at if other.is_valid else at[at > i]
                both = np.minimum(n[i] - np.bitwise_count(x[i] & ~y[at]).sum(1), m[at] - np.bitwise_count(y[at] & ~x[i]).sum(1))
                hit = at[both >= needed(n[i], m[at])]
                left.append(np.repeat(a[i], len(hit)))
                right.append(b[hit])
        if left:
            yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in (left, right)], ["a", "b"])


class _Sets:
    """The documents' sets: rows of bits at hand, the sets themselves made again for those that are asked for."""

    def __init__(self, docs: DataFrame, keyed: DataFrame, reps: DataFrame):
        self.docs, self.keyed, self.reps = docs.withColumn("at", _place(F.col("doc_id").cast("long"))), keyed, reps

    def rows(self, keys: DataFrame) -> DataFrame:
        """``keys``, one row for each set_key, with n and bits of the set."""
        of = self.keyed.select(F.col("doc_id").alias("rep"), F.col("set_key").alias("k"), F.col("n_shingles").alias("n"), "bits")
        found = self.reps.select("rep", "set_key").join(keys, "set_key").join(of, "rep").where("k = set_key")
        return found.dropDuplicates(["set_key"]).drop("rep", "k")  # rows that repeat an id with equal texts

    @staticmethod
    def both(pairs: DataFrame, side: DataFrame, *cols: str) -> DataFrame:
        """``pairs`` (a, b) with the columns of both keys in ``side``."""
        for end in "ab":
            pairs = pairs.join(side.select(F.col("set_key").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in cols]), end)
        return pairs.select("a", "b", *[f"{end}_{c}" for end in "ab" for c in cols])

    @staticmethod
    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("set_key")).union(pairs.select(F.col("b").alias("set_key"))).distinct()

    def possible(self, pairs: DataFrame) -> DataFrame:
        return stored(self.both(pairs, self.rows(self.ends(pairs)), "n", "bits").mapInArrow(_possible, "a long, b long"), "join-possible")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link, with their representatives ra and rb, as a written table: sets are compared."""
        ids = stored(self.reps.select("rep", "set_key").join(self.ends(pairs), "set_key"), "join-wanted")
        sets = self.docs.mapInArrow(_some_sets(key_filter(F.col("rep"), ids)), "set_key long, tokens binary")
        sets = stored(ids.join(sets, "set_key").dropDuplicates(["set_key"]), "join-sets")
        out = stored(self.both(pairs, sets, "rep", "tokens").mapInArrow(_linked, "a long, b long, ra long, rb long"), "join-linked")
        forget(pairs.sparkSession, ids, sets)
        return out


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", joined: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies): each document's class under all links of 5-word shingle sets.

    ``joined`` (node, component long) names ids that links are known to join, a row for each id: they are one class from
    the start, and no two of one class are compared. Ids that are not in ``docs`` do no harm there.

    Two sets link when 100 times their intersection reaches 75 times their union; component_id is the smallest id that
    links reach. n_copies counts the documents whose set is exactly this one, itself included.

    1. Equal sets are one class; only its representative goes on, so that groups of copies cost what one text does.
    2. Two linking sets share a shingle among the first quarter of each, in an order that puts common shingles last.
       Those prefixes, dealt out by shingle (common ones by shingle and set, so that no task gets all of one), are the
       token-group matrix's entries.
    3. Sets whose commonest prefix shingle is the same are a group. Each is compared with the group's medoid, the member
       whose prefix the fewest shingles of its own interrupt; those that link are one component from here on. The centres
       that remain are compared in the same way, in groups by their first shingle: families of variants contract.
    4. A group's members of like size form blocks of bounded bytes. The matrix holds, for each shingle, the blocks whose
       token union has it, with the ranges of those members' sizes and components. Two blocks are opened where they
       share a shingle, the sizes allow the intersection that a link needs, and links do not join all members already.
    5. A query's overlap with a block is bounded by rows of bits: against the union of the block's rows, and where that
       qualifies, the block is opened and its members' own rows are bounds. What passes is compared set by set.

    Sets are compared by 64-bit hashes of their shingles. A null or empty text, and one without words, has no shingle,
    links with nothing and is its own component. Fewer than five words: the whole sequence is the one shingle. Repeated
    ids: each row counts, and the rows of one id are one node, whatever their texts. A row with a null id takes part in no link; its component_id is null. Any
    other columns of ``docs`` are ignored. An empty table gives an empty one.
    """
    spark: SparkSession = docs.sparkSession
    arrow_rows(spark)
    docs = pick(docs, id_col, text_col).toDF("doc_id", "text")
    keyed = stored(docs.mapInArrow(_keys, "doc_id long, n_shingles long, set_key long, bits binary"), "join-keys")
    docs = docs.where("doc_id is not null")
    reps = stored(keyed.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")), "join-reps")
    sets = _Sets(docs, keyed, reps)

    n = 2 * partitions(spark)  # a task sorts its part in memory
    found = docs.mapInArrow(_counted(n), "part int, tokens binary, keys binary").repartition(n, "part").mapInArrow(_frequent, "token long, n long").orderBy(F.desc("n"), "token").limit(COMMON_MOST).toArrow()
    common, often = np.asarray(found["token"]).view(U64), np.asarray(found["n"])
    common, often = common[np.argsort(common)], often[np.argsort(common)]
    entries = docs.mapInArrow(_packs(common, n), "part int, tokens binary, keys binary, sizes binary").repartition(n, "part")
    matrix = stored(entries.mapInArrow(_shared(common, often), "token long, key long, n int, sets long"), "join-matrix")

    # two groupings of each set: by its commonest prefix shingle, and by the first in the order of hashes
    lead = F.max(F.struct("sets", "token"))["token"].alias("lead"), F.min(F.expr("token ^ (-9223372036854775808L)")).alias("first")
    lead = stored(matrix.groupBy("key").agg(*lead, F.first("n").alias("n"), (F.count("*") / F.first("n")).alias("usual")), "join-lead")
    links, now = [], lead.withColumn("g", F.col("key"))
    given = None
    if joined is not None:
        given = stored(keyed.where("n_shingles > 0").join(joined, F.col("doc_id") == F.col("node")).select("set_key", "component").distinct(), "join-given")
        given = given.join(given.groupBy("component").agg(F.min("set_key").alias("to")), "component").groupBy("set_key").agg(F.min("to").alias("to"))
        given = stored(given, "join-given-sets")
        now = now.join(given.withColumnRenamed("set_key", "key"), "key", "left").withColumn("g", F.coalesce("to", "key")).drop("to")
    for by in ("lead", "first"):
        centres = now.where("key = g")
        medoids = centres.groupBy(by).agg(F.max(F.struct("usual", "key")).alias("m"), F.count("*").alias("k")).where("k > 1").select(by, F.col("m.key").alias("b"))
        links.append(sets.linked(sets.possible(centres.join(medoids, by).where("key <> b").select(F.col("key").alias("a"), "b"))))
        now = now.join(links[-1].select(F.col("a").alias("g"), F.col("b").alias("to")), "g", "left").withColumn("g", F.coalesce("to", "g")).drop("to")

    # rows of one length, so that a block's can be laid under each other
    size = F.greatest(F.length(F.bin(ROW_BITS * F.col("n") - 1)), F.lit(6))
    members = stored(now.select(F.col("key").alias("set_key"), "lead", "n", "g", size.alias("size")), "join-grouped")
    room = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.expr("shiftleft(1L, size - 3)")) / BLOCK_BYTES))
    several = stored(members.groupBy("lead", "size").agg(room.alias("blocks")).where("blocks > 1"), "join-several")
    members = members.join(several, ["lead", "size"], "left")
    members = stored(members.select("set_key", "n", "g", F.xxhash64("lead", "size", F.pmod(F.xxhash64("set_key"), F.coalesce("blocks", F.lit(1)))).alias("block")), "join-members")

    ranges = [f(c).alias(f"{c}_{end}") for c in ("n", "g") for end, f in (("low", F.min), ("high", F.max))]
    unions = stored(matrix.select("token", "key").join(members.withColumnRenamed("set_key", "key"), "key").groupBy("token", "block").agg(*ranges), "join-unions")
    one, other = unions.alias("x"), unions.alias("y")
    fits = (DENOM * F.col("y.n_high") >= NUMER * F.col("x.n_low")) & (DENOM * F.col("x.n_high") >= NUMER * F.col("y.n_low"))
    differ = F.least("x.g_low", "y.g_low") < F.greatest("x.g_high", "y.g_high")
    opened = one.join(other, F.expr("x.token = y.token AND x.block < y.block") & fits & differ).select(F.col("x.block").alias("a"), F.col("y.block").alias("b"))
    alone = unions.where("g_low < g_high").select(F.col("block").alias("a"), F.col("block").alias("b"))
    opened = stored(opened.union(alone).distinct(), "join-opened")

    rows = sets.rows(members.join(sets.ends(opened).withColumnRenamed("set_key", "block"), "block").drop("n"))
    blocks = rows.groupBy("block").agg(F.collect_list(F.struct(F.col("set_key").alias("key"), "n", "g", "bits")).alias("members"))
    blocks = stored(blocks.withColumnRenamed("block", "set_key"), "join-blocks")
    both = sets.both(opened.where("a < b"), blocks, "members").select("a_members", "b_members")
    itself = blocks.join(opened.where("a = b").select(F.col("a").alias("set_key")), "set_key").select(F.col("members").alias("a_members"), F.lit(None).cast(blocks.schema["members"].dataType).alias("b_members"))
    links.append(sets.linked(stored(both.union(itself).mapInArrow(_opened, "a long, b long"), "join-candidates")))

    edges = reduce(DataFrame.union, links).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    if given is not None:
        own = reps.select("set_key", F.col("rep").alias("a"))
        edges = edges.union(given.join(own, "set_key").join(reps.select(F.col("set_key").alias("to"), F.col("rep").alias("b")), "to").select("a", "b"))
    # an id whose rows have different sets is one node: it joins the sets' representatives
    several = stored(keyed.where("doc_id is not null").groupBy("doc_id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b")).where("a <> b").select("doc_id"), "join-several-ids")
    held = stored(keyed.where("n_shingles > 0").join(several, "doc_id").join(reps, "set_key").select("doc_id", "rep").distinct(), "join-held")
    hubs = held.groupBy("doc_id").agg(F.min("rep").alias("hub"))
    edges = edges.union(held.join(hubs, "doc_id").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    every = components(edges)
    whole = stored(hubs.join(every, hubs["hub"] == every["node"], "left").select("doc_id", F.coalesce("component", "hub").alias("whole")), "join-whole")
    classes = reps.join(every, reps["rep"] == every["node"], "left").select("set_key", F.coalesce("component", "rep").alias("c"), "n_copies")
    out = keyed.join(classes, "set_key", "left").join(whole, "doc_id", "left")
    own = F.when(F.col("whole").isNotNull(), F.col("whole")).when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id"))
    copies = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("n_copies")).otherwise(F.lit(1))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), copies.cast("long").alias("n_copies"))
