"""A hierarchical Pitman-Yor language model: a restaurant for each word before, seated by Gibbs sweeps; predictive probabilities averaged over them."""

from __future__ import annotations

import copy
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm._store import arrow_rows, forget, partitions, pick, slices, stored
from panelwright.llm._words import SPACED, mix, words

#: Discount and strength of the contexts' restaurants and of the parent that they share.
DISCOUNT, STRENGTH = 0.75, 10.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.6, 10.0
#: Gibbs sweeps, and how many of the first give no probabilities.
SWEEPS, BURN_IN = 4, 1
#: Customers of a dish up to which Stirling numbers come from a table; those of more are summed or integrated.
TABLED = 1024
#: Tokens in one pack of documents; a longer document is a pack alone.
PACK_TOKENS = 3_000_000
SEED = 5
#: The word that ends every text, and the context of a text's first word; no word's bytes hash to it but by chance.
END = np.uint64(0xE4D0F7E87)
U64 = np.uint64


def events(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all tokens, each text's end included, and the number of tokens of each text; a token's context is the whole word before."""
    w = words(texts, SPACED)
    n = w.counts + 1
    inner = np.ones(int(n.sum()), bool)
    inner[np.cumsum(n) - 1] = False
    word = np.full(len(inner), END, U64)
    word[inner] = w.hash
    return word, n


def _packs(parts: int):
    """A row for each pack of documents: its distinct words by part, where the commonest, the next and so on are, and every token's rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        held, tokens, serial = [], 0, 0

        def out() -> pa.RecordBatch:
            nonlocal held, tokens, serial
            ids, test, word, n = (np.concatenate(x) for x in zip(*held, strict=True))
            own, token = _distinct(word)
            count = np.bincount(token)
            part = _part(own, parts)
            order = np.lexsort((own, part))
            place, rank = np.empty(len(order), np.uint32), np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            common = np.argsort(-count, kind="stable")
            rank[common] = np.arange(len(order), dtype=np.uint32)
            end = int(place[np.searchsorted(own, END)])
            cols = _blobs(ids, test, n.astype(np.int32), rank[token], place[common], own[order], np.bincount(part, minlength=parts).astype(np.int32))
            number, held, tokens, serial = base + serial, [], 0, serial + 1
            return pa.record_batch([pa.array([number], pa.int64()), pa.array([end], pa.int64()), *cols], ["pack", "end", "ids", "test", "sizes", "tokens", "ranks", "words", "lengths"])

        for b in batches:
            for row, stop in slices(b, 2):
                word, n = events(b.column(2)[row:stop])
                held.append((np.asarray(b.column(0)[row:stop]), np.asarray(b.column(1)[row:stop].cast(pa.uint8())).astype(bool), word, n))
                tokens += len(word)
                if tokens >= PACK_TOKENS:
                    yield out()
        if held:
            yield out()

    return run


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The partition of a word, as a dish and as a context."""
    return (mix(hashes) % U64(parts)).astype(np.int32)


def _pairs(tokens: np.ndarray, ranks: np.ndarray, end: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A pack's distinct (word, context) pairs, by place of the word and then of the context, and each token's pair."""
    word = ranks[tokens].astype(np.int64)
    before = np.empty(len(word), np.int64)
    before[1:] = word[:-1]
    before[np.cumsum(sizes) - sizes] = end
    word *= len(ranks)
    word += before
    del before
    keys, pair = _distinct(word)
    return keys // len(ranks), keys % len(ranks), pair


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers and the place of each number among them, in a third of the memory that numpy's own takes."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    ordered = ordered[new]
    place = np.empty(len(x), np.uint32)
    place[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return ordered, place


def _blob(x: np.ndarray) -> bytes:
    """A blob of numbers; those of four bytes, mostly small, are compressed byte plane by byte plane."""
    if x.dtype.itemsize != 4:
        return x.tobytes()
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _numbers(x, kind=np.uint32) -> np.ndarray:
    x = x.as_buffer() if isinstance(x, pa.Scalar) else pa.py_buffer(x)
    if np.dtype(kind).itemsize != 4:
        return np.frombuffer(x, kind)
    planes = pa.decompress(x.slice(8), int.from_bytes(x.slice(0, 8).to_pybytes(), "little"), "zstd")
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(kind).ravel()


def _blobs(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([_blob(x)], pa.binary()) for x in arrays]


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(k)[i] for k, name in enumerate(b.schema.names)}


_DEALT = "part int, pack long, words binary, numbers binary, hashes binary, contexts binary, taught binary"


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each pack's words and pairs, dealt out by word: how many contexts a word has, which of the hashes, and the pairs' training counts."""
    for r in _rows(batches):
        own, sizes = _numbers(r["words"], U64), _numbers(r["sizes"], np.int32)
        word, context, pair = _pairs(_numbers(r["tokens"]), _numbers(r["ranks"]), r["end"].as_py(), sizes)
        taught = _small(np.bincount(pair[np.repeat(~_numbers(r["test"], bool), sizes)], minlength=len(word)))
        numbers = _small(np.bincount(word, minlength=len(own)))
        lengths = _numbers(r["lengths"], np.int32)
        edge = np.concatenate([[0], np.cumsum(lengths)])
        inner = np.concatenate([[0], np.cumsum(numbers, dtype=np.int64)])[edge]
        for p in np.flatnonzero(lengths):
            a, b = slice(edge[p], edge[p + 1]), slice(inner[p], inner[p + 1])
            some, at = _distinct(context[b])
            yield pa.record_batch([pa.array([p], pa.int32()), pa.array([r["pack"].as_py()], pa.int64()), *_blobs(own[a], numbers[a], own[some], at, taught[b])], ["part", "pack", "words", "numbers", "hashes", "contexts", "taught"])


_OWN = ["words", "totals", "dish", "context", "count", "places", "lengths"]
_ASKED = ["at", "counts", "live"]
_LEARNED = "part int, pack long, " + ", ".join(f"{x} binary" for x in [*_OWN, *_ASKED]) + ", vocabulary long, tokens long"
#: What stands for the place of a word without training counts.
UNKNOWN = 0xFFFFFFFF


def _learned(parts: int):
    """A row for each partition's dishes, and one for each pack: where its words are among them and how often its pairs occur.

    A pair of one customer has one table for ever. So only live pairs, of two and more, are kept; a word's total less
    what their customers exceed their tables by is its number of tables, as a dish and as a context.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)
        for r in _rows(batches):
            held[r["part"].as_py()].append((r["pack"].as_py(), _numbers(r["words"], U64), _numbers(r["numbers"]), _numbers(r["hashes"], U64)[_numbers(r["contexts"])], _numbers(r["taught"])))
        for part, packs in held.items():
            own, place = np.unique(np.concatenate([x[1] for x in packs]), return_inverse=True)
            word = np.repeat(place, np.concatenate([x[2] for x in packs]))
            context, taught = np.concatenate([x[3] for x in packs]), np.concatenate([x[4] for x in packs])
            order = np.lexsort((context, word))
            new = np.ones(len(order), bool)
            new[1:] = (word[order[1:]] != word[order[:-1]]) | (context[order[1:]] != context[order[:-1]])
            pair = np.empty(len(order), np.int64)
            pair[order] = np.cumsum(new) - 1
            count = np.add.reduceat(taught[order].astype(np.int64), np.flatnonzero(new))
            word, context = word[order][new], context[order][new]
            totals = np.bincount(word, count, len(own)).astype(np.int64)
            known = totals > 0
            number = np.where(known, np.cumsum(known) - 1, UNKNOWN).astype(np.uint32)
            live = count > 1
            nth = np.cumsum(live) - 1
            where, local = np.unique(context[live], return_inverse=True)
            by = _part(where, parts)
            turn = np.lexsort((where, by))
            back = np.empty(len(turn), np.uint32)
            back[turn] = np.arange(len(turn), dtype=np.uint32)
            cols = _blobs(own[known], _small(totals[known]), number[word[live]], back[local], _small(count[live]), where[turn], np.bincount(by, minlength=parts).astype(np.int32))
            yield _row(part, None, dict(zip(_OWN, cols, strict=True)), int(known.sum()), int(totals.sum()))
            a = b = 0
            for pack, mine, _, contexts, _ in packs:
                at, pairs = number[place[a : a + len(mine)]], pair[b : b + len(contexts)]
                a, b = a + len(mine), b + len(contexts)
                yield _row(part, pack, dict(zip(_ASKED, _blobs(at, _small(count[pairs]), _small(nth[pairs][live[pairs]])), strict=True)), 0, 0)

    return run


def _row(part: int, pack: int | None, cols: dict, vocabulary: int, tokens: int) -> pa.RecordBatch:
    blobs = [cols.get(x, pa.nulls(1, pa.binary())) for x in [*_OWN, *_ASKED]]
    return pa.record_batch([pa.array([part], pa.int32()), pa.array([pack], pa.int64()), *blobs, pa.array([vocabulary], pa.int64()), pa.array([tokens], pa.int64())], ["part", "pack", *_OWN, *_ASKED, "vocabulary", "tokens"])


@cache
def _stirling(discount: float, size: int) -> np.ndarray:
    """log S(c, t) for c and t to ``size``: the sum over all seatings of c customers at t tables of the products of (1 - discount) ... (n - 1 - discount)."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(1, size + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, size + 1):
            stay = np.log(np.maximum(c - 1 - discount * t, 0)) + out[c - 1, 1:]
            out[c, 1:] = np.logaddexp(out[c - 1, :-1], np.where(t < c, stay, -np.inf))
    return out


def _many(c: int, pull: float, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Tables of c customers within ten standard deviations, and the logarithms of their weights S(c, t) pull ** t, less a constant.

    S(c, t) is c! / (t! d ** t) times the coefficient of z ** c in (1 - (1 - z) ** d) ** t. Below some c ** d tables, that
    is an alternating sum of the binomial's powers; above, an integral over the circle through the saddle point.
    """
    low, high = -700.0, -1e-12  # pull * r * (1 - r) ** (d - 1) = c; 1 - r may be tiny, so its logarithm is sought
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if pull * -math.expm1(mid) * math.exp(mid * (d - 1)) > c else (low, mid)
    left = math.exp(low)
    mean = pull / d * (1 - left**d)
    reach = 10 * math.sqrt(mean) + 30
    t = np.arange(max(1, math.floor(mean - reach)), min(c, math.ceil(mean + reach)) + 1)
    steps = np.concatenate([[0], np.cumsum(math.log(pull / d) - np.log(t[1:]))])  # log of (pull / d) ** t / t!, less its first
    if t[-1] <= 2.8 * c**d:
        total, binomial = np.zeros(len(t)), np.zeros(len(t))
        for j in range(1, min(int(t[-1]), 300) + 1):
            with np.errstate(divide="ignore"):
                binomial = binomial + np.log(np.maximum(t - j + 1, 0) / j)
            size = np.exp(binomial + math.lgamma(j * d + 1) + math.lgamma(c - j * d) - math.lgamma(c - d))
            total += (-1) ** (j + 1) * math.sin(math.pi * j * d) * size
            if j > 8 and np.all(size < 1e-18 * np.abs(total)):
                break
        return t, steps + np.log(np.maximum(total, 1e-300))
    r = 1 - left
    g, g1, g2 = 1 - left**d, d * left ** (d - 1), d * (1 - d) * left ** (d - 2)
    m = r * g1 / g
    width = 1 / math.sqrt(mean * max(r * r * g2 / g + m - m * m, 1e-12))
    if width > 0.02:  # few enough nodes for the whole circle, evenly
        turn, scale = np.arange(2048) * (2 * math.pi / 2048), 1.0
    else:
        s = np.linspace(-1, 1, 801) * math.asinh(math.pi / width)
        turn, scale = width * np.sinh(s), np.cosh(s)
    ratio = np.log((1 - (1 - r * np.exp(1j * turn)) ** d) / g)
    heads = np.exp(t[0] * ratio - 1j * c * turn) * scale
    step, out = np.exp(ratio), np.empty(len(t))
    for i in range(len(t)):
        out[i] = heads.sum().real
        heads = heads * step
    return t, steps + (t - t[0]) * math.log(g) + np.log(np.maximum(out, 1e-300))


def seat(rng: np.random.Generator, customers: np.ndarray, pull: np.ndarray, discount: float) -> np.ndarray:
    """Tables of each dish when all its customers are taken away and seated again, given all other dishes.

    With t tables a seating weighs pull ** t times the product of (1 - discount) ... (n - 1 - discount) over tables of n;
    the number of tables is drawn from that law itself, whatever the number of customers.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    pull = np.maximum(pull, 1e-300)
    below = 1
    for width in (2, 4, 16, 64, 256, TABLED):
        some = np.flatnonzero((customers > below) & (customers <= width))
        below = width
        if not len(some):
            continue
        t, law = np.arange(1, width + 1), _stirling(discount, max(64, width))
        step = max(1, (1 << 20) // width)
        for i in range(0, len(some), step):
            own = some[i : i + step]
            weight = law[customers[own].astype(np.int64), 1 : width + 1] + t * np.log(pull[own])[:, None]
            weight = np.exp(weight - weight.max(1, keepdims=True)).cumsum(1)
            tables[own] = 1 + (weight < rng.random(len(own))[:, None] * weight[:, -1:]).sum(1)
    for i in np.flatnonzero(customers > TABLED):
        t, weight = _many(int(customers[i]), float(pull[i]), discount)
        weight = np.exp(weight - weight.max()).cumsum()
        tables[i] = t[min(np.searchsorted(weight, rng.random() * weight[-1], "right"), len(t) - 1)]
    return tables


def tilted(rng: np.random.Generator, mass: float, discount: float, size: int) -> np.ndarray:
    """Positive numbers with Laplace transform exp(-mass * ((1 + v) ** discount - 1)): what unseated tables weigh."""
    pieces = max(1, math.ceil(mass))
    out, left = np.zeros(size * pieces), np.arange(size * pieces)
    while len(left):
        u, e = math.pi * rng.random(len(left)), rng.exponential(size=len(left))
        x = np.sin(discount * u) / np.sin(u) ** (1 / discount) * (np.sin((1 - discount) * u) / e) ** ((1 - discount) / discount)
        x *= (mass / pieces) ** (1 / discount)
        took = rng.random(len(left)) < np.exp(-x)
        out[left[took]] = x[took]
        left = left[~took]
    return out.reshape(size, pieces).sum(1)


class Totals:
    """Sums over all restaurants: customers and tables of each context, tables of the parent, words."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, parent_tables: float, vocabulary: int):
        self.customers, self.tables, self.parent_tables, self.vocabulary = customers, tables, parent_tables, vocabulary

    def pull(self) -> np.ndarray:
        return STRENGTH + DISCOUNT * self.tables

    def parent_pull(self) -> float:
        return PARENT_STRENGTH + PARENT_DISCOUNT * self.parent_tables

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's probabilities of dishes with so many customers and tables there."""
        return (customers - PARENT_DISCOUNT * tables + self.parent_pull() / (self.vocabulary + 1)) / (PARENT_STRENGTH + self.tables.sum())


class Parent:
    """The few numbers of the parent's restaurant that all dishes share, drawn on the driver.

    The parent's measure is a generalised gamma process of mass u, normalised. Given u and the gamma variable v of its
    customers, dishes are seated apart from each other: a new table weighs pull. Given the tables, a dish's share is a
    gamma variable for its customers and a tilted stable one for what is unseated, over the sum of all.
    """

    def __init__(self, vocabulary: int, customers: float):
        self.vocabulary, self.customers, self.rng = vocabulary, customers, np.random.default_rng([SEED, 0])
        self.v, self.pull, self.tables, self.mass, self.total = max(customers, 1) / PARENT_STRENGTH, None, None, None, None

    def seated(self, customers: float) -> None:
        """After a sweep of the contexts' restaurants."""
        self.customers, before = customers, 1 + self.v
        self.v = self.rng.gamma(customers) / (self.total / before)
        # u is the mass without its tilt
        self.pull = PARENT_DISCOUNT * self.mass * ((1 + self.v) / before) ** PARENT_DISCOUNT / (self.vocabulary + 1)

    def opened(self, tables: float) -> None:
        """After a sweep of the parent's."""
        self.tables, self.mass = tables, self.rng.gamma(PARENT_STRENGTH / PARENT_DISCOUNT + tables)

    def weighed(self, total: float) -> None:
        """After the shares of all words were drawn; the unknown word's is drawn here."""
        self.total = total + tilted(self.rng, self.mass / (self.vocabulary + 1), PARENT_DISCOUNT, 1)[0]

    def chances(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's probabilities of dishes with so many customers and tables there."""
        rest = (PARENT_STRENGTH + PARENT_DISCOUNT * self.tables) / (self.vocabulary + 1)
        return (customers - PARENT_DISCOUNT * tables + rest) / (PARENT_STRENGTH + self.customers)

    def frozen(self) -> dict:
        """What tasks have to know to repeat this state's draws."""
        return {"vocabulary": self.vocabulary, "pull": self.pull, "mass": self.mass, "total": self.total}


def parent_tables(number: int, part: int, customers: np.ndarray, pull: float | None) -> np.ndarray:
    """The parent's tables of a partition's dishes after a sweep; one each before the first."""
    if pull is None:
        return np.minimum(customers, 1).astype(np.float64)
    return seat(np.random.default_rng([SEED, 1, number, part]), customers, np.full(len(customers), pull), PARENT_DISCOUNT)


def shares(number: int, part: int, customers: np.ndarray, tables: np.ndarray, mass: float, vocabulary: int) -> np.ndarray:
    """What a partition's dishes weigh in the parent's measure, before it is normalised."""
    rng = np.random.default_rng([SEED, 2, number, part])
    return rng.gamma(customers - PARENT_DISCOUNT * tables) + tilted(rng, mass / (vocabulary + 1), PARENT_DISCOUNT, len(customers))


def strengths(number: int, part: int, tables: np.ndarray) -> np.ndarray:
    """What the restaurants of a partition's words weigh a new table by, given their tables: dishes are apart, given these."""
    return np.random.default_rng([SEED, 3, number, part]).gamma(STRENGTH / DISCOUNT + tables)


class Seating:
    """Dishes of one partition and their live pairs; ``word`` is a dish's number where ``totals`` are given."""

    def __init__(self, part: int, word: np.ndarray, context: np.ndarray, count: np.ndarray, totals: np.ndarray | None = None, tables: np.ndarray | None = None):
        self.part, self.context, self.count = part, context.astype(np.int64), count.astype(np.int64)
        self.dishes, self.dish = np.unique(word, return_inverse=True) if totals is None else (np.arange(len(totals)), word)
        self.totals = np.bincount(self.dish, count, len(self.dishes)) if totals is None else totals.astype(np.float64)
        self.tables = np.ones(len(word)) if tables is None else tables.astype(np.float64)
        self.parent_tables = np.ones(len(self.dishes))
        self.shared = None

    @property
    def parent_customers(self) -> np.ndarray:
        return self.totals - np.bincount(self.dish, self.count - self.tables, len(self.dishes))

    def seat(self, number: int, strength: np.ndarray, share: np.ndarray) -> None:
        """Seat the customers of all pairs again, given their restaurants' strengths and their dishes' shares."""
        self.tables = seat(np.random.default_rng([SEED, 4, number, self.part]), self.count, DISCOUNT * strength[self.context] * share[self.dish], DISCOUNT)

    def sweep(self, number: int, totals: Totals) -> None:
        """A whole sweep, where all pairs of all dishes are here."""
        if self.shared is None:
            self.shared = Parent(totals.vocabulary, totals.tables.sum())
            self.shared.opened(totals.parent_tables)
        s = self.shared
        weight = shares(number, self.part, self.parent_customers, self.parent_tables, s.mass, s.vocabulary)
        s.weighed(weight.sum())
        self.seat(number, strengths(number, self.part, totals.tables), weight / s.total)
        s.seated(self.parent_customers.sum())
        self.parent_tables = parent_tables(number, self.part, self.parent_customers, s.pull)
        s.opened(self.parent_tables.sum())

    def sums(self) -> np.ndarray:
        """Customers by context, tables by context, then the parent's tables and the number of dishes."""
        by = lambda x: np.bincount(self.context, x)
        return np.concatenate([by(self.count), by(self.tables), [self.parent_tables.sum(), len(self.dishes)]])


_STATE_NAMES = ["totals", "dish", "context", "count", "places", "lengths", "tables", "sampled", "customers"]
_STATE = "part int, " + ", ".join(f"{x} binary" for x in _STATE_NAMES) + ", open double"


def _state(s: Seating, r: dict, sampled: np.ndarray) -> pa.RecordBatch:
    same = [pa.array([r[x].as_py()], pa.binary()) for x in _STATE_NAMES[:6]]
    return pa.record_batch([pa.array([s.part], pa.int32()), *same, *_blobs(_small(s.tables), _small(sampled), _small(s.parent_customers)), pa.array([float(s.parent_customers.sum())])], ["part", *_STATE_NAMES, "open"])


def _seating(r: dict) -> Seating:
    tables = _numbers(r["tables"]) if "tables" in r else None
    return Seating(r["part"].as_py(), _numbers(r["dish"]), _numbers(r["context"]), _numbers(r["count"]), _numbers(r["totals"]), tables)


def _begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in _rows(batches):
        s = _seating(r)
        yield _state(s, r, np.zeros(len(s.tables)))


def _fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, source, contexts, fewer): for the partitions of the live pairs' contexts, how many tables fewer than customers there are."""
    for r in _rows(batches):
        places = _numbers(r["places"], U64)
        fewer = _small(np.bincount(_numbers(r["context"]), _numbers(r["count"]) - _numbers(r["tables"]).astype(np.float64), len(places)))
        edge = np.concatenate([[0], np.cumsum(_numbers(r["lengths"], np.int32))])
        for q in np.flatnonzero(np.diff(edge)):
            a = slice(edge[q], edge[q + 1])
            yield pa.record_batch([pa.array([q], pa.int32()), pa.array([r["part"].as_py()], pa.int32()), *_blobs(places[a], fewer[a])], ["part", "source", "contexts", "fewer"])


def _restaurants(number: int):
    """(part, source, strengths, open): the strengths of the contexts that each partition asks for, and one row of all contexts' tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked = {}, defaultdict(list)
        for r in _rows(batches):
            if r["source"].is_valid:
                asked[r["part"].as_py()].append((r["source"].as_py(), _numbers(r["contexts"], U64), _numbers(r["fewer"])))
            else:
                own[r["part"].as_py()] = _numbers(r["words"], U64), _numbers(r["totals"])
        for part, (words_, totals) in own.items():
            places = [np.searchsorted(words_, x[1]) for x in asked[part]]
            tables = totals.astype(np.float64)
            for at, (_, _, fewer) in zip(places, asked[part], strict=True):
                tables[at] -= fewer
            strength = strengths(number, part, tables)
            empty = pa.nulls(1, pa.binary())
            yield pa.record_batch([pa.array([part], pa.int32()), pa.nulls(1, pa.int32()), empty, *_blobs(_small(tables))], _RESTAURANTS)
            for at, (source, _, _) in zip(places, asked[part], strict=True):
                yield pa.record_batch([pa.array([source], pa.int32()), pa.array([part], pa.int32()), *_blobs(strength[at]), empty], _RESTAURANTS)

    return run


_RESTAURANTS = ["part", "source", "strengths", "open"]


def _swept(number: int, shared: dict, kept: bool):
    """The partitions' next states; ``kept`` if their tables count for the probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, answers = {}, defaultdict(list)
        for r in _rows(batches):
            if r["source"].is_valid:
                answers[r["part"].as_py()].append((r["source"].as_py(), _numbers(r["strengths"], np.float64)))
            else:
                states[r["part"].as_py()] = r
        for part, r in states.items():
            s = _seating(r)
            strength = np.concatenate([np.zeros(0), *[x for _, x in sorted(answers[part], key=lambda a: a[0])]])
            customers = _numbers(r["customers"]).astype(np.int64)
            weight = shares(number, part, customers, parent_tables(number, part, customers, shared["pull"]), shared["mass"], shared["vocabulary"])
            s.seat(number, strength, weight / shared["total"])
            yield _state(s, r, _numbers(r["sampled"]) + (s.tables if kept else 0))

    return run


def _sum(states: DataFrame, number: int, shared: dict, what: str) -> float:
    """The sum over all dishes of the parent's tables, or of the shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for r in _rows(batches):
            part, customers = r["part"].as_py(), _numbers(r["customers"]).astype(np.int64)
            x = parent_tables(number, part, customers, shared["pull"])
            total += (x if what == "tables" else shares(number, part, customers, x, shared["mass"], shared["vocabulary"])).sum()
        yield pa.record_batch([pa.array([total])], ["x"])

    return states.select("part", "customers").mapInArrow(run, "x double").agg(F.sum("x")).first()[0]


def _answers(history: list[dict]):
    """(pack, part, numbers, live): for a pack's words, totals and, by sweep, tables as contexts, customers and tables at the parent; sums of its live pairs' tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, own, sampled = defaultdict(list), {}, {}
        for r in _rows(batches):
            part = r["part"].as_py()
            if r["pack"].is_valid:
                asked[part].append((r["pack"].as_py(), _numbers(r["at"]), _numbers(r["live"])))
            elif r["sampled"].is_valid:
                sampled[part] = _numbers(r["sampled"])
            else:
                own[part, r["kind"].as_py(), r["number"].as_py()] = _numbers(r["numbers"])
        for part, questions in asked.items():
            columns = [own[part, "totals", 0]]
            for number, shared in enumerate(history):
                if number > BURN_IN:
                    customers = own[part, "customers", number]
                    columns += [own[part, "open", number], customers, _small(parent_tables(number, part, customers.astype(np.int64), shared["pull"]))]
            table = np.stack([np.append(x, np.uint32(0)) for x in columns])
            for pack, at, live in questions:
                numbers = table[:, np.minimum(at, table.shape[1] - 1)]
                yield pa.record_batch([pa.array([pack], pa.int64()), pa.array([part], pa.int32()), *_blobs(numbers, sampled[part][live])], ["pack", "part", "numbers", "live"])

    return run


def _scores(parents: list[Parent], train_tokens: int, vocabulary: int):
    def run(group: pa.Table) -> pa.Table:
        kept = group.filter(pc.is_valid(group["ids"])).to_pylist()[0]
        rows = lambda column: sorted(group.filter(pc.is_valid(group[column])).select(["part", "numbers", "live", "counts"]).to_pylist(), key=lambda r: r["part"])
        n = _numbers(kept["sizes"], np.int32).astype(np.int64)
        word, context, pair = _pairs(_numbers(kept["tokens"]), _numbers(kept["ranks"]), kept["end"], n)
        answers = rows("numbers")
        numbers = np.concatenate([_numbers(r["numbers"]).reshape(1 + 3 * len(parents), -1) for r in answers], axis=1).astype(np.float64)
        count = np.concatenate([_numbers(r["counts"]) for r in rows("counts")]).astype(np.float64)
        tables = np.minimum(count, 1)
        tables[count > 1] = np.concatenate([_numbers(r["live"]) for r in answers]) / len(parents)
        chance = count - DISCOUNT * tables
        for k, parent in enumerate(parents):
            opened, customers, there = numbers[1 + 3 * k : 4 + 3 * k]
            chance += (STRENGTH + DISCOUNT * opened)[context] * parent.chances(customers, there)[word] / len(parents)
        chance = np.log10(chance / (STRENGTH + numbers[0][context]))
        total = numbers[0][word]
        start = np.cumsum(n) - n
        by_text = lambda x: np.add.reduceat(x[pair], start)  # noqa: E731  every text has its end at least
        base = np.log10((total + 1) / (train_tokens + vocabulary + 1))
        cols = [_numbers(kept["ids"], np.int64), _numbers(kept["test"], bool), n, by_text((total > 0).astype(np.int64)), np.full(len(n), train_tokens, np.int64), by_text(base), by_text(chance)]
        return pa.table([pa.array(c) for c in cols], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


#: What stands for a null id in packed ids: the least long, which no id should be.
NO_ID = -(1 << 63)


def score(docs: DataFrame, test_col: str = "held_out", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``.

    The model learns from the whole texts of rows whose ``test_col`` is not true. Tokens are the words between white
    space, A-Z lower-cased, and one end for each text. score is the sum of log10 probabilities of a text's tokens, each
    given the word before; perplexity is 10 ** (-score / n_tokens). base_score is that of add-one smoothed counts.

    Every word is a restaurant: that of the words after it; the first of a text come after an end. All restaurants share
    one parent, over a uniform choice of V + 1 words. Texts are cut into tokens once, in packs of bounded size. Their
    pairs, with training counts, are dealt out by word. A Gibbs sweep seats all customers of a pair again, given all
    others: restaurants' strengths and dishes' shares of the parent are drawn first, given which pairs are independent,
    so partitions work at once and yet sample the model's posterior. Their states are kept from sweep to sweep; between
    sweeps, tables are summed by restaurant. A null text is empty: its end alone. An unknown word has the base's share,
    1 of V + 1. Rows that repeat an id each count; a null id stays null. Without a training row every token has
    probability 1, as V is 0. Other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    n = partitions(spark)
    rows = pick(docs, id_col, test_col, text_col).toDF("id", "test", "text").select(F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("test", F.lit(False)).alias("test"), "text")
    packs = stored(rows.mapInArrow(_packs(n), "pack long, end long, ids binary, test binary, sizes binary, tokens binary, ranks binary, words binary, lengths binary"), "lm-packs")
    learned = stored(packs.mapInArrow(_dealt, _DEALT).repartition(n, "part").mapInArrow(_learned(n), _LEARNED), "lm-pairs")
    vocabulary, train_tokens = (int(x or 0) for x in learned.agg(F.sum("vocabulary"), F.sum("tokens")).first())

    own = learned.where("pack IS NULL")
    state = stored(own.select("part", *_OWN[1:]).mapInArrow(_begun, _STATE), "lm-state")
    parent = Parent(vocabulary, state.agg(F.sum("open")).first()[0] or 0.0)
    parent.opened(vocabulary)
    kind = lambda df, name, number, column: df.select("part", F.lit(name).alias("kind"), F.lit(number).alias("number"), F.col(column).alias("numbers"))
    parents, history, kept = [], [], []
    for number in range(SWEEPS + 1):
        if number:
            parent.seated(state.agg(F.sum("open")).first()[0] or 0.0)
            parent.opened(_sum(state, number, parent.frozen(), "tables") or 0.0)
        if number < SWEEPS:
            parent.weighed(_sum(state, number, parent.frozen(), "shares") or 0.0)
        history.append(parent.frozen())
        fewer = state.select("part", "context", "count", "places", "lengths", "tables").mapInArrow(_fewer, "part int, source int, contexts binary, fewer binary")
        asks = own.select("part", "words", "totals").unionByName(fewer, allowMissingColumns=True).repartition(n, "part")
        opened = stored(asks.mapInArrow(_restaurants(number), "part int, source int, strengths binary, open binary"), "lm-restaurants")
        if number > BURN_IN:
            parents.append(copy.copy(parent))
            kept.append(stored(kind(opened.where("source IS NULL"), "open", number, "open").union(kind(state, "customers", number, "customers")), "lm-kept"))
        if number < SWEEPS:
            before, answers = state, opened.where("source IS NOT NULL").drop("open")
            state = stored(before.drop("open").unionByName(answers, allowMissingColumns=True).repartition(n, "part").mapInArrow(_swept(number, history[number], number >= BURN_IN), _STATE), "lm-state")
            forget(spark, before)
        forget(spark, opened)

    asked = learned.where("pack IS NOT NULL")
    known = kind(own, "totals", 0, "totals")
    for df in kept:
        known = known.union(df)
    known = known.unionByName(state.select("part", "sampled"), allowMissingColumns=True).unionByName(asked.select("part", "pack", "at", "live"), allowMissingColumns=True)
    answers = known.repartition(n, "part").mapInArrow(_answers(history), "pack long, part int, numbers binary, live binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = packs.drop("words", "lengths").unionByName(answers, allowMissingColumns=True).unionByName(asked.select("pack", "part", "counts"), allowMissingColumns=True)
    out = out.groupBy("pack").applyInArrow(_scores(parents, train_tokens, vocabulary), schema)
    out = stored(out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))), "lm-scores")
    forget(spark, packs, learned, state, *kept)
    return out
