"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm._store import arrow_rows, pick, slices, text_bytes

#: Subwords are runs of so many bytes of lower-cased letters, spaces between words included.
SIZES = (2, 3, 4)
BUCKETS = 1 << 15
DIM = 16
#: Labelled rows of each language from which a model is fitted, at most.
FIT_ROWS = 800
#: Parts into which a language's rows are dealt before its first rows are taken of what each part keeps.
PARTS = 32
#: Different labels, at most: a model holds weights for each.
MOST_LANGS = 1_024
EPOCHS = 8
#: Step size at first; it falls to 0 over the epochs.
RATE = 4.0
#: Rejection keeps at least this share of the rightly labelled calibration rows.
KEEP = 0.999

_FORM = np.full(256, 0x20, np.uint8)
_FORM[0x61:0x7B] = np.arange(0x61, 0x7B)
_FORM[0x41:0x5B] = np.arange(0x61, 0x7B)
_FORM[0x80:] = np.arange(0x80, 0x100)


def subwords(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: every position's bucket, or BUCKETS where no subword of letters starts; and the texts' offsets."""
    raw, offsets = text_bytes(texts)
    form = _FORM[raw].astype(np.uint32)
    end = np.repeat(offsets[1:], np.diff(offsets))
    for n in SIZES:
        if len(form) < n:
            yield np.full(len(form), BUCKETS, np.int64), offsets
            continue
        code = np.full(len(form) - n + 1, n, np.uint32)
        for i in range(n):
            code = code * np.uint32(0x01000193) + form[i : i + len(code)]
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        bucket = np.full(len(form), BUCKETS, np.int64)
        bucket[: len(code)] = code >> np.uint32(17)
        none = np.arange(len(form)) + n > end
        none[:-1] |= (form[:-1] == 0x20) & (form[1:] == 0x20)
        bucket[none] = BUCKETS
        yield bucket, offsets


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


@dataclass
class Model:
    """Languages in order, each bucket's share of the logits, biases, temperature and the least score that is accepted."""

    langs: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """A row of calibrated probabilities for each text; uniform where it has no subword."""
        k = len(self.langs)
        total, count = np.zeros((len(texts), k)), np.zeros(len(texts))
        for bucket, offsets in subwords(texts):
            full = np.flatnonzero(np.diff(offsets))
            if len(full):
                total[full] += np.add.reduceat(self.logits[bucket], offsets[full], dtype=np.float64)
                count[full] += np.add.reduceat((bucket < BUCKETS).astype(np.float64), offsets[full])
        z = (total / np.maximum(count, 1)[:, None] + np.where(count[:, None] > 0, self.bias, 0)) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True)) if k else z
        return p / p.sum(1, keepdims=True) if k else p


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, order, buckets, shares) of each row (lang, text, order): its subwords' average as a sparse vector."""
    for b in batches:
        out = []
        for row, stop in slices(b, 1):
            parts = [list(x) for x in zip(*([bucket[i:j] for i, j in zip(o[:-1], o[1:], strict=True)] for bucket, o in subwords(b.column(1)[row:stop])), strict=True)]
            for p in parts:
                n = np.bincount(np.concatenate(p), minlength=BUCKETS + 1)[:BUCKETS]
                at = np.flatnonzero(n)
                out.append((at.astype("<u2").tobytes(), (n[at] / max(1, n.sum())).astype("<f4").tobytes()))
        yield pa.record_batch([b.column(0), b.column(2), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["lang", "turn", "buckets", "shares"])


def _descend(bags: list, y: np.ndarray, k: int, seed: int, first_rate: float = RATE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, output weights and biases after stochastic gradient descent, a row at a time, with a falling rate."""
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    weight, bias = np.zeros((DIM, k)), np.zeros(k)
    share = np.bincount(y, minlength=k)
    even = len(y) / (max(1, (share > 0).sum()) * np.maximum(share, 1))  # rare languages weigh as much as common ones
    steps, step = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rate = first_rate * (1 - step / steps)
            step += 1
            at, x = bags[i]
            x = x.astype(float)
            hidden = x @ embed[at]
            z = hidden @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= min(even[y[i]], 10.0)
            back = weight @ p
            weight -= rate * np.outer(hidden, p)
            bias -= 0.05 * rate * p
            # a row's shares are small numbers: its buckets move as far as if each had its due of the step
            embed[at] -= (rate * 8) * x[:, None] * back
    return embed, weight, bias


def _leading(rows: DataFrame, k: int, *order: str) -> DataFrame:
    """The first ``k`` rows of each lang by ``order``, with their number ``turn``.

    Parts of a language give their first ``k`` each, so that no task gets more than PARTS times ``k`` rows of it at last.
    """
    part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.hash(*order), F.lit(PARTS))).orderBy(*order))
    some = rows.withColumn("turn", part).where(F.col("turn") <= k).drop("turn")
    return some.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("turn") <= k)


def taught(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(lang, text, turn): at most ``fit_rows`` labelled rows of each language, numbered by ``turn``.

    Ids are chosen by their hashes, which looks at ids and labels alone; of the rows of chosen ids the first are taken,
    so that an id with many rows does not add to them. Rows with a null id, label or text do not teach.
    """
    docs = pick(docs, "doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null")
    ids = docs.select("lang", "doc_id").distinct().withColumn("mark", F.xxhash64("doc_id"))
    chosen = _leading(ids, fit_rows, "mark", "doc_id").select("lang", "doc_id", F.col("turn").alias("place"))
    rows = docs.join(F.broadcast(chosen), ["lang", "doc_id"]).withColumn("same", F.xxhash64("text"))  # fit_rows ids of each of some languages
    first = _leading(rows, fit_rows, "place", "same")
    return first.select("lang", "text", "turn")


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 7) -> Model:
    """A model from the labelled rows (doc_id, text, lang): at most ``fit_rows`` of each language, as ``taught`` chooses them.

    Every fifth chosen row calibrates the temperature and the least accepted score. No rows: a model without languages,
    which calls everything ``und``. More than MOST_LANGS labels raise an error.
    """
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts := list(batches):
            m = _taught(pa.Table.from_batches(parts), seed)
            yield pa.record_batch([pa.array([m.langs], pa.list_(pa.string())), pa.array([m.logits.tobytes()], pa.binary()), pa.array([m.bias.tolist()], pa.list_(pa.float64())), pa.array([m.temperature]), pa.array([m.least])], ["langs", "logits", "bias", "temperature", "least"])

    bags = taught(docs, fit_rows).mapInArrow(_bags, "lang string, turn int, buckets binary, shares binary")
    # one task fits, on fit_rows of each of at most MOST_LANGS languages; only the model comes to the driver
    made = bags.repartition(1).mapInArrow(run, "langs array<string>, logits binary, bias array<double>, temperature double, least double").collect()
    if not made:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0), 1.0, 0.0)
    m = made[0]
    return Model(m["langs"], np.frombuffer(m["logits"], np.float32).reshape(BUCKETS + 1, -1), np.array(m["bias"]), m["temperature"], m["least"])


def _taught(found: pa.Table, seed: int) -> Model:
    """The model of some bags (lang, turn, buckets, shares), at least one."""
    order = sorted(range(found.num_rows), key=lambda i: (found["lang"][i].as_py(), found["turn"][i].as_py()))
    found = found.take(pa.array(order, pa.int64())).combine_chunks()
    # views of the table's bytes: numbers widen where they are used
    bags = [(np.frombuffer(a.as_buffer(), "<u2"), np.frombuffer(b.as_buffer(), "<f4")) for a, b in zip(found["buckets"], found["shares"], strict=True)]
    names = found["lang"].to_pylist()
    langs = sorted(set(names))
    if len(langs) > MOST_LANGS:
        raise ValueError(f"{len(langs)} languages: at most {MOST_LANGS} can be told apart")
    y = np.array([langs.index(x) for x in names], np.int64)
    held = np.array([t % 5 == 0 for t in found["turn"].to_pylist()], bool)
    train = np.flatnonzero(~held)
    rate = RATE
    while True:
        with np.errstate(over="ignore", invalid="ignore"):
            embed, weight, bias = _descend([bags[i] for i in train], y[train], len(langs), seed, rate)
        if max(np.abs(embed).max(), np.abs(weight).max(initial=0), np.abs(bias).max(initial=0)) < 1e6 or rate < 1e-3:
            break
        rate /= 4  # labels that texts do not tell apart can drive the descent off
    logits = np.vstack([embed @ weight, np.zeros(len(langs))]).astype(np.float32)
    z = np.array([x.astype(float) @ logits[at] + bias for (at, x), h in zip(bags, held, strict=True) if h]).reshape(-1, len(langs))
    temperature, least = _calibrate(z, y[held]) if len(z) else (1.0, 0.0)
    return Model(langs, logits, bias, temperature, least)


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The temperature with the least log loss, and the score below which rows are rejected."""

    def probabilities(t: float) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    grid = np.geomspace(0.05, 20, 121)
    t = float(min(grid, key=lambda t: -np.log(np.maximum(probabilities(t)[np.arange(len(y)), y], 1e-12)).mean()))
    p = probabilities(t)
    right = np.sort(p.max(1)[p.argmax(1) == y])
    least = float(right[int(len(right) * (1 - KEEP))]) * 0.9 if len(right) else 0.0
    return t, min(least, 0.5)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each row of ``docs`` from its whole text.

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text where the model has no
    language. Other rows get the language of the greatest calibrated probability (ties: the first by name), that
    probability, and whether it is below the model's least score. Rows stay as they are, repeated or with null ids;
    other columns are ignored; an empty table gives an empty one. One narrow stage, no shuffle.
    """
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = [], []
            for row, stop in slices(b, 1):
                texts = b.column(1)[row:stop]
                p = model.scores(texts)
                raw, offsets = text_bytes(texts)
                ascii_letter = np.concatenate([[0], np.cumsum((_FORM[raw] != 0x20) & (raw < 0x80))])
                plain = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
                for i in range(stop - row):
                    if model.langs and (plain[i] or has_letter(texts[i].as_py())):
                        best = int(p[i].argmax())
                        langs.append(model.langs[best])
                        scores.append(float(p[i, best]))
                    else:
                        langs.append("und")
                        scores.append(0.0)
            no = [x == "und" or s < model.least for x, s in zip(langs, scores, strict=True)]
            yield pa.record_batch([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(no, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id", parts: int = 3, part: int = 1):
    """Whether a row's id, as text, falls into the fold that teaches nothing; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))
