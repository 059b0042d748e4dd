"""Every stage of the pipeline on its own input, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline as pipeline  # noqa: E402
from tests.llm.test_operators import LOWER, brute_components, text  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows() -> list[tuple]:
    rng = random.Random(12)
    texts = [text(rng, rng.randrange(20, 80)) for _ in range(40)]
    for t in texts[:12]:
        w = t.split()
        w[rng.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    texts += texts[:3] + ["", None, texts[5] + " " + passage(0), passage(1).upper()]
    out = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[7], (None, texts[2], "en", "s1", 5), (None, None, None, None, None)]


def passage(k: int) -> str:
    return " ".join(f"b{k}x{i}" for i in range(14))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, passage(0)), (2, passage(1)), (3, None), (4, "")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def kept(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_near_copies(spark, docs, sf_dir):
    component = brute_components([r[:2] for r in rows()])
    want = {r for r in rows() if r[0] is not None and component[r[0]] == r[0]}
    got = kept(pipeline.drop_near_copies(spark, docs, sf_dir))
    assert {r for r in got if r[0] is not None} == want
    assert len(got) == len(want) + 2  # an id that repeats stays once; rows without an id stay


def test_benchmark_passages(spark, docs, sf_dir):
    windows = {tuple(w[i : i + 10]) for k in (0, 1) for w in [passage(k).split()] for i in range(5)}

    def clean(t: str | None) -> bool:
        w = WORD.findall((t or "").translate(LOWER))
        return not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))

    want = sorted((r for r in rows() if clean(r[1])), key=repr)
    assert kept(pipeline.drop_benchmark_passages(spark, docs, sf_dir)) == want
    assert len(want) == len(rows()) - 2


def test_language_and_mixture_keep_rows_whole(spark, docs, sf_dir):
    for stage in (pipeline.identify_language, pipeline.mix_sources):
        once, again = kept(stage(spark, docs, sf_dir)), kept(stage(spark, docs, sf_dir))
        assert once == again and set(once) <= set(rows())
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_language_stage_against_plain_python(spark, docs, sf_dir):
    """What stays is what the fitted model does not reject, row by row; an id goes with any of its rows."""
    model = pipeline.language_id.fit(docs)

    def rejected(t: str | None) -> bool:
        return not any(c.isalpha() for c in t or "") or model.scores(pa.array([t], pa.string()))[0].max() < model.least

    gone = {r[0] for r in rows() if r[0] is not None and rejected(r[1])}
    assert kept(pipeline.identify_language(spark, docs, sf_dir)) == sorted((r for r in rows() if r[0] is None or r[0] not in gone), key=repr)
    assert gone


def test_mixture_stage_against_plain_python(spark, docs, sf_dir):
    """Raking, the factor and each row's draw, step by step over the cells."""
    table = rows()
    topic = lambda t: "legal" if "icense" in t or "opyright" in t else "web" if "http" in t or "@" in t else "numbers" if re.search("[0-9]", t) else "prose"
    cell_of = [(r[3], r[2], topic(r[1] or "")) for r in table]
    count = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in table]
    tokens = {c: sum(n for x, n in zip(cell_of, count, strict=True) if x == c) for c in set(cell_of)}
    total = sum(tokens.values())
    share = {c: n / total for c, n in tokens.items()}
    target = []
    for m in range(3):
        own = {c[m]: sum(n for x, n in tokens.items() if x[m] == c[m]) ** 0.5 for c in tokens}
        target.append({v: x / sum(own.values()) for v, x in own.items()})
    for _ in range(12):
        for m in range(3):
            own = {v: sum(s for x, s in share.items() if x[m] == v) for v in target[m]}
            share = {c: s * target[m][c[m]] / own[c[m]] if own[c[m]] > 0 else 0.0 for c, s in share.items()}
    weight = {c: share[c] * total / n if n else 1.0 for c, n in tokens.items()}
    order = sorted(tokens, key=lambda c: -weight[c])
    factor = None
    for k, c in enumerate(order):
        left = sum(share[x] for x in order[k:])
        f = (pipeline.MIX_BUDGET * total - sum(tokens[x] for x in order[:k])) / (left * total) if left > 0 else None
        if f is not None and f * weight[c] <= 1:
            factor = f
            break
    p = {c: 1.0 if not n else (1.0 if share[c] > 0 else 0.0) if factor is None else min(weight[c] * max(factor, 0), 1.0) for c, n in tokens.items()}
    draw = lambda i: int(hashlib.md5(f"{'' if i is None else i}:17".encode()).hexdigest()[:12], 16) / 2**48
    gone = {r[0] for r, c in zip(table, cell_of, strict=True) if r[0] is not None and not draw(r[0]) < p[c]}
    assert kept(pipeline.mix_sources(spark, docs, sf_dir)) == sorted((r for r in table if r[0] is None or r[0] not in gone), key=repr)
    assert gone and len(gone) < len(table)


def test_labels_that_texts_do_not_tell_apart(spark, docs):
    """The fit stays finite, and scores are probabilities."""
    found = pipeline.language_id.predict(docs, pipeline.language_id.fit(docs)).collect()
    assert len(found) == len(rows()) and all(0 <= r["score"] <= 1 for r in found)


def test_token_ids(spark, docs, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_crc32"]) for r in pipeline.write_token_ids(spark, docs, sf_dir).collect())
    ids = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for d, t, *_ in rows()]
    assert got == sorted((d if d is not None else -1, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids)
