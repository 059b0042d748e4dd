"""Source divergences, ranked search and license scans against plain Python, on rows with nulls, copies, ties and clashing columns."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import divergence, licenses, ranked_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
KIND = "doc_id long, text string, lang string, source string, value long, part string, word string, n_words long, score double, item long"


def lowered(text: str | None) -> str:
    return (text or "").translate(LOWER)


def rows() -> list[tuple]:
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "abcdé" for b in "xyzßÄ"] + ["ΑΣ", "İx", "x1y", "２３", "der", "the", "THE"]
    texts = [" ".join(rng.choice(words[: 5 + i % 27]) for _ in range(rng.randrange(1, 60))) for i in range(150)]
    texts += texts[:20] * 2 + [None, "", "  ", "1 2 3", "?!", "long " * 30_000, "x" * 5_000, "uno due tre", "the the the"]
    out = [(i, t, ["en", "de", None, "en"][i % 4], [f"s{i % 3}", "s0", None][i % 3], 1, "x", "y", 2, 0.5, 7) for i, t in enumerate(texts)]
    out += [(None, "the der", "xx", "alone", 1, "", "", 0, 0.0, 0), (None, "", "yy", "one", 1, "", "", 0, 0.0, 0), (5, "der der the", "yy", "two", 1, "", "", 0, 0.0, 0), (5, "der der the", "yy", "two", 1, "", "", 0, 0.0, 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), KIND).repartition(3)


def brute_divergences(table: list[tuple], least: int, top: int) -> set[tuple]:
    df, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for r in table:
        lang, source, found = r[2] or "", r[3] or "", LETTERS.findall(lowered(r[1]))
        groups[lang].add(source)
        df[lang].update(set(found))
        count[lang, source].update(found)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        chances = {}
        every = Counter({t: sum(count[lang, s][t] for s in sources) for t in kept})
        for s, c in [*((s, count[lang, s]) for s in sources), (None, every)]:
            n = sum(c[t] for t in kept)
            chances[s] = {t: 1 + 1_000_000_000 * (c[t] + 1) // (n + len(kept)) for t in kept}
        far = lambda p, q: (p - q) ** 2 // q
        for a in sources:
            pairs = [(sum(far(chances[a][t], chances[b][t]) for t in kept), b) for b in sources if b != a]
            found = [(far(chances[a][t], chances[None][t]), t) for t in kept if count[lang, a][t] and chances[a][t] > chances[None][t]]
            for part, values in (("pair", pairs), ("term", found)):
                values = sorted(values, key=lambda v: (-v[0], v[1].encode()))
                out |= {(lang, a, part, item, value, k + 1) for k, (value, item) in enumerate(values) if part == "pair" or k < top}
    return out


@pytest.mark.parametrize("cells", [1_000_000, 40])
def test_divergences_against_plain_python(docs, monkeypatch, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)
    for top in (200, 4):
        got = [tuple(r) for r in divergence.divergences(docs, top=top).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute_divergences(rows(), 3, top)


def test_divergences_without_rows_or_terms(docs):
    assert divergence.divergences(docs.limit(0)).count() == 0
    got = divergence.divergences(docs.where("lang is null or lang = 'yy'").withColumn("text", docs.text.substr(1, 0)))
    assert {(r["lang"], r["source"], r["item"], r["value"]) for r in got.collect()} >= {("yy", "one", "two", 0), ("yy", "two", "one", 0)}


def test_chances_are_exact_beyond_doubles():
    for count, total in [(0, 1), (0, 7), (10**15, 10**15 + 3), (8 * 10**15, 8 * 10**15 + 10**9), (123_456_789_012_345, 987_654_321_098_765), (0, 8 * 10**15)]:
        assert divergence.chance(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 1) // total


def brute_search(table: list[tuple], items: list[tuple], top: int) -> dict:
    bags = [(r[0], Counter(ALNUM.findall(lowered(r[1])))) for r in table]
    bags = [(i, c) for i, c in bags if c]
    n, length = len(bags), sum(c.total() for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    terms = defaultdict(set)
    for item, text in items:
        terms[item] |= set(ALNUM.findall(lowered(text)))
    out = {}
    for item, own in terms.items():
        scored = []
        for i, c in bags:
            m = 50 + 50 * c.total() * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            scored += [(-s, i is None, i)] if s > 0 else []
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out |= {(item, k + 1): (i, -s) for k, (s, _, i) in enumerate(scored[:top])}
    return out


ITEMS = [(1, "ax ay AZ bx der"), (2, "ax ay az bx THE"), (3, None), (4, ""), (5, "nothing here"), (6, "ax ay 1 2 3"), (6, "der der"), (None, "the x1y ２３"), (7, "ax"), (8, "bx ax dß " + "the " * 500)]


@pytest.mark.parametrize(("top", "item_bytes"), [(50, 1 << 22), (3, 10)])
def test_ranked_search_against_plain_python(spark, docs, top, item_bytes):
    items = spark.createDataFrame([(*r, 1.0, 2) for r in ITEMS], "item_id long, text string, score double, rank int")
    got = ranked_search.ranked_search(docs, items, top=top, item_bytes=item_bytes).collect()
    assert {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in got} == brute_search(rows(), ITEMS, top)
    assert len(got) == len({(r["item_id"], r["rank"]) for r in got})
    assert ranked_search.ranked_search(docs.limit(0), items).count() == ranked_search.ranked_search(docs, items.limit(0)).count() == 0


def test_ranked_search_with_names_as_ids(spark, docs):
    items = spark.createDataFrame([("a", "ax the"), ("b", "ay the")], "item_id string, text string")
    named = docs.withColumn("doc_id", docs.doc_id.cast("string"))
    got = ranked_search.ranked_search(named, items, top=5).collect()
    assert {r["item_id"] for r in got} == {"a", "b"} and len(got) == 10


def test_shared_sums_are_those_of_the_lists():
    rng = random.Random(5)
    lists = [sorted(rng.sample(range(40), rng.randrange(1, 25))) for _ in range(30)] + [[3], [3], list(range(40))]
    graph = ranked_search.shared(lists, 40)
    leaves = np.array([[rng.randrange(1000) for _ in range(9)] for _ in range(40)])
    assert (graph.evaluate(leaves) == np.array([leaves[x].sum(0) for x in lists])).all()
    assert len(graph.left) + len(graph.members) < sum(len(x) for x in lists)
    alone = ranked_search.shared([[0], [1, 2]], 3)
    assert alone.evaluate(np.eye(3, dtype=np.int64)).tolist() == [[1, 0, 0], [0, 1, 1]]


def brute_licenses(text: str | None, templates, threshold: float) -> tuple:
    w = ALNUM.findall(lowered(text))
    places = [(i, label) for i in range(len(w)) for label, p in licenses.PHRASES if w[i : i + len(p.split())] == p.split()]
    half = licenses.BLOCK // 2
    blocks = [set(w[i : i + licenses.BLOCK]) for i in range(0, max(len(w), 1), half)]
    found = []
    for b in blocks:
        for label, p in templates:
            s = set(p.split())
            if len(b & s) >= max(1, math.ceil(round(threshold * len(s), 9))):
                found.append((label, len(b & s) / len(s)))
    base = sorted({x for _, x in places})
    score = 1.0 if places else max((s for _, s in found), default=0.0)
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(base), ",".join(sorted({*base, *(x for x, _ in found)})), score


def license_rows() -> list[tuple]:
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(["the", "of", "work", "and", "under", "is", "a", "ein", "çà", "terms"]) for _ in range(n))
    notices = [p for _, p in licenses.TEMPLATES] + ["Under the MIT License.", "CC BY-NC cc by nc", "Apache\nLicense,  Version 2", "cc by nc " * 9, "Released under the mit\n\n* License", "under the mit license under the mit license"]
    texts = [None, "", "!", "cc", "cc by", "mit license under the", "K mit under the license", *notices]
    for n in (1, 20, 31, 32, 33, 63, 64, 65, 200):
        texts += [f"{prose(n)} {x.upper() if n % 2 else x} {prose(n)}" for x in notices]
    for _ in range(60):  # templates with some words lost, and out of order
        w = rng.choice(notices).split()
        rng.shuffle(w)
        texts.append(f"{prose(rng.randrange(90))} {' '.join(w[: rng.randrange(len(w)) + 1])} {prose(rng.randrange(90))}")
    texts += [prose(20_000) + " all rights reserved", *texts[:30]]
    return [(i if i % 17 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("threshold", [licenses.THRESHOLD, 0.6])
def test_license_scan_against_plain_python(spark, threshold):
    table = license_rows()
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in table], "doc_id long, text string, w string, n_words int, labels string").repartition(3)
    got = licenses.scan(frame, threshold=threshold).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    want = [(i, *brute_licenses(t, licenses.TEMPLATES, threshold)) for i, t in table]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert licenses.scan(frame.limit(0)).count() == 0


def test_no_template_lies_in_another_label():
    sets = [(label, set(p.split())) for label, p in licenses.TEMPLATES]
    assert not [(a, b) for a, x in sets for b, y in sets if a != b and x <= y]


def test_license_scan_stays_in_spark(docs):
    plan = licenses.digest(docs.select("doc_id", "text"), licenses.PHRASES, ["mit"], 1)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_term_arrays():
    from panelwright.llm import _words

    found, first = _words.terms(pa.array(["Ab1c é", None, "", "x"], pa.string()), _words.LETTERS)
    assert found.to_pylist() == ["ab", "c", "é", "x"] and first.tolist() == [0, 3, 3, 3, 4]
    assert len(set(_words.hashes(found).tolist())) == 4 and (_words.hashes(found.slice(1)) == _words.hashes(found)[1:]).all()
