"""Operators against brute force on small tables with nulls, empty and long texts, ties, copies and clashing columns."""

from __future__ import annotations

import ast
import collections
import gzip
import math
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest

from panelwright.llm import ann, decontaminate, language_id, language_model, mixing, ngram_join, substring_dedup, token_counts, token_store, warc

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HARD = ["ΑΣ ΟΔΟΣ İstanbul ﬁ", "don't I'LL <|endoftext|> x<|ENDOFTEXT|>y <|startoftext|><|startoftext|>", "", "   ", "a\u0085b\x1cc", "日本語 テスト １２３ ①", "J̌ J̌x é ẞ ǅ", "😀😀 a😀b 12345 1a2", "x" * 5000, "ª º µ ² ½", "'S 'RE it''s ''ll", "Å Ω K Σ"]


def text(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def corpus() -> list[tuple]:
    rng = random.Random(3)
    base = [text(rng, rng.randrange(1, 120)) for _ in range(60)]
    near = []
    for t in base[:25]:
        w = t.split()
        for _ in range(3):
            x = list(w)
            for _ in range(rng.randrange(1, 4)):
                x[rng.randrange(len(x))] = f"v{rng.randrange(999)}"
            near.append(" ".join(x))
    texts = base + near + base[:10] + ["", None, "a", "a b c", "A B C", "long " * 30_000, *HARD]
    return [(i, t, ["en", "de", None][i % 3], f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def shingles(t: str | None, k: int = 5) -> frozenset:
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def test_ngram_join(docs, empty):
    sets = {r[0]: shingles(r[1]) for r in corpus()}
    parent = {k: k for k in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    clash = docs.withColumns({"n_shingles": docs.doc_id, "component_id": docs.text, "set_key": docs.doc_id})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(clash).collect()}
    assert got == {k: (len(s), find(k)) for k, s in sets.items()}
    assert ngram_join.ngram_join(empty).count() == 0


def brute_components(rows: list[tuple]) -> dict[int, int]:
    """Smallest id that links reach, from all pairs of rows (id, text); rows of one id are one node."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    for n, (i, x) in enumerate(sets):
        for j, y in sets[:n]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in parent}


def test_ngram_join_with_repeated_and_null_ids(spark):
    rng = random.Random(8)
    rows = []
    for k in range(40):
        for half in range(2):
            t = text(rng, 60)
            near = t.split()
            near[rng.randrange(60)] = "edit"
            rows += [(k, t), (100 + 2 * k + half, " ".join(near))]
    rows += [(None, rows[0][1]), (None, None), (None, "a b")]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    want = brute_components(rows)
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert all(r["component_id"] is None and r["n_copies"] == 1 for r in got if r["doc_id"] is None)
    assert sorted(r["n_shingles"] for r in got if r["doc_id"] is None) == [0, 1, 56]


def test_ngram_join_of_ids_with_several_texts(spark):
    """Rows of one id are one node, also where a smaller id represents one of its texts, and where one has no word."""
    rng = random.Random(12)
    rows = []
    for k in range(30):
        x, y = text(rng, 60), text(rng, 60)
        near = y.split()
        near[20] = "edit"
        rows += [(20 * k + 3, x), (20 * k + 5, x), (20 * k + 5, y), (20 * k + 9, " ".join(near)), (20 * k + 5, ""), (20 * k + 1, "?"), (20 * k + 1, None), (20 * k + 2, ""), (20 * k + 2, "a b")]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute_components(rows)
    assert len(got) == len(rows) and {(r["doc_id"], r["component_id"]) for r in got} == set(want.items())


def test_ngram_join_of_a_family(spark):
    """Variants of one text that share a passage with all others, some of which link only through each other."""
    rng = random.Random(9)
    base, hot = text(rng, 100, 10_000).split(), text(rng, 12, 10_000)
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(200 + k, text(rng, rng.randrange(5, 30), 10_000) + " " + hot) for k in range(150)]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows)


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 16))
    x[50:60] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 400, 20))
    right = total = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(400), d))[:10]
        right, total = right + len({i for i, _ in found} & set(want.tolist())), total + 10
        assert all(s == pytest.approx(d[i], rel=1e-12) for i, s in found)
    assert right >= 0.9 * total
    assert ann.nearest(df.limit(0), df).count() == 0
    assert ann.nearest(df.where("vec_id < 4"), df.where("vec_id = 0")).count() == 3


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_token_counts(docs, empty, library):
    want = {r[0]: len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in corpus()}
    got = token_counts.token_counts(docs, PATH).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert token_counts.token_counts(empty, PATH).count() == 0


def test_token_files(docs, empty, library):
    at = 0
    got = {r["doc_id"]: r for r in token_store.token_store(docs, PATH).collect()}
    for r in corpus():
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        x = got[r[0]]
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_store.token_store(empty, PATH).count() == 0


def test_token_files_stand_alone(spark, tmp_path, library):
    """Null and repeated ids, clashing columns, files left by a lost attempt, and reading by a process that has the folder alone."""
    rows = [(None, "a b", 1), (None, None, 2), (7, "c d", 3), (7, "c d", 4), (7, "e", 5), (3, "x " * 3000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long").repartition(3)
    folder = f"file://{tmp_path}/ids"
    token_store.write_tokens(docs, PATH, folder, 1)
    (tmp_path / "ids" / "000000-000099.ids").write_bytes(b"left over")
    code = "import sys; from pyspark.sql import SparkSession as S; from panelwright.llm import token_store as t; s = S.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(); print('GOT', [tuple(r)[:4] for r in t.read_tokens(s, sys.argv[1]).orderBy('start').collect()])"
    said = subprocess.run([sys.executable, "-c", code, folder], capture_output=True, text=True, check=True).stdout
    got = ast.literal_eval(said.partition("GOT ")[2])
    assert [r[0] for r in got] == [None, None, 3, 7, 7, 7]
    want = collections.Counter()
    for d, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r[0], *r[2:]) for r in got) == want
    assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]
    with pytest.raises(ValueError, match="table"):
        token_store.decode_table((tmp_path / "ids" / "table").read_bytes()[:-1] + b"\xff")


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 300_000), 999).astype(np.uint32)
    freq = token_store.frequencies(np.bincount(ids, minlength=1000))
    assert freq.sum() == 1 << token_store.SCALE_BITS and freq.min() > 0
    table = token_store.Table(freq)
    for n in (0, 1, 2047, 2048, 2049, 300_000):
        assert (token_store.decode_block(table, token_store.encode_block(table, ids[:n]), n) == ids[:n]).all()
    content = token_store.encode_file(table, np.array([5, 9]), np.array([100, 299_900]), ids)
    assert [(d, x.tolist()) for d, x in token_store.decode_file(table, content)[1]] == [(5, ids[:100].tolist()), (9, ids[100:].tolist())]
    with pytest.raises(ValueError, match="damaged"):
        token_store.decode_file(table, content[:-9] + bytes([content[-9] ^ 1]) + content[-8:])


def test_decontamination(spark, docs):
    rng = random.Random(9)
    rows = corpus()
    items = [(1, " ".join(rows[2][1].split()[:14])), (2, "a b c"), (3, None), (4, "!!"), (5, text(rng, 30)), (10, rows[3][1]), (11, "A, B; C")]
    alnum = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    found = {}
    for r in rows:
        w = alnum.findall((r[1] or "").translate(LOWER))
        hit, who = set(), set()
        for item, t in items:
            p = alnum.findall((t or "").translate(LOWER))
            n = min(10, len(p))
            windows = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    who.add(str(item))
        found[r[0]] = (len(w), len(hit), sorted(who))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 25, 50):  # one table of patterns, or several passes
        got = decontaminate.decontaminate(docs, bench, pattern_bytes=size).collect()
        assert {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in got} == found
    assert not any(r["contaminated"] for r in decontaminate.report(decontaminate.decontaminate(docs, bench.limit(0))).collect())


def test_language_id_is_taught_by_a_bounded_number_of_rows(spark):
    """An id with many rows, alike or not, adds no more than the bound; every language gets its rows."""
    rows = [(1, f"same id {k % 50}", "en") for k in range(2000)] + [(k, f"text {k}", "en") for k in range(50)] + [(7, "ein", "de")] * 300 + [(k, "uno", "es") for k in range(900, 930)]
    rows += [(None, "x", "fr"), (3, None, "fr"), (4, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    for most in (100, 20):
        got = collections.Counter(r["lang"] for r in language_id.taught(docs, most).collect())
        assert got == {"en": most, "de": min(300, most), "es": min(30, most)}
    turns = [(r["lang"], r["turn"]) for r in language_id.taught(docs, 100).collect()]
    assert len(turns) == len(set(turns)) and max(t for _, t in turns) == 100
    assert language_id.fit(docs, fit_rows=20).langs == ["de", "en", "es"]


def test_language_id(spark):
    rng = random.Random(4)
    tongue = {"en": ["the", "and", "thing", "which", "water"], "de": ["und", "nicht", "schön", "wasser", "zeit"]}
    rows = [(i, " ".join(rng.choice(tongue[k]) for _ in range(rng.randrange(1, 60))), k) for i in range(300) for k in [["en", "de"][i % 2]]]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !!", None), (902, "", "de"), (903, "é", None)], "doc_id long, text string, lang string")
    model = language_id.fit(df.where(~language_id.held_out()))
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in test) >= 0.95 * len(test)
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] for i in (900, 901, 902))
    assert got[903]["lang_pred"] in tongue and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language_id.predict(df, language_id.fit(df.limit(0))).collect()} == {"und"}


def test_substring_dedup(spark, empty):
    rng = random.Random(8)
    passage = text(rng, 70, 100_000)
    rows = [(i, text(rng, 200, 100_000)) for i in range(20)]
    for i in (4, 9, 15):
        w = rows[i][1].split()
        rows[i] = (i, " ".join([*w[:50], passage, *w[50:]]))
    rows += [(50, None), (51, ""), (None, passage)]
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(got) == [9, 15]
    assert all(r["source_doc_id"] == 4 and 50 <= r["spans"][0]["start"] and r["spans"][-1]["end"] <= 120 for r in got.values())
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_near_paragraphs(spark):
    rng = random.Random(2)
    a = text(rng, 60, 100_000).split()
    b = list(a)
    b[30] = "other"
    rows = [(1, "first line\n" + " ".join(a)), (2, text(rng, 40, 100_000) + "\n" + " ".join(b))]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], [(s["start"], s["end"]) for s in r["spans"]]) for r in got] == [(2, [(40, 100)])]


@pytest.mark.parametrize("size", [31, 45, 52])
def test_exact_passages_go_whole(spark, size):
    """Equal lines, and equal passages inside longer lines, to their first and last words."""
    rng = random.Random(size)
    rows, want = [], {}
    for i in range(40):
        passage, inside = text(rng, size, 100_000), i % 2
        for k, (before, after) in enumerate([(37, 41), (50, 29)]):
            sep = " " if inside else "\n"
            rows.append((2 * i + k, sep.join([text(rng, before, 100_000), passage, text(rng, after, 100_000)])))
        want[2 * i + 1] = (2 * i, [(50, 50 + size)])
    found = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["source_doc_id"], [(s["start"], s["end"]) for s in r["spans"]]) for r in found} == want


def test_equal_runs_against_brute_force(spark):
    """All runs of RUN words that an earlier document has go, where texts are patched together from few passages."""
    rng = random.Random(12)
    stock = [text(rng, rng.randrange(20, 90), 100_000).split() for _ in range(12)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(stock)
            a = rng.randrange(len(p) // 2)
            w += text(rng, rng.randrange(0, 25), 100_000).split() + p[a : rng.randrange(a + 1, len(p) + 1)]
        rows.append((rng.randrange(10_000), " ".join(w)))
    rows = list({r[0]: r for r in rows}.values())
    k, first = substring_dedup.RUN, {}
    for i, t in sorted(rows):
        w = t.split()
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j : j + k]), i)
    got = {r["doc_id"]: {x for s in r["spans"] for x in range(s["start"], s["end"])} for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = 0
    for i, t in rows:
        w = t.split()
        want = {x for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] != i for x in range(j, j + k)}
        assert want <= got.get(i, set())
        n += len(want)
    assert n > 500


def test_all_pairs_of_a_bucket_are_compared(spark):
    """A family of paragraphs that share 44 of 56 shingles and do not link, with pairs inside it that do: J = 50 / 62."""
    rng = random.Random(21)
    stem = text(rng, 48, 100_000)
    rows = []
    for i in range(100):
        own = text(rng, 12, 100_000).split()
        rows += [(3 * i, " ".join([stem, *own])), (3 * i + 1, " ".join([stem, *own[:6], text(rng, 6, 100_000)])), (3 * i + 2, f"{stem} {text(rng, 12, 100_000)}")]
    order = rng.sample(range(300), 300)
    rows = [(order[i], t) for i, t in rows]
    sets = {i: shingles(t) for i, t in rows}
    want = {max(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    got = {r["doc_id"]: r["begins"] for r in substring_dedup._near_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) == 100 and set(got) == want


def test_mixing_meets_margins(spark, docs, empty):
    rng = random.Random(6)
    rows = [(i, "x " * rng.randrange(1, 40), rng.choice(["a", "b", None]), rng.choice(["p", "p", "q"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(df, margins=("source", "lang"), targets={"source": {"p": 0.5, "q": 0.5}}).collect()
    assert len(got) == 3000
    by = collections.defaultdict(float)
    for r in got:
        by[r["source"]] += r["weight"] * r["n_tokens"]
    total = sum(r["n_tokens"] for r in got)
    assert by["p"] / total == pytest.approx(0.5, abs=1e-6)
    assert sum(r["p_keep"] * r["n_tokens"] for r in got) == pytest.approx(0.5 * total, rel=1e-9)
    kept = sum(r["n_tokens"] for r in got if r["kept"])
    assert abs(kept - 0.5 * total) < 0.06 * total
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(empty).count() == 0


def test_warc(spark, empty):
    rows = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u\r\nX: y", None), (4, "http://b", ""), (5, "http://c", "ü" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(df).where("kind = 'record'").collect()}
    assert got == {1: (8, "revisit", 2), 2: (8, "response", None), 3: (0, "revisit", 4), 4: (0, "response", None), 5: (200_000, "response", None)}
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_warc_with_null_ids_ties_and_clashing_columns(spark):
    rows = [(None, "u", "a" * 50), (3, None, "a" * 50), (3, "v", "a" * 50), (2, "w", "a" * 50), (None, "x", "alone"), (None, "x", "alone"), (-1, "y", "minus"), (7, "z", None), (8, "z", ""), (9, "l", "x" * 300_000)]
    df = spark.createDataFrame([(*r, "no", 1) for r in rows], "page_id long, url string, html string, payload string, digest int").repartition(3)
    got = warc.archive_pages(df).where("kind = 'record'").select("page_id", "payload_bytes", "record_type", "refers_to").collect()
    want = [(None, 50, "revisit", 3), (3, 50, "response", None), (3, 50, "response", None), (2, 50, "revisit", 3), (None, 5, "response", None), (None, 5, "response", None), (-1, 5, "response", None), (7, 0, "revisit", 8), (8, 0, "response", None), (9, 300_000, "response", None)]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def test_damaged_archives_through_spark(spark, tmp_path):
    """Records around the damage are read, and every byte of the archives lies in a sound record or in a logged gap."""
    pages = spark.createDataFrame([(i, f"http://{i}", f"page {i} " * (20 + i)) for i in range(60)], "page_id long, url string, html string").repartition(2)
    folder = f"file://{tmp_path}/w"
    warc.write_warc(pages, folder).count()
    rng, whole = random.Random(4), {}
    for path in sorted((tmp_path / "w").glob("*.warc.gz")):
        content = bytearray(path.read_bytes())
        starts = [x["start"] for _, x in warc.salvage(bytes(content))]
        for at in rng.sample(starts[1:], 4):
            content[at + 40] ^= 0xFF
        # a record whose block is sound but whose payload has another digest
        content += warc.record(1000, "u", b"payload", 7, warc.base32(b"x" * 20), None)
        path.write_bytes(bytes(content[5:]))  # and the first record loses its beginning
        whole[path.name] = len(content) - 5
    read = spark.read.format("binaryFile").load(folder)
    got = warc.read_warc(read).collect()
    gaps = [r for r in got if r["kind"] == "gap"]
    records = {r["page_id"]: bytes(r["payload"]).decode() for r in got if r["kind"] == "record"}
    assert all(t == f"page {i} " * (20 + i) for i, t in records.items())
    assert len(records) == 60 - 5 * len(whole) and 1000 not in records
    assert all(r["gap_start"] < r["gap_end"] <= whole[r["file"]] and r["reason"] for r in gaps)
    assert {r["page_id"] for r in gaps if r["reason"].startswith("the payload")} == {1000}
    for name, size in whole.items():
        content = (tmp_path / "w" / name).read_bytes()
        sound = [(x["start"], x["end"]) for k, x in warc.salvage(content) if k == "record" and x["warc-record-id"] != "<urn:page:1000>"]
        spans = sorted(sound + [(r["gap_start"], r["gap_end"]) for r in gaps if r["file"] == name])
        assert spans[0][0] == 0 and spans[-1][1] == size and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_language_model_keeps_null_and_repeated_ids(spark):
    rows = [(None, "a b c"), (4, "a b"), (4, "a b"), (-1, "c"), (None, None), (5, "")]
    df = spark.createDataFrame([(*r, False, 1) for r in rows], "doc_id long, text string, held_out boolean, pack int").repartition(2)
    got = language_model.score(df).select("doc_id", "n_tokens").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter([(None, 4), (4, 3), (4, 3), (-1, 2), (None, 1), (5, 1)])


def test_salvage():
    parts = [warc.record(i, "http://x", b"p" * i, i, warc.base32(__import__("hashlib").sha1(b"p" * i).digest()), None) for i in range(1, 6)]
    whole = b"".join(parts)
    start, end = len(parts[0]) + len(parts[1]), len(b"".join(parts[:3]))
    broken = whole[: start + 30] + bytes([whole[start + 30] ^ 255]) + whole[start + 31 :]
    found = list(warc.salvage(broken))
    assert [x["warc-record-id"] for k, x in found if k == "record"] == [f"<urn:page:{i}>" for i in (1, 2, 4, 5)]
    assert [x[:2] for k, x in found if k == "gap"] == [(start, end)]
    plain = b"".join(gzip.decompress(p) for p in parts)
    found = list(warc.salvage(b"junk" + plain[:-7]))
    assert [k for k, _ in found] == ["gap", "record", "record", "record", "record", "gap"]


def test_language_model(docs, empty):
    test = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {r[0]: [*WORD.findall((r[1] or "").translate(LOWER)), None] for r in corpus()}
    counts = collections.Counter(w for i, t in tokens.items() if not test(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in language_model.score(docs.withColumn("held_out", language_id.held_out(parts=7, part=2))).collect()}
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (test(i), len(t), sum(counts[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] < 0
    assert language_model.score(empty.withColumn("held_out", language_id.held_out())).count() == 0


def test_language_model_is_normalised():
    """Over all words and the unknown one, each context's probabilities sum to 1."""
    rng = np.random.default_rng(2)
    pairs = sorted({(int(w), int(c)) for w, c in zip(rng.integers(1, 60, 300), rng.integers(0, 17, 300), strict=True)})
    word, context = (np.array(x) for x in zip(*pairs, strict=True))
    seating = language_model.Seating(0, word.astype(np.uint64), context, rng.integers(1, 200, len(pairs)))
    x = seating.sums()
    totals = language_model.Totals(x[:17], x[17:34], x[34], int(x[35]))
    seating.sweep(0, totals)
    x = seating.sums()
    totals = language_model.Totals(x[:17], x[17:34], x[34], int(x[35]))
    parent = totals.parent(seating.parent_customers, seating.parent_tables)
    rest = totals.parent_pull() / (totals.vocabulary + 1) / (language_model.PARENT_STRENGTH + totals.tables.sum())
    assert parent.sum() + rest == pytest.approx(1)
    for c in range(17):
        own = np.zeros(len(seating.dishes))
        m = seating.context == c
        own[seating.dish[m]] = seating.count[m] - language_model.DISCOUNT * seating.tables[m]
        p = (own + totals.pull()[c] * parent) / (language_model.STRENGTH + totals.customers[c])
        assert p.sum() + totals.pull()[c] * rest / (language_model.STRENGTH + totals.customers[c]) == pytest.approx(1)


def test_ngram_join_with_given_classes(spark):
    """Classes that are given join their ids, and with them what links reach; other results are as without them."""
    rng = random.Random(33)
    stem = text(rng, 60, 100_000).split()
    rows = []
    for i in range(60):
        w = list(stem)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(60)] = f"v{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, text(rng, 30, 100_000)) for i in range(5)] + [(200, rows[7][1]), (201, None)]
    sets = {i: shingles(t) for i, t in rows}
    linked = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert len(linked) > 200
    given = [(i, j) for i, j in linked if i % 7 == 3][:12] + [(100, 104)]

    def classes(edges):
        of = {i: i for i in sets}
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                if of[a] != of[b]:
                    of[a] = of[b] = min(of[a], of[b])
                    changed = True
        return of

    start = classes(given)
    known = spark.createDataFrame([(i, c) for i, c in start.items() if sum(x == c for x in start.values()) > 1] + [(999, 3)], "node long, component long")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(df, joined=known).collect()}
    assert got == classes(linked + given)


def test_hubs_join_a_family(spark):
    """Variants that link with their original and not with each other: one comparison each with the hub."""
    pairs = [(1, 5), (1, 9), (1, 12), (1, 20), (2, 9), (2, 30), (3, 4)]
    links = [(5, 9), (9, 12), (2, 9)]
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    got = {(r["a"], r["b"]) for r in substring_dedup._hubs(frame(pairs), frame(links)).collect()}
    assert got == {(5, 9), (9, 12), (9, 20), (9, 30)}
    assert substring_dedup._hubs(frame(pairs), frame(links).limit(0)).count() == 0
