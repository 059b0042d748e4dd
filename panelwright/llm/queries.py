"""The queries of this subpackage for the entry file, each over its whole table, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import ann as _ann
from panelwright.llm import decontaminate as _decontaminate
from panelwright.llm import divergence as _divergence
from panelwright.llm import language_id as _language
from panelwright.llm import language_model as _model
from panelwright.llm import licenses as _licenses
from panelwright.llm import mixing as _mixing
from panelwright.llm import ngram_join as _ngram
from panelwright.llm import ranked_search as _search
from panelwright.llm import substring_dedup as _substring
from panelwright.llm import token_counts as _counts
from panelwright.llm import token_store as _store
from panelwright.llm import warc as _warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ngram.ngram_join(_table(spark, sf_dir, "documents"))


def _tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = _language.fit(docs.where(~_language.held_out()))
    return _language.predict(docs, model).withColumn("held_out", _language.held_out())


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontaminate.report(_decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return _ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _substring.substring_dedup(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _warc.archive_pages(_table(spark, sf_dir, "pages")).where("kind = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store.token_store(_table(spark, sf_dir, "documents"), _tokenizer()).drop("file")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _model.score(docs.withColumn("held_out", _language.held_out(parts=7, part=2)))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's divergences from the others of its language, and its 200 leading terms."""
    return _divergence.divergences(_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item, over all documents."""
    return _search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    return _licenses.scan(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_nearest_neighbours": op2_nearest_neighbours,
        "op3_token_counts": op3_token_counts,
        "op4_language_id": op4_language_id,
        "op5_benchmark_decontamination": op5_benchmark_decontamination,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_mixing": op7_mixing,
        "op8_warc": op8_warc,
        "op9_token_id_output": op9_token_id_output,
        "op10_language_model": op10_language_model,
        "op11_source_divergence": op11_source_divergence,
        "op12_ranked_search": op12_ranked_search,
        "op13_license_scan": op13_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return _SQL | {"op7_mixing": _mixing_sql(), "op13_license_scan": _license_sql()}


def _license_sql() -> str:
    """Blocks, templates and phrases as the operator's constants have them; every block is held against every template."""
    half = _licenses.BLOCK // 2
    templates = ", ".join(f"({k}, '{label}', list_distinct(string_split('{words}', ' ')))" for k, (label, words) in enumerate(_licenses.TEMPLATES))
    phrases = ", ".join(f"('{label}', string_split('{words}', ' '))" for label, words in _licenses.PHRASES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
t AS (SELECT * FROM (VALUES {templates}) AS x(k, label, s)),
f AS (SELECT * FROM (VALUES {phrases}) AS x(label, p)),
b AS (SELECT DISTINCT r, i, unnest(w[i * {half} + 1:i * {half} + {_licenses.BLOCK}]) AS g FROM (SELECT r, w, unnest(range(0, greatest(ceil((len(w) - {_licenses.BLOCK}) / {half})::BIGINT, 0) + 1)) AS i FROM d WHERE len(w) > 0)),
m AS (SELECT r, label, count(*) / len(s) AS score FROM b JOIN (SELECT k, label, s, unnest(s) AS g FROM t) USING (g) GROUP BY r, i, k, label, s HAVING count(*) >= ceil(round({_licenses.THRESHOLD} * len(s), 9))),
n AS (SELECT r, i - 1 AS place, f.label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d), f WHERE w[i:i + len(p) - 1] = p),
p AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM n GROUP BY r),
bl AS (SELECT r, string_agg(label, ',' ORDER BY label) AS l FROM (SELECT DISTINCT r, label FROM n) GROUP BY r),
al AS (SELECT r, string_agg(label, ',' ORDER BY label) AS l FROM (SELECT r, label FROM n UNION SELECT r, label FROM m) GROUP BY r),
x AS (SELECT r, max(score) AS score FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(bl.l, '') AS base_labels, coalesce(al.l, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(x.score, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN p USING (r) LEFT JOIN bl USING (r) LEFT JOIN al USING (r) LEFT JOIN x USING (r)"""


def _mixing_sql() -> str:
    """The raking rounds one after the other, as the operator's defaults have them."""
    margins, parts = _mixing.MARGINS, []
    keys = ", ".join(margins)
    parts.append(f"""r AS (SELECT doc_id, source, lang, CASE WHEN contains(text, 'icense') OR contains(text, 'opyright') THEN 'legal' WHEN contains(text, 'http') OR contains(text, '@') THEN 'web'
  WHEN regexp_matches(text, '[0-9]') THEN 'numbers' ELSE 'prose' END AS topic, coalesce(len(regexp_extract_all(text, '{_SPACED}')), 0)::BIGINT AS n_tokens FROM documents)""")
    parts.append(f"c AS (SELECT {keys}, sum(n_tokens)::DOUBLE AS tokens FROM r GROUP BY {keys})")
    for m in margins:
        parts.append(f"t_{m} AS (SELECT {m} AS v, sum(tokens) ** {_mixing.FLATTEN} / sum(sum(tokens) ** {_mixing.FLATTEN}) OVER () AS target_{m} FROM c GROUP BY {m})")
    joins = " ".join(f"JOIN t_{m} ON t_{m}.v IS NOT DISTINCT FROM c.{m}" for m in margins)
    parts.append(f"s0 AS (SELECT c.*, {', '.join(f'target_{m}' for m in margins)}, tokens / sum(tokens) OVER () AS share FROM c {joins})")
    last = "s0"
    for k in range(_mixing.ROUNDS):
        for m in margins:
            now = f"s{k}_{m}"
            parts.append(f"{now} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(share) OVER (PARTITION BY {m}) > 0 THEN share * target_{m} / sum(share) OVER (PARTITION BY {m}) ELSE 0 END AS share) FROM {last})")
            last = now
    parts.append(f"w AS (SELECT *, CASE WHEN tokens > 0 THEN share * sum(tokens) OVER () / tokens ELSE 1.0 END AS weight, sum(tokens) OVER () AS total FROM {last})")
    order = f"ORDER BY weight DESC, {keys}"
    parts.append(f"""f AS (SELECT *, ({_mixing.BUDGET} * total - coalesce(sum(tokens) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(share) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * total) AS factor FROM w)""")
    parts.append("g AS (SELECT arg_max(factor, weight) AS factor FROM f WHERE factor * weight <= 1)")
    parts.append(f"p AS (SELECT {keys}, weight, CASE WHEN tokens = 0 THEN 1.0 WHEN g.factor IS NULL THEN CASE WHEN share > 0 THEN 1.0 ELSE 0.0 END ELSE least(weight * greatest(g.factor, 0), 1.0) END AS p_keep FROM f, g)")
    same = " AND ".join(f"p.{m} IS NOT DISTINCT FROM r.{m}" for m in margins)
    return f"""WITH {", ".join(parts)}
SELECT doc_id, {", ".join(f"r.{m}" for m in margins)}, n_tokens, weight, p_keep, ('0x' || substr(md5(doc_id::VARCHAR || ':{_mixing.SEED}'), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 < p_keep AS kept
FROM r JOIN p ON {same}"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

_SQL = {
    "op11_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '{_LETTERS}') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS item FROM d),
k AS (SELECT lang, item FROM t GROUP BY lang, item HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, item, count(*) AS n FROM t JOIN k USING (lang, item) GROUP BY ALL),
e AS (SELECT g.lang, g.source, k.item, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.item = k.item),
p AS (SELECT lang, source, item, n, (1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v))::BIGINT AS p FROM e JOIN v USING (lang)),
l AS (SELECT lang, item, (1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v))::BIGINT AS q FROM (SELECT lang, item, sum(n) AS n FROM n GROUP BY lang, item) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY ALL),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', item, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN l USING (lang, item) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u
QUALIFY part = 'pair' OR rank <= 200""",
    "op12_ranked_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_ALNUM}')) AS g FROM benchmark),
c AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
t AS (SELECT r, g, count(*) AS tf FROM (SELECT r, unnest(w) AS g FROM d) WHERE g IN (SELECT g FROM b) GROUP BY r, g),
f AS (SELECT g, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t, c GROUP BY g, n),
m AS (SELECT r, 100 - 50 + (50 * len(w) * n) // l AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM b JOIN t USING (g) JOIN f USING (g) JOIN m USING (r) GROUP BY item_id, r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0
QUALIFY rank <= 50""",
    "op1_ngram_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
f AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
c AS (SELECT k, count(*) AS n_copies FROM f GROUP BY k)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id::BIGINT AS component_id, coalesce(c.n_copies, 1)::BIGINT AS n_copies
FROM d JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id
LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN c ON c.k = f.k""",
    "op5_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT n FROM p),
t AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, k WHERE len(w) >= n)),
o AS (SELECT DISTINCT r, t.n, i, item_id FROM t JOIN p ON t.g = p.g AND t.n = p.n),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT r, n, i FROM o)) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM o) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(s, ((i // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM x""",
}
