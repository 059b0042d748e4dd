"""From documents to token-ID files: language, near copies, benchmark passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages that filter return the columns
of ``documents``; the last returns a row for each document in the files. Decisions are held by doc_id: rows that repeat
an id stay or go together, and rows with a null id, which no decision can name, stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import decontaminate, language_id, mixing, ngram_join, token_store
from panelwright.llm._store import stored

#: Tokens that mixing keeps, as a share of its input's.
MIX_BUDGET = 0.8


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``docs`` but for the rows with one of ``ids``; they are written first, so that Spark knows their size when it plans the join."""
    return docs.join(stored(ids.distinct(), name), "doc_id", "left_anti").select(docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled documents and drops those whose language it rejects."""
    model = language_id.fit(docs)
    return _without(docs, language_id.predict(docs, model).where("rejected").select("doc_id"), "stage-language")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, once."""
    found = stored(ngram_join.ngram_join(docs), "stage-join")
    out = _without(docs, found.where("doc_id <> component_id").select("doc_id"), "stage-copies")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return out
    return out.where("doc_id is not null").dropDuplicates(["doc_id"]).union(out.where("doc_id is null"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.report(decontaminate.decontaminate(docs, benchmark))
    return _without(docs, found.where("contaminated").select("doc_id"), "stage-benchmark")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares by source, language and topic are nearer to even."""
    return _without(docs, mixing.mix(docs, budget=MIX_BUDGET).where(~F.col("kept")).select("doc_id"), "stage-mix")


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token-ID files and gives each document's place in them, as read back."""
    import public_tokenizers

    return token_store.token_store(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_token_ids),
]

#: Language, files and groups are beyond SQL; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
