"""A corpus pipeline over `documents`: each stage reads what its predecessor kept, written as Parquet.

Stages, in order: language ID, n-gram Jaccard join, benchmark decontamination, secret scan, mixing.
All but the last return the columns of documents; the last returns the mix. Nulls, repeated rows and
empty tables are handled as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.llm import decontaminate, lang_id, mixing, ngram_join, secret_scan
from lumenflow.llm.common import bounded, drop_stashes, stash, table

#: Documents of an undetermined language go; so do those whose language is hardly better than a guess: LEAST_LIFT guesses, at most LEAST_SCORE.
LEAST_SCORE, LEAST_LIFT = 0.3, 1.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the labelled ones teach; a missing label is filled by the prediction. All documents if there is no label."""
    model = lang_id.train(docs)
    if not model.labels:
        return docs
    found = lang_id.predict(docs, model, pred_col="_lang", score_col="_score")
    kept = found.where((F.col("_lang") != lang_id.UND) & (F.col("_score") >= min(LEAST_SCORE, LEAST_LIFT / len(model.labels))))
    return kept.withColumn("lang", F.coalesce("lang", "_lang")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, 5, 80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window."""
    key = F.xxhash64("doc_id", "text")
    index = decontaminate.build_index(docs.select(key.alias("doc_id"), "text"))
    found = decontaminate.search_index(index, table(spark, sf_dir, "benchmark"))
    dirty = stash(found.where(F.size("spans") > 0).select(F.col("id").alias("_key")).distinct())
    drop_stashes(index)
    return docs.withColumn("_key", key).join(bounded(dirty), "_key", "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: copies and words taken of each document."""
    return mixing.pareto_mix(docs)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("secret_scan", secrets),
    ("mixing", mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
