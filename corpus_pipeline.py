"""A training-data pipeline over documents: each stage reads what the one before it wrote.

What holds for every stage: texts of any length are read whole; an empty table gives an empty one; columns besides those of
documents stay, whatever their names; but the last stage takes doc_id, lang, source and text only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import bpe, decontaminate, ngram_join, substring_dedup, toxicity
from tracemill.llm.common import Workspace, lean_workers, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled rows of these documents, does not reject.

    Without labels nothing is rejected. A null or empty text has the score of no words;
    equal texts have equal scores, so of repeated rows all stay or all go; a score of 0.5 is a rejection.
    """
    lean_workers(spark)
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with five-word shingles of similarity 0.8 or more.

    The smallest doc_id stays, of rows equal in doc_id and text one. Texts without words (null, empty, blank) are like none
    and all stay; a similarity of exactly 0.8 is a link; a null doc_id comes after all others.
    """
    lean_workers(spark)
    return ngram_join.one_of_each(docs, 5, 80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document, or an earlier place, has as well.

    Earlier is by doc_id, then by the text's hash. A row that repeats another whole row is the same document and gets the
    same result; rows with a null doc_id are compared but not cut. A document that loses all of its text stays.
    """
    lean_workers(spark)
    return substring_dedup.substring_dedup(docs).select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that windows of the benchmark cover.

    Repeated rows are treated alike; an empty benchmark, or items without words, take nothing away.
    """
    lean_workers(spark)
    return decontaminate.find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), action="remove_spans")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their count and digests; an empty text has no tokens, equal texts have equal ones."""
    lean_workers(spark)
    return bpe.bpe_digests(docs.select("doc_id", "lang", "source", "text"), bpe.default_path())


STAGES = [
    ("toxicity", keep_clean),
    ("near_copies", drop_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("benchmark_passages", drop_benchmark_passages),
    ("bpe", encode),
]

#: SQL expresses neither the fitted model nor the banding, the automaton or its digests; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over the whole table that the one before it wrote; n_chars stays that of the original text.

    A stage's input, and what its operator left in the shared folder, go when its output is there.
    """
    work, before = Workspace(spark), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with scratch():
            docs = work.write(stage(spark, docs, sf_dir))
        work.forget(before)
        before = docs
    return docs
