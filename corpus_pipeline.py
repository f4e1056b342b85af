"""Corpus preparation: quality rules, near-duplicate removal, secret scan, packing.

Each stage takes what its predecessor kept and returns the columns of
``documents``, but for the last, which returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import packing, quality, queries, secrets, shared, shingles, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    trusted = queries.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.judged(docs.select(*COLUMNS), trusted).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingle similarities of 0.8 or more, that of the smallest id."""
    return simhash.keep_one(docs.select(*COLUMNS), groups=shingles.similar_groups)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the kind of each; n_chars counts the new text."""
    clean = secrets.redacted(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences."""
    return packing.packed(docs, queries.vocabulary())


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]
#: SQL can't express the likelihood ratio, the fingerprint groups or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over ``documents``, each written as Parquet in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        done = shared.stored(stage(spark, docs, sf_dir), name)
        if last is not None:
            shared.dropped(last)
        docs = last = done
    return STAGES[-1][1](spark, docs, sf_dir)
