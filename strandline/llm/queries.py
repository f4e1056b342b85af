"""The registered queries op1 to op10, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import html, lm, packing, pii, quality, secrets, simhash, tiff, tokens, urls
from strandline.llm.shared import spans_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The path of the tokenizer's vocabulary, which every machine has at the same place."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digest(spans: Column) -> Column:
    return F.sha2(spans_text(spans), 256)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the fixed kinds, their digest, and all spans."""
    df = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return df.select("doc_id", *[count(k) for k in secrets.KINDS], digest(F.col("base")).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document; documents labelled good are the trusted target."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    df = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    return df.select("doc_id", "rules.*", "base_failed", "kept", "log_ratio")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-context and unigram scores of every document."""
    return lm.scored(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extracted(table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to."""
    return tokens.digests(table(spark, sf_dir, "documents"), vocabulary())


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts of the fixed kinds, their digest, and all spans."""
    df = pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*[F.col(f"base.{k}") for k in pii.KINDS])
    return df.select("doc_id", *[F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS], digest(base).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces and their places in sequences of 2048."""
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary())


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL; pages labelled bad or toxic are the unwanted ones."""
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    return urls.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels").select("doc_id", bad.alias("bad")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a TIFF and read back."""
    return tiff.digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_quality, op3_lm, op4_html, op5_bpe, op6_pii, op7_packing, op8_urls, op9_simhash, op10_tiff)}
SQL: dict[str, str] = {}
