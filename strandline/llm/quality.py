"""Document quality: rule statistics and a hashed n-gram likelihood ratio, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import SPACE, fixed

#: Hash buckets of the two multinomials; the table of ratios that scoring carries has so many doubles.
BUCKETS = 1 << 16
#: Nats per n-gram below which a document is unlike the trusted target.
THRESHOLD = -0.25
#: Trusted documents that the target multinomial is fitted on at most: those of the smallest hashed ids.
TRUSTED = 20_000
#: Words in a window for the repetition rule.
WINDOW = 8


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def tokens_of(text: Column) -> Column:
    """Runs of letters and digits, and runs of other signs, in lower case; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"), F.lit(0))


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def exploded_buckets(df: DataFrame, text: Column, *keep: str, buckets: int = BUCKETS) -> DataFrame:
    """``keep`` and the bucket b of every token and of every two tokens in a row, a row each.

    Tokens meet their successors in native arrays, so hashing is compiled code.
    """
    toks = df.select(*keep, fixed(tokens_of(text)).alias("__t"))
    pairs = toks.select(*keep, F.explode(F.arrays_zip(F.col("__t").alias("x"), F.slice("__t", 2, F.greatest(F.size("__t"), F.lit(1))).alias("y"))).alias("p"))
    first = F.xxhash64("p.x")
    both = F.when(F.col("p.y").isNotNull(), F.array(_bucket(first, buckets), _bucket(F.xxhash64(first, F.xxhash64("p.y")), buckets))).otherwise(F.array(_bucket(first, buckets)))
    return pairs.select(*keep, F.explode(both).alias("b"))


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> list[float]:
    """log(p_target / p_raw) per bucket; 0 where the raw documents have nothing.

    The target has ``buckets`` pseudo-counts, dealt in proportion to the raw
    counts, so what the trusted documents say little about stays near ratio 0,
    and without trusted documents every ratio is 0. Raw counts cover all documents. The target is fitted on a sample of
    ``trusted`` ids of at most TRUSTED, so that they can be broadcast and no
    text is shuffled. Counting is one partial aggregation onto at most
    ``buckets`` keys, so what reaches the driver is bounded.
    """
    ids = trusted.where(F.col(trusted.columns[0]).isNotNull()).select(F.col(trusted.columns[0]).alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(TRUSTED)
    slim = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    marked = slim.join(F.broadcast(ids.withColumn("__good", F.lit(1))), F.col("__doc") == F.col("__id"), "left").select("__text", F.coalesce("__good", F.lit(0)).cast("long").alias("__good"))
    counts = exploded_buckets(marked, F.col("__text"), "__good", buckets=buckets)
    r, g = [0] * buckets, [0] * buckets
    for row in counts.groupBy("b").agg(F.count("*").alias("raw"), F.sum("__good").alias("good")).collect():  # at most ``buckets`` rows
        r[row.b], g[row.b] = row.raw, row.good
    all_r, all_g = max(sum(r), 1), sum(g)
    return [math.log((y + buckets * x / all_r) / (all_g + buckets) / (x / all_r)) if x else 0.0 for x, y in zip(r, g, strict=True)]


def rule_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``rules``: struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words).

    A null or empty text has no words and 0 everywhere. n_repeat_words counts
    words within windows of eight words that occur at least twice in the text;
    windows are compared by their 64-bit hashes within one document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    df = docs.withColumn("__w", fixed(words_of(F.col(text_col)))).withColumn("__l", fixed(lines))
    df = df.withColumn("__v", fixed(F.transform(F.col("__w"), lambda w: F.xxhash64(w))))
    windows = F.arrays_zip(*[F.slice("__v", k + 1, F.size("__v") - WINDOW + 1).alias(f"v{k}") for k in range(WINDOW)])
    df = df.withColumn("__h", fixed(F.when(F.size("__v") > WINDOW, F.transform(windows, lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))))
    some = F.size(F.array_distinct("__h")) < F.size("__h")
    df = df.withColumn("__s", fixed(F.when(some, F.sort_array(F.transform(F.col("__h"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))))
    same = lambda i: (F.get(F.col("__s"), i)["h"] == F.get(F.col("__s"), i + 1)["h"])
    twice = F.filter(F.col("__s"), lambda x, i: F.coalesce(same(i), F.lit(False)) | F.coalesce(F.when(i > 0, same(i - 1)), F.lit(False)))
    df = df.withColumn("__p", fixed(F.sort_array(F.transform(twice, lambda x: x["i"]))))
    after = lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__p"), i + 1) - p, F.lit(WINDOW)))
    covered = F.aggregate(F.transform(F.col("__p"), after), F.lit(0), lambda a, b: a + b)
    rules = F.struct(
        F.size("__w").cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return df.withColumn("rules", fixed(rules)).drop("__w", "__l", "__v", "__h", "__s", "__p")


def judged(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``rules``, ``base_failed``, ``log_ratio`` (mean per n-gram) and ``kept``.

    A document is kept if it passes the rules and its mean log ratio is at least
    ``threshold``. One without tokens has ratio 0, and the rules reject it. If
    no document is trusted, all ratios are 0 and the rules alone decide.
    Null ids are judged like others but are never trusted; repeated rows count
    as often as they occur. Columns named like the new ones are replaced.
    """
    weights = log_ratios(docs, trusted, id_col, text_col, buckets)
    # a constant of a fixed size, 8 bytes a bucket
    table = docs.sparkSession.createDataFrame([(weights,)], "w array<double>").scalar()
    df = rule_statistics(docs, text_col).withColumn("__f", fixed(F.transform(tokens_of(F.col(text_col)), lambda t: F.xxhash64(t)))).withColumn("__r", table)
    ratio = lambda h: F.get("__r", _bucket(h, buckets))
    pair = lambda h, i: F.xxhash64(h, F.get("__f", i + 1))
    each = F.transform(F.col("__f"), lambda h, i: F.when(i < F.size("__f") - 1, ratio(h) + ratio(pair(h, i))).otherwise(ratio(h)))
    total = F.aggregate(each, F.lit(0.0), lambda a, b: a + b)
    failed = (F.col("rules.n_words") < 20) | (100 * F.col("rules.n_repeat_words") > 30 * F.col("rules.n_words"))
    df = df.withColumn("log_ratio", fixed(F.when(F.size("__f") > 0, total / (2 * F.size("__f") - 1)).otherwise(0.0))).withColumn("base_failed", failed)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold)).drop("__f", "__r")
