"""URL filter: host and path rules, and association rules mined by FP-growth from labelled pages.

DataFrame functions and Spark's own FP-growth only. Mined rules are held in an
inverted index under the tokens of one of their items; a URL's tokens look them
up by an equi-join, and a rule matches if the URL has a token of each item.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import stored

# Verdict, host and path of each rule.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: The item that marks a labelled page as unwanted.
BAD = "label:bad"
#: Unwanted labelled pages that a token set needs, whatever their total, and the least share of its pages that are unwanted.
SUPPORT, CONFIDENCE = 5, 0.8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(rest, upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, start in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """Distinct tokens: host suffixes, words of the host, path segments and query keys; numbers as ``#``."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(4))), lambda n: F.concat(F.lit("host:"), F.array_join(F.slice(labels, -n, n), ".")))
    words = F.transform(F.regexp_extract_all(host, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.concat(F.lit("word:"), w))
    shape = lambda s: F.regexp_replace(F.lower(s), "[0-9]+", "#")
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("path:"), shape(s)))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda s: F.concat(F.lit("query:"), shape(s)))
    return F.array_distinct(F.when(host == "", F.concat(segments, keys)).otherwise(F.concat(suffixes, words, segments, keys)))


def mined(labelled: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(tokens, confidence, support) of the rules tokens -> unwanted, from ``labelled(url, bad)``.

    ``tokens`` is an array of arrays: a rule asks for one token of each. Tokens
    that stand in just the same labelled pages say the same and are one item, so
    a page of n such tokens is one item and not 2^n sets. (Sets of pages are
    compared by their size and two 64-bit sums.) A rule needs ``support``
    unwanted pages and may have any number of items. It is dropped if a rule
    with one item less has at least its confidence, which matches all its
    pages; so an item that is unwanted in all of its pages is a rule by itself
    and needs no mining. Labelled rows with a null url or label are left out.
    Tokens of too few unwanted pages are in no rule and not mined.
    """
    rows = labelled.where("url is not null and bad is not null").select(tokens_of(F.col("url")).alias("tokens"), "bad")
    rows = stored(rows.where(F.size("tokens") > 0).withColumn("row", F.monotonically_increasing_id()), "url-items")
    where = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"s{k}") for k in (1, 2)]
    each = rows.select("row", "bad", F.explode("tokens").alias("token"))
    tokens = each.groupBy("token").agg(F.count("*").alias("all"), F.count_if("bad").alias("bad"), *where).where(F.col("bad") >= support)
    items = stored(tokens.groupBy("all", "bad", "s1", "s2").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("any")).drop("s1", "s2"), "url-frequent")
    sure = items.where("bad = all").select(F.array("any").alias("tokens"), F.lit(1.0).alias("confidence"), F.col("bad").alias("support"))
    open_items = items.where("bad < all")
    held = each.join(open_items.select(F.col("item").alias("token")), "token").groupBy("row", "bad").agg(F.collect_list("token").alias("t"))
    held = held.select(F.concat("t", F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    held = stored(held, "url-transactions")
    # half a page less, so that rounding doesn't ask for one more
    share = min(1.0, (support - 0.5) / max(held.count(), 1))
    sets = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(held).freqItemsets.where(F.col("freq") >= support)
    found = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.col("freq").alias("bad"))
    whole = sets.where(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("all"))
    rules = stored(found.join(whole, "tokens").withColumn("confidence", F.col("bad") / F.col("all")).where(F.col("confidence") >= confidence), "url-rules")
    fewer = rules.select(F.col("tokens").alias("fewer"), F.col("confidence").alias("c"))
    less = rules.where(F.size("tokens") > 1).select("tokens", "confidence", F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))).alias("fewer"))
    kept = rules.join(less.join(fewer, "fewer").where(F.col("c") >= F.col("confidence")).select("tokens").distinct(), "tokens", "left_anti")
    named = kept.select("tokens", "confidence", "bad", F.explode("tokens").alias("item")).join(open_items.select("item", "any"), "item")
    named = named.groupBy(F.col("tokens").alias("rule")).agg(F.array_sort(F.collect_list("any")).alias("tokens"), F.first("confidence").alias("confidence"), F.first("bad").alias("support"))
    return sure.unionByName(named.drop("rule"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls of ``urls(url)`` that a mined rule matches.

    Rules are filed under the tokens of one of their items, that of the fewest
    tokens; a url's tokens look them up.
    """
    least = F.array_min(F.transform("tokens", lambda t: F.struct(F.size(t).alias("n"), t.alias("t"))))["t"]
    index = rules.select("tokens", F.explode(least).alias("anchor"))
    plain = urls.where("url is not null").distinct().withColumn("has", tokens_of(F.col("url")))
    found = plain.select("url", "has", F.explode("has").alias("anchor")).join(index, "anchor")
    return found.where(F.forall("tokens", lambda t: F.arrays_overlap(t, F.col("has")))).select("url").distinct()


def judged(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict.

    ``labels(id, bad)`` marks pages as unwanted; labels of one id that disagree
    count as unwanted. The longest fitting rule decides, else a mined rule
    blocks, else the page is allowed. A null url or one without ``://`` has an
    empty host and path, and a null url is allowed. Null ids, repeated rows and
    extra columns do no harm.
    """
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    marks = labels.select(F.col(labels.columns[0]).alias("mark"), F.col(labels.columns[1]).alias("bad")).groupBy("mark").agg(F.max("bad").alias("bad"))
    rules = stored(mined(slim.join(marks, F.col("id") == F.col("mark")).select("url", "bad")), "url-mined")
    hits = stored(matched(slim.select("url"), rules), "url-hits").withColumnRenamed("url", "hit")
    df = slim.join(hits, F.col("url") == F.col("hit"), "left")
    df = df.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("r", rule_of(F.col("host"), F.col("path")))
    other = F.when(F.col("hit").isNotNull(), "block").otherwise("allow")
    return df.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", other).alias("verdict"))
