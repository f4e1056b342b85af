"""Personal data: fixed patterns, and terms that disclose protected values by corpus co-occurrence.

DataFrame functions only. For a protected value e (an e-mail address, phone,
card or IP number) and a term t, P(e|t) = df(e, t) / df(t) is the share of the
documents with t that have e. Copies of one text are one document. The information that t gives about e
is PMI(e; t) = log2(P(e|t) N / df(e)), at most IC(e) = log2(N / df(e)); a term
whose PMI reaches ``disclosure`` of IC(e) gives e away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import bitmap, fixed, in_bitmap, let, match_spans, no_spans, replaced, running, stored, uncovered

# Kinds in their order and patterns. The look-behinds only keep a failed
# run from being tried again at each of its characters.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9]|[\x20-][0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone")

#: Share of IC(e) that the PMI of a disclosing term reaches.
DISCLOSURE = 0.9


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind the sorted spans of a text that isn't null."""
    size = lambda s: F.char_length(_digits(s["hit"]))
    found = {
        "email": (text.contains("@"), EMAIL, lambda s: F.lit(True)),
        "ip": (text.rlike(r"[0-9]\.[0-9]"), IP, lambda s: s["hit"].rlike(rf"^{BYTE}(\.{BYTE}){{3}}$")),
        "card": (text.rlike(r"[0-9][\x20-]?[0-9]"), CARD, lambda s: _luhn(_digits(s["hit"]))),
        "phone": (text.contains("+"), PHONE, lambda s: size(s).between(9, 15)),
    }
    return {kind: F.when(may, F.filter(match_spans(text, pattern, kind, KINDS.index(kind)), test)).otherwise(no_spans()) for kind, (may, pattern, test) in found.items()}


def _terms(s: Column) -> Column:
    """Lower-case words of letters, two at least."""
    return F.regexp_extract_all(F.lower(s), F.lit(r"\p{L}{2,}"), F.lit(0))


def disclosing_terms(found: DataFrame, text_col: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """(term, kind) of the terms over the threshold, from a frame with ``text_col`` and ``base`` spans.

    All counts are numbers of different texts and cover all of them: a term
    counts wherever it stands in the document, and a value seen once counts
    like any other. As df(e, t) is at most df(e), a disclosing term has at most
    df(e) (N / df(e)) ** (1 - disclosure) documents; commoner terms are never
    paired with values. Every count is combined before its shuffle, so no value
    or term gathers its documents in one task.
    """
    value = lambda s: F.struct(s["kind"].alias("kind"), F.lower(s["hit"]).alias("value"))
    base, text = F.col("base"), F.col(text_col)
    copies = stored(found.groupBy(F.xxhash64(text).alias("h")).agg(F.count("*").alias("copies")), "pii-copies")
    n = max(copies.count(), 1)
    spots = found.where(F.size(base) > 0).select(F.xxhash64(text).alias("h"), F.array_distinct(F.transform(base, value)).alias("vals"), fixed(F.array_distinct(_terms(text))).alias("t"))
    spots = stored(spots.dropDuplicates(["h"]), "pii-spots")
    values = stored(spots.select(F.explode("vals").alias("v")).groupBy("v").agg(F.count("*").alias("df_e")), "pii-values")
    most = values.agg(F.max(F.col("df_e") * F.pow(n / F.col("df_e"), F.lit(1 - disclosure)))).first()[0] or 0.0
    repeated = copies.where("copies > 1").withColumnRenamed("h", "r")
    # each of a text's copies counts as its share
    words = found.select(F.xxhash64(text).alias("h"), fixed(F.array_distinct(_terms(text))).alias("t")).join(repeated, F.col("h") == F.col("r"), "left")
    words = words.select(F.explode("t").alias("term"), (1 / F.coalesce("copies", F.lit(1))).alias("share"))
    rare = words.groupBy("term").agg(F.round(F.sum("share")).alias("df_t")).where(F.col("df_t") <= most + 1e-6)
    pairs = spots.select("vals", F.explode("t").alias("term")).join(rare, "term").select("term", "df_t", F.explode("vals").alias("v"))
    pairs = pairs.groupBy("v", "term").agg(F.count("*").alias("both"), F.max("df_t").alias("df_t"))
    ic = F.log2(n / F.col("df_e"))
    pmi = F.log2(F.col("both") * n / (F.col("df_e") * F.col("df_t")))
    return pairs.join(values, "v").where((ic > 0) & (pmi >= disclosure * ic - 1e-9)).groupBy("term").agg(F.min("v.kind").alias("kind"))


#: Terms of a text up to which each word is looked up among them; beyond, words and terms are sorted.
FEW = 32


def _told(words: Column, terms: Column) -> Column:
    """Those of the ``words`` (spans) whose hit in lower case is one of ``terms``, by start; time is n log n in both."""
    some = lambda w: F.filter(w, lambda s: F.array_contains(terms, F.lower(s["hit"])))
    return let(words, lambda w: F.when(F.size(terms) <= FEW, some(w)).otherwise(_sorted_told(w, terms)))


def _sorted_told(words: Column, terms: Column) -> Column:
    # sorted by word, a term stands right before the words that it is
    mark = lambda word, term, s: F.struct(word.alias("word"), term.isNull().alias("own"), term.alias("term"), s.alias("s"))
    no_term, no_span = F.lit(None).cast("string"), F.lit(None).cast("struct<start:int,rank:int,end:int,kind:string,hit:string>")
    events = F.array_sort(F.concat(F.transform(terms, lambda t: mark(t, t, no_span)), F.transform(words, lambda s: mark(F.lower(s["hit"]), no_term, s))))

    def hits(e: Column) -> Column:
        last = running(F.transform(e, lambda x: x["term"]), lambda x, y: F.coalesce(y, x), no_term)
        kept = F.filter(F.zip_with(e, last, lambda x, t: F.struct(x.alias("x"), t.alias("t"))), lambda y: y["x"]["own"] & (y["x"]["word"] == y["t"]))
        return F.array_sort(F.transform(kept, lambda y: y["x"]["s"]))

    return let(events, hits)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` (a struct of sorted span arrays, by kind) and ``spans`` (all spans, by kind then start).

    ``spans`` adds, as kind ``term``, the words that disclose a protected value
    of the corpus, in every document that has them. A null text is empty. The
    result of a row depends on its text alone besides the corpus counts, so
    null ids and repeated rows need no care; repeated texts count once. Columns
    ``base``, ``spans`` and ``terms`` are replaced. Only texts that may have a
    disclosing term are joined with their terms; the others stay where they are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(text.alias("text")).withColumn("base", fixed(F.concat(*base_spans(F.col("text")).values())))
    terms = stored(disclosing_terms(plain), "pii-terms")
    rare = bitmap(terms.select(F.xxhash64("term").alias("h")))
    words = docs.select(F.xxhash64(text).alias("key"), fixed(F.array_distinct(_terms(text))).alias("t")).withColumn("b", rare)
    some = words.select("key", F.explode(F.filter("t", lambda t: in_bitmap(F.col("b"), F.xxhash64(t)))).alias("term"))
    held = stored(some.join(terms, "term").groupBy("key").agg(F.collect_set("term").alias("terms")), "pii-held")
    marked = docs.drop("terms").withColumn("__h", F.xxhash64(text)).withColumn("__m", bitmap(held.select(F.col("key").alias("h"))))
    may = in_bitmap(F.col("__m"), F.col("__h"))
    told = marked.where(may).join(held.withColumnRenamed("key", "__key"), F.col("__h") == F.col("__key"), "left").drop("__key")
    df = told.unionByName(marked.where(~may).withColumn("terms", F.lit(None).cast("array<string>"))).drop("__h", "__m")
    by_kind = base_spans(text)
    term = F.when(F.col("terms").isNotNull(), _told(match_spans(text, r"\p{L}{2,}", "term", len(KINDS)), F.col("terms"))).otherwise(no_spans())
    df = df.withColumn("base", fixed(F.struct(*[c.alias(k) for k, c in by_kind.items()]))).withColumn("__t", fixed(term))
    df = df.withColumn("__b", fixed(F.concat(*[F.col(f"base.{k}") for k in KINDS])))
    return df.withColumn("spans", F.concat("__b", uncovered(F.col("__t"), F.col("__b")))).drop("__t", "__b", "terms")


def sanitised(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with protected values and disclosing terms generalised to their kind in brackets."""
    df = scan(docs, text_col)
    return df.withColumn(text_col, F.when(F.size("spans") > 0, replaced(F.col(text_col), F.col("spans"))).otherwise(F.col(text_col))).drop("base", "spans")
