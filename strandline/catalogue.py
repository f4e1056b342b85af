"""The registered queries and their SQL.

Operators are declared on the driver's tables. Where both engines read the same
SQL, one text serves Spark (over the views that an operator makes) and the
oracle (over its own definition of these views).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.align import flow, index, pairs
from strandline.functions import sequences
from strandline.operators import kernels, matching, regions, seeding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Words that the two engines spell differently: name -> (Spark, DuckDB).
DIALECT = {
    "SECONDS": (r"CAST(unix_timestamp(\1) AS BIGINT)", r"CAST(floor(epoch(\1)) AS BIGINT)"),
    "DAYS": (r"CAST(datediff(\1, DATE '1970-01-01') AS BIGINT)", r"CAST(date_diff('day', DATE '1970-01-01', CAST(\1 AS DATE)) AS BIGINT)"),
    "DIGIT_TRIM": (r"regexp_replace(\1, '(?<=.)/[0-9]$', '')", r"regexp_replace(\1, '^(.+)/[0-9]$', '\\1')"),
}


def spelled(sql: str, engine: int) -> str:
    for name, forms in DIALECT.items():
        sql = re.sub(rf"{name}\{{([^}}]*)\}}", forms[engine], sql)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mems(k: int) -> str:
    """The oracle's own definition of the view ``mems``."""
    cut = lambda key, name, pos: f"SELECT {key}, CAST(i AS BIGINT) AS {pos}, substr(text, CAST(i AS INT) + 1, {k}) AS kmer FROM (SELECT {key}, text, unnest(range(0, length(text) - {k - 1})) AS i FROM {name})"
    return f"""qk AS ({cut("doc_id", "documents", "qpos")}), rk AS ({cut("item_id", "benchmark", "rpos")}),
hits AS (SELECT doc_id, item_id, qpos, rpos, qpos - rpos AS diag FROM qk JOIN rk USING (kmer)),
isles AS (SELECT *, qpos - row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY qpos) AS isle FROM hits),
mems AS (SELECT doc_id, item_id, CAST(min(qpos) AS BIGINT) AS qbeg, CAST(max(qpos) + {k} AS BIGINT) AS qend, CAST(min(rpos) AS BIGINT) AS rbeg, CAST(count(*) + {k - 1} AS BIGINT) AS len FROM isles GROUP BY doc_id, item_id, diag, isle)"""


#: Intervals of a read that no other of its intervals contains, and how often each occurs.
SMEMS = """spans AS (SELECT doc_id, qbeg, qend, CAST(count(*) AS BIGINT) AS s FROM mems GROUP BY doc_id, qbeg, qend),
reach AS (SELECT *, max(qend) OVER (PARTITION BY doc_id ORDER BY qbeg, qend DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM spans),
smems AS (SELECT doc_id, qbeg, qend, s FROM reach WHERE far IS NULL OR far < qend)"""
#: The same by the definition: no other interval of the read contains it.
SMEMS_PLAIN = """spans AS (SELECT doc_id, qbeg, qend, CAST(count(*) AS BIGINT) AS s FROM mems GROUP BY ALL),
smems AS (SELECT * FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.doc_id = a.doc_id AND b.qbeg <= a.qbeg AND b.qend >= a.qend AND b.qend - b.qbeg > a.qend - a.qbeg))"""
#: Matches of one read and item on near diagonals, as chains of seeds.
CHAINS = """seeds AS (SELECT doc_id, item_id, floor((qbeg - rbeg) / 64.0) AS band, qbeg, qend, rbeg, rbeg + len AS rend FROM mems),
ends AS (SELECT *, max(qend) OVER (PARTITION BY doc_id, item_id, band ORDER BY qbeg, qend ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS qfar,
 max(rend) OVER (PARTITION BY doc_id, item_id, band ORDER BY rbeg, rend ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rfar FROM seeds),
chains AS (SELECT doc_id, item_id, CAST(band AS BIGINT) AS band, min(qbeg) AS qbeg, max(qend) AS qend, CAST(count(*) AS BIGINT) AS n_seeds, max(qend - qbeg) AS anchor,
 CAST(least(sum(greatest(0, qend - greatest(qbeg, coalesce(qfar, 0)))), sum(greatest(0, rend - greatest(rbeg, coalesce(rfar, 0))))) AS BIGINT) AS w FROM ends GROUP BY doc_id, item_id, band)"""

#: Chains by counting the places that they cover one by one.
CHAINS_PLAIN = """seeds AS (SELECT *, CAST(floor((qbeg - rbeg) / 64.0) AS BIGINT) AS band FROM mems),
onq AS (SELECT doc_id, item_id, band, count(DISTINCT p) AS n FROM (SELECT doc_id, item_id, band, unnest(range(qbeg, qend)) AS p FROM seeds) GROUP BY ALL),
onr AS (SELECT doc_id, item_id, band, count(DISTINCT p) AS n FROM (SELECT doc_id, item_id, band, unnest(range(rbeg, rbeg + len)) AS p FROM seeds) GROUP BY ALL),
chains AS (SELECT s.doc_id, s.item_id, s.band, min(qbeg) AS qbeg, max(qend) AS qend, CAST(count(*) AS BIGINT) AS n_seeds, max(len) AS anchor, CAST(least(any_value(onq.n), any_value(onr.n)) AS BIGINT) AS w
 FROM seeds s JOIN onq USING (doc_id, item_id, band) JOIN onr USING (doc_id, item_id, band) GROUP BY s.doc_id, s.item_id, s.band)"""


def sql(name: str, tables: str, body: str, k: int = 0, parts: str = "", oracle: str = "", oracle_parts: str | None = None, fold: Callable[[matching.Found], tuple] | None = None, names: str = "") -> None:
    """Registers a query in SQL; ``k`` makes the view ``mems`` first. ``oracle`` and ``oracle_parts`` are the oracle's own form of it.

    ``fold`` gives the columns ``names`` of the matches of a read, where the reference is of bounded size.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if fold and (found := matching.per_read(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k, fold, names)) is not None:
            return found
        for t in tables.split():
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        if k:
            seeding.mem_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k).createOrReplaceTempView("mems")
        return spark.sql(spelled(f"WITH {parts} {body}" if parts else body, 0))

    QUERIES[name] = run
    before = parts if oracle_parts is None else oracle_parts
    own = oracle or body
    SQL[name] = spelled("WITH " + ",\n".join(x for x in (mems(k) if k else "", before) if x) + "\n" + own if k or before else own, 1)


def query(name: str, oracle: str = ""):
    """Registers a function (spark, sf_dir); ``oracle`` is its SQL, if SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle:
            SQL[name] = spelled(oracle, 1)
        return f

    return add


def _view(spark: SparkSession, sf_dir: str, k: int, parts: str, body: str) -> DataFrame:
    seeding.mem_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k).createOrReplaceTempView("mems")
    return spark.sql(f"WITH {parts} {body}")


# Seeding
for _k in (19, 10, 8):
    sql(f"mem_hits_k{_k}", "", "SELECT doc_id, item_id, qbeg, qend, rbeg, len FROM mems", k=_k)
sql("smem_intervals", "", "SELECT doc_id, qbeg, qend, s FROM smems", k=8, parts=SMEMS, oracle_parts=SMEMS_PLAIN, fold=matching.smems, names="qbeg, qend, s")
sql("smem_dedup", "", "SELECT doc_id, qbeg, qend, s FROM smems UNION SELECT doc_id, qbeg, qend, s FROM spans WHERE qend - qbeg >= 9", k=8, parts=SMEMS, oracle_parts=SMEMS_PLAIN, oracle="SELECT * FROM spans a WHERE qend - qbeg >= 9 OR NOT EXISTS (SELECT 1 FROM smems b WHERE b.doc_id = a.doc_id AND b.qbeg <= a.qbeg AND b.qend >= a.qend AND b.qend - b.qbeg > a.qend - a.qbeg)", fold=partial(matching.smems, least=9), names="qbeg, qend, s")
sql("reseed_intervals", "", "SELECT DISTINCT b.doc_id, b.qbeg, b.qend FROM bounds b JOIN smems m ON b.doc_id = m.doc_id AND m.s = 1 AND m.qend - m.qbeg >= 9 AND b.qbeg <= floor((m.qbeg + m.qend + 1) / 2.0) AND b.qend > floor((m.qbeg + m.qend + 1) / 2.0) WHERE b.prior IS NULL OR b.prior < b.qend", k=8, parts=SMEMS + """,
places AS (SELECT a.doc_id, a.qbeg, b.qend FROM (SELECT DISTINCT doc_id, qbeg FROM mems) a JOIN mems b ON a.doc_id = b.doc_id AND b.qbeg <= a.qbeg AND b.qend >= a.qbeg + 8),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, qbeg ORDER BY qend DESC) AS t FROM places),
bounds AS (SELECT doc_id, qbeg, qend, max(qend) OVER (PARTITION BY doc_id ORDER BY qbeg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM ranked WHERE t = 2)""", oracle_parts=SMEMS_PLAIN + """,
starts AS (SELECT DISTINCT doc_id, qbeg FROM mems),
second AS (SELECT s.doc_id, s.qbeg, (SELECT list_sort(list(b.qend), 'DESC')[2] FROM mems b WHERE b.doc_id = s.doc_id AND b.qbeg <= s.qbeg AND b.qend >= s.qbeg + 8) AS qend FROM starts s)""", oracle="SELECT DISTINCT b.doc_id, b.qbeg, b.qend FROM second b, smems m WHERE b.qend IS NOT NULL AND NOT EXISTS (SELECT 1 FROM second o WHERE o.doc_id = b.doc_id AND o.qbeg < b.qbeg AND o.qend >= b.qend) AND b.doc_id = m.doc_id AND m.s = 1 AND m.qend - m.qbeg >= 9 AND b.qbeg <= (m.qbeg + m.qend + 1) // 2 AND b.qend > (m.qbeg + m.qend + 1) // 2", fold=matching.reseeded, names="qbeg, qend")
sql("occ_cap_stride", "", "SELECT doc_id, qbeg, qend, item_id, rbeg FROM numbered WHERE (rn - 1) % step = 0 AND floor((rn - 1) / (step * 1.0)) < 2", k=8, parts="""counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id, qbeg, qend) AS s, row_number() OVER (PARTITION BY doc_id, qbeg, qend ORDER BY item_id, rbeg) AS rn FROM mems),
numbered AS (SELECT *, CASE WHEN s > 2 THEN CAST(floor(s / 2.0) AS BIGINT) ELSE 1 END AS step FROM counted)""", fold=matching.strided, names="qbeg, qend, item_id, rbeg")
sql("distinct_interval_resolve", "documents", "SELECT m.doc_id, m.qbeg, m.qend, r.places FROM (SELECT DISTINCT doc_id, qbeg, qend, seed FROM named) m JOIN (SELECT seed, CAST(count(DISTINCT concat(CAST(item_id AS VARCHAR(20)), ':', CAST(rbeg AS VARCHAR(20)))) AS BIGINT) AS places FROM named GROUP BY seed) r ON m.seed = r.seed", k=8, parts="named AS (SELECT m.*, substr(d.text, CAST(m.qbeg + 1 AS INT), CAST(m.len AS INT)) AS seed FROM mems m JOIN documents d ON m.doc_id = d.doc_id)")


def _resolved(spark: SparkSession, sf_dir: str, plain: Callable[[SparkSession, str], DataFrame] = QUERIES["distinct_interval_resolve"]) -> DataFrame:
    """A match's text is the reference's, so its places are counted among the reference's places that any read has, which are as many as the reference allows."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    at = ["item_id", "rbeg", "len"]
    if (found := matching.per_read(docs, items, 8, matching.places, ", ".join(at))) is None:
        return plain(spark, sf_dir)
    seed = F.substring("text", (F.col("rbeg") + 1).cast("int"), F.col("len").cast("int"))
    named = found.select(*at).distinct().join(items.select("item_id", "text"), "item_id").select(*at, seed.alias("seed"))
    counted = named.select(*at, F.count("*").over(Window.partitionBy("seed")).alias("places"))
    return matching.per_read(docs, items, 8, matching.intervals, f"qbeg, qend, {', '.join(at)}").join(counted, at).select("doc_id", "qbeg", "qend", "places")


QUERIES["distinct_interval_resolve"] = _resolved
sql("seed_order_global", "", "SELECT doc_id, item_id, qbeg, qend, rbeg, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, qbeg, item_id, rbeg) AS BIGINT) AS seed_ix FROM mems", k=10, oracle="SELECT a.doc_id, a.item_id, a.qbeg, a.qend, a.rbeg, CAST((SELECT count(*) FROM mems b WHERE b.doc_id = a.doc_id AND (-b.len, b.qbeg, b.item_id, b.rbeg) < (-a.len, a.qbeg, a.item_id, a.rbeg)) + 1 AS BIGINT) AS seed_ix FROM mems a", fold=partial(matching.seed_order, keys=("-n", "qbeg", "id", "rbeg")), names="item_id, qbeg, qend, rbeg, seed_ix")
sql("seed_order_local", "", "SELECT doc_id, item_id, qbeg, qend, rbeg, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY qbeg, len DESC, item_id, rbeg) AS BIGINT) AS seed_ix FROM mems", k=10, oracle="SELECT a.doc_id, a.item_id, a.qbeg, a.qend, a.rbeg, CAST((SELECT count(*) FROM mems b WHERE b.doc_id = a.doc_id AND (b.qbeg, -b.len, b.item_id, b.rbeg) < (a.qbeg, -a.len, a.item_id, a.rbeg)) + 1 AS BIGINT) AS seed_ix FROM mems a", fold=partial(matching.seed_order, keys=("qbeg", "-n", "id", "rbeg")), names="item_id, qbeg, qend, rbeg, seed_ix")
sql("seed_absorb_count", "", "SELECT a.doc_id, a.item_id, a.qbeg, a.qend, a.rbeg, CAST(count(b.qbeg) AS BIGINT) AS absorbed FROM ix a LEFT JOIN ix b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.qbeg >= a.qbeg AND b.qend <= a.qend AND b.rbeg >= a.rbeg AND b.rbeg + b.len <= a.rbeg + a.len AND (b.len < a.len OR (b.len = a.len AND b.ix > a.ix)) GROUP BY a.doc_id, a.item_id, a.qbeg, a.qend, a.rbeg", k=10, parts="ix AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY qbeg, item_id, rbeg, len) AS ix FROM mems)", oracle_parts="", oracle="SELECT a.doc_id, a.item_id, a.qbeg, a.qend, a.rbeg, CAST((SELECT count(*) FROM mems b WHERE b.doc_id = a.doc_id AND b.item_id = a.item_id AND b.qbeg BETWEEN a.qbeg AND a.qend AND b.qend <= a.qend AND b.rbeg BETWEEN a.rbeg AND a.rbeg + a.len AND b.rbeg + b.len <= a.rbeg + a.len AND (b.len < a.len OR (b.len = a.len AND (b.qbeg, b.rbeg) > (a.qbeg, a.rbeg)))) AS BIGINT) AS absorbed FROM mems a", fold=matching.absorbed, names="item_id, qbeg, qend, rbeg, absorbed")
sql("seed_prune_spec30", "", "SELECT doc_id, item_id, qbeg, qend, rbeg, len FROM (SELECT *, max(len) OVER (PARTITION BY doc_id) AS longest, count(*) OVER (PARTITION BY doc_id, qbeg, qend) AS s FROM mems) x WHERE longest < 12 OR len = longest OR len >= 11 OR (s = 1 AND len >= 10)", k=8)
sql("kmer_diagonal_votes", "", "SELECT doc_id, item_id, diag, votes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY votes DESC, diag) AS rn FROM (SELECT doc_id, item_id, qbeg - rbeg AS diag, CAST(sum(len - 7) AS BIGINT) AS votes FROM mems GROUP BY doc_id, item_id, qbeg - rbeg) v) x WHERE rn = 1 AND votes >= 3", k=8, fold=matching.diagonal_votes, names="item_id, diag, votes")


@query("round3_walk")
def _round3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeding.round_three(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 8, 20)


@query("kmer_index", "SELECT kmer, CAST(min(rpos) AS BIGINT) AS first_pos, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(i AS BIGINT) AS rpos, substr(text, CAST(i AS INT) + 1, 10) AS kmer FROM (SELECT text, unnest(range(0, length(text) - 9)) AS i FROM benchmark)) GROUP BY kmer")
def _kmer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeding.kmers(table(spark, sf_dir, "benchmark"), "item_id", "text", 10).groupBy("kmer").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))


@query("base_counts", "SELECT base, n, CAST(sum(n) OVER (ORDER BY base) - n AS BIGINT) AS before FROM (SELECT base, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(text, '')) AS base FROM benchmark) WHERE base <> '' GROUP BY base)")
def _base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the window runs over one row per distinct character
    return table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "")).alias("base")).where("base <> ''").groupBy("base").agg(F.count("*").alias("n")).selectExpr("base", "n", "sum(n) over (order by base) - n as before")


# Chains
sql("chain_weight", "", "SELECT doc_id, item_id, band, qbeg, qend, n_seeds, w FROM chains", k=8, parts=CHAINS, oracle_parts=CHAINS_PLAIN, fold=partial(matching.chain_columns, names=("id", "band", "qbeg", "qend", "n_seeds", "w")), names="item_id, band, qbeg, qend, n_seeds, w")
sql("min_chain_weight", "", "SELECT doc_id, item_id, band, w FROM chains WHERE w >= 12", k=8, parts=CHAINS, oracle_parts=CHAINS_PLAIN, fold=partial(matching.chain_columns, names=("id", "band", "w"), least=12), names="item_id, band, w")
sql("min_ext_len", "", "SELECT m.doc_id, m.item_id, m.qbeg, m.qend, m.rbeg FROM mems m JOIN chains c ON m.doc_id = c.doc_id AND m.item_id = c.item_id AND floor((m.qbeg - m.rbeg) / 64.0) = c.band WHERE c.anchor < 12 OR m.len >= 12", k=8, parts=CHAINS, oracle_parts=CHAINS_PLAIN, fold=matching.anchored, names="item_id, qbeg, qend, rbeg")
sql("chain_cap_topn", "", "SELECT doc_id, item_id, band, w, capped_w FROM (SELECT *, CAST(coalesce(max(CASE WHEN rn > 3 THEN w END) OVER (PARTITION BY doc_id), 0) AS BIGINT) AS capped_w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, item_id, band) AS rn FROM chains) x) y WHERE rn <= 3", k=8, parts=CHAINS, oracle_parts=CHAINS_PLAIN + ", lists AS (SELECT doc_id, list(struct_pack(v := -w, item_id := item_id, band := band) ORDER BY w DESC, item_id, band) AS l FROM chains GROUP BY doc_id)", oracle="SELECT doc_id, c.item_id AS item_id, c.band AS band, -c.v AS w, CAST(coalesce(-l[4].v, 0) AS BIGINT) AS capped_w FROM (SELECT doc_id, l, unnest(l[1:3]) AS c FROM lists)", fold=matching.top_chains, names="item_id, band, w, capped_w")
sql("chain_tie_frac", "", "SELECT doc_id, item_id, band, w FROM (SELECT *, max(w) OVER (PARTITION BY doc_id) AS best FROM chains) x WHERE w >= floor(0.95 * best)", k=8, parts=CHAINS, oracle_parts=CHAINS_PLAIN, fold=matching.near_best, names="item_id, band, w")
sql("capped_sub", "", "SELECT doc_id, CAST(max(CASE WHEN rn = 1 THEN w END) AS BIGINT) AS score, CAST(least(coalesce(max(CASE WHEN rn > 3 THEN w END), 0), max(CASE WHEN rn = 1 THEN w END) - 1) AS BIGINT) AS csub FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, item_id, band) AS rn FROM chains) x GROUP BY doc_id", k=8, parts=CHAINS, oracle_parts=CHAINS_PLAIN, fold=matching.capped_sub, names="score, csub")
sql("repeat_fraction", "documents", "SELECT d.doc_id, CAST(coalesce(sum(greatest(0, x.qend - greatest(x.qbeg, coalesce(x.far, 0)))), 0) AS BIGINT) AS covered, CAST(length(max(d.text)) AS BIGINT) AS total FROM documents d LEFT JOIN (SELECT doc_id, qbeg, qend, max(qend) OVER (PARTITION BY doc_id ORDER BY qbeg, qend ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM spans WHERE s >= 2) x ON d.doc_id = x.doc_id GROUP BY d.doc_id", k=8, parts=SMEMS, oracle_parts=SMEMS_PLAIN, oracle="SELECT d.doc_id, CAST(coalesce(any_value(x.n), 0) AS BIGINT) AS covered, CAST(length(any_value(d.text)) AS BIGINT) AS total FROM documents d LEFT JOIN (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(qbeg, qend)) AS p FROM spans WHERE s >= 2) GROUP BY doc_id) x ON d.doc_id = x.doc_id GROUP BY d.doc_id", fold=matching.repeat_fraction, names="covered, total")


@query("chain_filter")
def _chain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = partial(matching.filtered_chains, mask=regions.MASK, drop=regions.DROP, gap=regions.GAP, seed=1)
    if (found := matching.per_read(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 8, fold, "qbeg, qend, w, kept")) is not None:
        return found
    return regions.filtered_chains(_view(spark, sf_dir, 8, CHAINS, "SELECT doc_id, qbeg, qend, w FROM chains"), seed=1)


# Regions
def _regions(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return _view(spark, sf_dir, k, "r AS (SELECT *, len AS score FROM mems)", "SELECT doc_id, item_id, qbeg, qend, rbeg, score FROM r")


@query("primary_mark")
def _primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = partial(matching.marked_primary, mask=regions.MASK, near=7)
    if (found := matching.per_read(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10, fold, "item_id, qbeg, qend, score, secondary, sub, sub_n")) is not None:
        return found
    return regions.marked_primary(_regions(spark, sf_dir))


sql("region_rank", "", "SELECT doc_id, item_id, qbeg, qend, len AS score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, rbeg, qbeg, item_id) AS BIGINT) AS rank_ix FROM mems", k=10, oracle="SELECT a.doc_id, a.item_id, a.qbeg, a.qend, a.len AS score, CAST((SELECT count(*) FROM mems b WHERE b.doc_id = a.doc_id AND (-b.len, b.rbeg, b.qbeg, b.item_id) < (-a.len, a.rbeg, a.qbeg, a.item_id)) + 1 AS BIGINT) AS rank_ix FROM mems a", fold=matching.region_rank, names="item_id, qbeg, qend, score, rank_ix")
sql("region_emit_filter", "", "SELECT doc_id, item_id, qbeg, qend, len AS score FROM mems WHERE len >= 12", k=10)
sql("region_dedup", "", "SELECT a.doc_id, a.item_id, a.qbeg, a.qend, a.rbeg FROM mems a LEFT ANTI JOIN mems b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND (b.len > a.len OR (b.len = a.len AND (b.rbeg > a.rbeg OR (b.rbeg = a.rbeg AND b.qbeg > a.qbeg)))) AND least(a.qend, b.qend) - greatest(a.qbeg, b.qbeg) > 0.7 * least(a.len, b.len) AND least(a.rbeg + a.len, b.rbeg + b.len) - greatest(a.rbeg, b.rbeg) > 0.7 * least(a.len, b.len)", k=8, oracle="SELECT a.doc_id, a.item_id, a.qbeg, a.qend, a.rbeg FROM mems a WHERE NOT EXISTS (SELECT 1 FROM mems b WHERE b.doc_id = a.doc_id AND b.item_id = a.item_id AND (b.len, b.rbeg, b.qbeg) > (a.len, a.rbeg, a.qbeg) AND 10 * (least(a.qend, b.qend) - greatest(a.qbeg, b.qbeg)) > 7 * least(a.len, b.len) AND 10 * (least(a.rbeg + a.len, b.rbeg + b.len) - greatest(a.rbeg, b.rbeg)) > 7 * least(a.len, b.len))", fold=matching.deduped, names="item_id, qbeg, qend, rbeg")


def _seeded(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Every document with a seed: its id, whole text q, and all its seeds with the whole text t of each one's item."""
    seeds = seeding.mem_hits(docs, items, k).join(items.select("item_id", F.col("text").alias("t")), "item_id")
    seeds = seeds.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "qbeg", "rbeg", "len", "t")).alias("seeds"))
    return seeds.join(docs.select("doc_id", F.col("text").alias("q")), "doc_id").select("doc_id", "q", "seeds")


def _local(q: str, seeds: list) -> list[tuple]:
    """Each item that has a seed in the text, whole text against whole text."""
    return [(i, *kernels.local_score(q, t)) for i, t in {s["item_id"]: s["t"] for s in seeds}.items()]


def _extensions(q: str, seeds: list) -> list[tuple]:
    """Each seed, extended both ways."""
    every = ((s, kernels.extended_both(q, s["t"], s["qbeg"], s["rbeg"], s["len"])) for s in seeds)
    return [(s["item_id"], s["qbeg"], s["rbeg"], s["len"], score, qb, qe - qb, rb, re_ - rb) for s, (score, qb, qe, rb, re_) in every]


def _cigars(q: str, seeds: list) -> list[tuple]:
    """Each different region that a seed extends to, aligned from end to end."""
    found = {(s["item_id"], *kernels.extended_both(q, s["t"], s["qbeg"], s["rbeg"], s["len"])[1:]): s["t"] for s in seeds}
    return [(i, qb, qe, rb, re_, *kernels.global_cigar(q[qb:qe], t[rb:re_])) for (i, qb, qe, rb, re_), t in found.items()]


def seed_kernel(docs: DataFrame, items: DataFrame, f: Callable[[str, list], list[tuple]], schema: str, k: int = 10) -> DataFrame:
    """The rows of ``f(text, seeds)`` of every document with a seed, after its id."""
    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]

    def batch(parts):
        for p in parts:
            for d, q, seeds in zip(p["doc_id"], p["q"], p["seeds"], strict=True):
                yield pd.DataFrame([(d, *row) for row in f(q, seeds)], columns=names)

    return _seeded(docs, items, k).mapInPandas(batch, f"doc_id long, {schema}")


def _kernel(name: str, f: Callable[[str, list], list[tuple]], schema: str, fold: Callable[[DataFrame], Callable[[matching.Found], tuple] | None]) -> None:
    """Registers ``f``; ``fold(items)`` is the same over all seeds of a batch, where the items are of bounded size."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
        found = matching.per_read(docs, items, 10, of, schema) if (of := fold(items)) else None
        return seed_kernel(docs, items, f, schema) if found is None else found

    QUERIES[name] = run


def _local_fold(items: DataFrame) -> Callable[[matching.Found], tuple] | None:
    short = matching.matcher(items, kernels.MISMATCH // kernels.MATCH + 1)
    return partial(matching.local, short=short) if short else None


_kernel("local_sw", _local, "item_id long, score long, t_end long, q_end long", _local_fold)
_kernel("extend_score", _extensions, "item_id long, qbeg long, rbeg long, len long, score long, q_start long, q_taken long, t_start long, t_taken long", lambda items: matching.extensions)
_kernel("global_cigar", _cigars, "item_id long, qbeg long, qend long, rbeg long, rend long, cigar string, nm long, score long", lambda items: matching.cigars)

# Documents as reads of a reference that the benchmark makes
#: Reads that a document is cut into, and the letters that stand for bases.
_READ, _LETTERS = 120, "abcdefghijklmnopqrstuvwxyz"


def _bases(text: Column) -> Column:
    """Text in four letters; signs and blanks go."""
    return F.regexp_replace(F.translate(F.lower(text), _LETTERS, ("ACGT" * 7)[: len(_LETTERS)]), "[^ACGT]", "")


def text_index(items: DataFrame, k: int = 19) -> index.Index:
    return index.build(items.select(F.lit("benchmark").alias("path"), F.col("item_id").alias("ix"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("name"), F.lit("").alias("comment"), _bases(F.col("text")).alias("seq")), k)


def text_reads(docs: DataFrame) -> DataFrame:
    """Each document's bases, cut into reads one after another; read_id is the document's id times 2^20 and the read's number."""
    small = str.maketrans(dict(zip(_LETTERS, "ACGT" * 7)))
    table, rest = bytes(ord(chr(i).translate(small)) for i in range(128)) + bytes(128), bytes(set(range(256)) - set(_LETTERS.encode()))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            # the same letters as of _bases: what is no letter after lower() goes
            seqs = [t.lower().encode("ascii", "ignore").translate(table, rest).decode() for t in p.column(1).to_pylist()]
            row, n = [], []
            for i, s in enumerate(seqs):
                row += [i] * -(-len(s) // _READ)
                n += range(-(-len(s) // _READ))
            cut = [seqs[i][k * _READ : (k + 1) * _READ] for i, k in zip(row, n, strict=True)]
            yield pa.RecordBatch.from_arrays([p.column(0).take(pa.array(row, pa.int64())), pa.array(n, pa.int32()), pa.array(cut, pa.string())], names=["doc_id", "n", "seq"])

    reads = docs.where("text is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n int, seq string")
    key = F.col("doc_id") * (1 << 20) + F.col("n")
    return reads.select(key.alias("read_id"), key.alias("pair_id"), F.lit(0).alias("mate"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("."), F.col("n").cast("string")).alias("name"), F.lit("").alias("comment"), "seq", F.lit(None).cast("string").alias("qual"))


@query("align_seeds")
def _align_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three rounds of seeds of every read, at their places on both strands."""
    return flow.seeds_of(text_reads(table(spark, sf_dir, "documents")), text_index(table(spark, sf_dir, "benchmark")))


@query("align_sam")
def _align_sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SAM lines of every read, single-end."""
    return flow.align(text_reads(table(spark, sf_dir, "documents")), text_index(table(spark, sf_dir, "benchmark")))


@query("align_pairs_sam")
def _align_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SAM lines of pairs: every two reads of a document in a row, the second one turned around."""
    reads = text_reads(table(spark, sf_dir, "documents")).withColumn("pair_id", F.floor(F.col("read_id") / 2)).withColumn("mate", (F.col("read_id") % 2 + 1).cast("int"))
    both = reads.join(reads.groupBy("pair_id").count().where("count = 2").select("pair_id"), "pair_id")
    turned = F.when(F.col("mate") == 2, sequences.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return flow.align(both.withColumn("seq", turned).withColumn("name", F.concat(F.lit("p"), F.col("pair_id").cast("string"))), text_index(table(spark, sf_dir, "benchmark")))


# Scores of numbers
_MAPQ_ARGS = "CAST(50 + l_partkey % 100 AS DOUBLE) AS span, CAST(40 + (l_orderkey + l_partkey) % 61 AS DOUBLE) AS score, CAST(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 20 + l_suppkey % 60 END AS DOUBLE) AS sub, CAST(l_linenumber % 4 AS DOUBLE) AS sub_n, l_discount AS frac_rep"


@query("mapq_se", f"""WITH a AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {_MAPQ_ARGS} FROM lineitem),
b AS (SELECT *, CASE WHEN sub > 0 THEN sub ELSE 19 END AS rival, 3 / ln(span) * pow(1 - (span - score) / 5 / span, 2) AS weight FROM a),
c AS (SELECT *, trunc(6.02 * (score - rival) * weight * weight + 0.499) - CASE WHEN sub_n > 0 THEN trunc(4.343 * ln(sub_n + 1.0) + 0.499) ELSE 0 END AS q FROM b)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN rival >= score THEN 0 ELSE trunc(least(greatest(q, 0), 60) * (1 - frac_rep) + 0.499) END AS BIGINT) AS mapq FROM c""")
def _mapq(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "CAST(l_linenumber AS BIGINT) AS l_linenumber", *re.split(r", (?=CAST|l_)", _MAPQ_ARGS))
    zero = F.lit(0.0)
    return a.select("l_orderkey", "l_linenumber", sequences.single_mapq(F.col("score"), F.col("sub"), zero, F.col("span"), F.col("span"), F.col("sub_n"), F.col("frac_rep")).alias("mapq"))


sql("orientation", "lineitem", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN (b1 >= 1000) = (b2 >= 1000) THEN (CASE WHEN p2 > b1 THEN 0 ELSE 3 END) ELSE (CASE WHEN p2 > b1 THEN 1 ELSE 2 END) END AS dir, abs(p2 - b1) AS dist FROM p", parts="""b AS (SELECT l_orderkey, l_linenumber, l_partkey % 2000 AS b1, (l_partkey * 7 + l_suppkey * 13) % 2000 AS b2 FROM lineitem),
p AS (SELECT *, CASE WHEN (b1 >= 1000) = (b2 >= 1000) THEN b2 ELSE 1999 - b2 END AS p2 FROM b)""")
sql("flag_compose", "lineitem", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(1 + CASE WHEN l_returnflag = 'A' THEN 2 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 16 ELSE 0 END + CASE WHEN l_linenumber = 1 THEN 64 ELSE 128 END + CASE WHEN l_linenumber > 3 THEN 256 ELSE 0 END + CASE WHEN l_linenumber > 5 THEN 2048 ELSE 0 END AS BIGINT) AS flag FROM lineitem")
sql("qcfail_propagate", "lineitem", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(max(CASE WHEN l_quantity >= 49 THEN 512 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS BIGINT) AS qcfail FROM lineitem", oracle="SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(CASE WHEN l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) THEN 512 ELSE 0 END AS BIGINT) AS qcfail FROM lineitem")
sql("supp_rep_hard_cap", "lineitem", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(CASE WHEN l_linenumber > 1 AND l_quantity >= 40 THEN 0 ELSE l_suppkey % 61 END AS BIGINT) AS mapq FROM lineitem")
#: Insert sizes by orientation: quartiles by rank, trimmed mean and deviation, and the window of proper pairs.
sql("insert_size_stats", "lineitem", """SELECT l_returnflag, n, p25, p50, p75, mean, std, failed, CAST(floor(greatest(1, least(p25 - 3 * (p75 - p25) + 0.499, mean - 4 * std + 0.499))) AS BIGINT) AS low, CAST(floor(greatest(p75 + 3 * (p75 - p25) + 0.499, mean + 4 * std + 0.499)) AS BIGINT) AS high
FROM (SELECT q.l_returnflag, max(q.n) AS n, max(q.p25) AS p25, max(q.p50) AS p50, max(q.p75) AS p75, round(CAST(sum(h.v * h.c) AS DOUBLE) / sum(h.c), 6) AS mean, round(sqrt(greatest(0, CAST(sum(h.v * h.v * h.c) AS DOUBLE) / sum(h.c) - pow(CAST(sum(h.v * h.c) AS DOUBLE) / sum(h.c), 2))), 6) AS std, max(q.n) < 10 OR max(q.n) < 0.05 * max(q.most) AS failed
FROM quart q JOIN hist h ON q.l_returnflag = h.l_returnflag WHERE h.v BETWEEN q.p25 - 2 * (q.p75 - q.p25) AND q.p75 + 2 * (q.p75 - q.p25) GROUP BY q.l_returnflag) x""", parts="""hist AS (SELECT l_returnflag, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS v, count(*) AS c FROM lineitem GROUP BY 1, 2),
cum AS (SELECT *, CAST(sum(c) OVER (PARTITION BY l_returnflag ORDER BY v) AS BIGINT) AS upto, CAST(sum(c) OVER (PARTITION BY l_returnflag) AS BIGINT) AS n FROM hist),
quart AS (SELECT l_returnflag, max(n) AS n, max(max(n)) OVER () AS most, min(CASE WHEN upto > floor(0.25 * n + 0.499) THEN v END) AS p25, min(CASE WHEN upto > floor(0.5 * n + 0.499) THEN v END) AS p50, min(CASE WHEN upto > floor(0.75 * n + 0.499) THEN v END) AS p75 FROM cum GROUP BY l_returnflag)""",
    oracle_parts="""src AS (SELECT l_returnflag, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS v FROM lineitem),
lists AS (SELECT l_returnflag, list_sort(list(v)) AS l FROM src GROUP BY 1),
quart AS (SELECT l_returnflag, len(l) AS n, l[1 + CAST(trunc(0.25 * len(l) + 0.499) AS BIGINT)] AS p25, l[1 + CAST(trunc(0.5 * len(l) + 0.499) AS BIGINT)] AS p50, l[1 + CAST(trunc(0.75 * len(l) + 0.499) AS BIGINT)] AS p75 FROM lists),
inner_ AS (SELECT q.l_returnflag, avg(v) AS m, stddev_pop(v) AS d FROM src s JOIN quart q ON s.l_returnflag = q.l_returnflag AND v BETWEEN p25 - 2 * (p75 - p25) AND p75 + 2 * (p75 - p25) GROUP BY 1)""",
    oracle="SELECT q.l_returnflag, CAST(n AS BIGINT) AS n, p25, p50, p75, round(m, 6) AS mean, round(d, 6) AS std, n < 10 OR n < 0.05 * (SELECT max(n) FROM quart) AS failed, CAST(trunc(greatest(1, least(p25 - 3 * (p75 - p25) + 0.499, m - 4 * d + 0.499))) AS BIGINT) AS low, CAST(trunc(greatest(p75 + 3 * (p75 - p25) + 0.499, m + 4 * d + 0.499)) AS BIGINT) AS high FROM quart q JOIN inner_ i USING (l_returnflag)")

# Sequences and names


@query("dedup_exact_reads", "SELECT d.doc_id, f.first_id, f.copies FROM documents d JOIN (SELECT text, CAST(min(doc_id) AS BIGINT) AS first_id, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY text) f ON d.text = f.text")
def _dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies by two 64-bit digests and the length of the text; texts aren't shuffled, and copies are counted before the join."""
    name = ("h1", "h2", "n")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.length("text").alias("n")).where("n is not null")
    first = docs.groupBy(*name).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return docs.join(first, list(name)).select("doc_id", "first_id", "copies")


sql("name_trim", "customer", "SELECT c_custkey, DIGIT_TRIM{n} AS trimmed FROM (SELECT c_custkey, concat(c_name, '/', CAST(c_custkey % 3 AS VARCHAR(9))) AS n FROM customer) x")
sql("meth_projection", "benchmark", "SELECT item_id, translate(text, 'Cc', 'TT') AS r1, translate(text, 'Gg', 'AA') AS r2 FROM benchmark")
sql("meth_index", "benchmark", "SELECT item_id, 'r' AS chain, translate(text, 'acgtG', 'ACATA') AS seq FROM benchmark UNION ALL SELECT item_id, 'f' AS chain, translate(text, 'acgtC', 'ATGTT') AS seq FROM benchmark")
sql("longest_run_qc", "", "SELECT doc_id, CAST(max(len) AS BIGINT) AS longest, CAST(sum(len) AS BIGINT) AS total, CASE WHEN max(len) < 0.44 * sum(len) THEN 512 ELSE 0 END AS fail FROM mems GROUP BY doc_id", k=10)
sql("smart_pairing", "conversations", "SELECT conv_id, turn, CAST((rn - 1) % 2 AS BIGINT) AS mate, CASE WHEN rn % 2 = 1 AND rn = n THEN 'single' ELSE 'paired' END AS kind FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) x", oracle="SELECT conv_id, turn, CAST(before % 2 AS BIGINT) AS mate, CASE WHEN before % 2 = 0 AND after = 0 THEN 'single' ELSE 'paired' END AS kind FROM (SELECT conv_id, turn, (SELECT count(*) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn) AS before, (SELECT count(*) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn > a.turn) AS after FROM conversations a)")


@query("revcomp", "SELECT doc_id, reverse(translate(text, 'ACGTacgt', 'TGCAtgca')) AS rc FROM documents WHERE length(text) > 0")
def _revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", sequences.reverse_complement(F.col("text")).alias("rc"))


@query("encode", "SELECT item_id, regexp_replace(translate(text, 'ACGTacgt', '01230123'), '[^0-3]', '4', 'g') AS code FROM benchmark")
def _encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", sequences.encoded(F.col("text")).alias("code"))


sql("xm_calls", "benchmark", """SELECT item_id, pos, CASE WHEN c <> 'C' THEN '.' WHEN c1 IS NULL OR c1 NOT IN ('A', 'C', 'G', 'T') THEN 'U' WHEN c1 = 'G' THEN 'Z' WHEN c2 IS NULL OR c2 NOT IN ('A', 'C', 'G', 'T') THEN 'U' WHEN c2 = 'G' THEN 'X' ELSE 'H' END AS call
FROM (SELECT item_id, CAST(pos AS BIGINT) AS pos, c, lead(c, 1) OVER (PARTITION BY item_id ORDER BY pos) AS c1, lead(c, 2) OVER (PARTITION BY item_id ORDER BY pos) AS c2 FROM bases) x WHERE c = 'C'""", parts="bases AS (SELECT item_id, pos, translate(substr(text, CAST(pos AS INT), 1), 'acgt', 'ACGT') AS c FROM (SELECT item_id, text, explode(sequence(1, length(text))) AS pos FROM benchmark) y)")
SQL["xm_calls"] = SQL["xm_calls"].replace("explode(sequence(1, length(text)))", "unnest(range(1, length(text) + 1))")

# Joins on ranges
_PAIR = "ev AS (SELECT event_id, user_id, event_type, value, SECONDS{ts} AS t FROM events)"
_PAIRED = "SELECT a.user_id, a.event_id AS e1, b.event_id AS e2, b.t - a.t AS dist, CAST(floor(a.value + b.value) AS BIGINT) AS q FROM (SELECT *, CAST(floor(t / 3600.0) AS BIGINT) AS slot FROM ev WHERE event_type = 'click') a JOIN (SELECT *, explode(array(CAST(floor(t / 3600.0) AS BIGINT), CAST(floor(t / 3600.0) AS BIGINT) - 1)) AS slot FROM ev WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.slot = b.slot AND b.t - a.t BETWEEN 60 AND 3600"
sql("pair_range_join", "events", _PAIRED, parts=_PAIR)
sql("pair_top1", "events", f"SELECT user_id, e1, e2, q, sub, n_sub FROM (SELECT *, CAST(coalesce(lead(q) OVER (PARTITION BY e1 ORDER BY q DESC, e2), 0) AS BIGINT) AS sub, CAST(sum(CASE WHEN top - q <= 7 THEN 1 ELSE 0 END) OVER (PARTITION BY e1) - 1 AS BIGINT) AS n_sub, row_number() OVER (PARTITION BY e1 ORDER BY q DESC, e2) AS rn FROM (SELECT *, max(q) OVER (PARTITION BY e1) AS top FROM ({_PAIRED}) p) p2) x WHERE rn = 1", parts=_PAIR)
for _name in ("pair_range_join", "pair_top1"):  # the oracle joins on the range alone
    SQL[_name] = SQL[_name].replace("SELECT *, explode(array(CAST(floor(t / 3600.0) AS BIGINT), CAST(floor(t / 3600.0) AS BIGINT) - 1)) AS slot FROM ev", "SELECT * FROM ev").replace(" AND a.slot = b.slot", "")
sql("rescue_skip_anti", "events", "SELECT a.event_id, a.user_id, a.t FROM (SELECT * FROM ev WHERE event_type = 'click') a LEFT ANTI JOIN (SELECT *, explode(sequence(CAST(floor((t - 1800) / 3600.0) AS BIGINT), CAST(floor((t + 1800) / 3600.0) AS BIGINT))) AS slot FROM ev WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND CAST(floor(a.t / 3600.0) AS BIGINT) = b.slot AND b.t BETWEEN a.t - 1800 AND a.t + 1800", parts=_PAIR, oracle="SELECT a.event_id, a.user_id, a.t FROM ev a WHERE a.event_type = 'click' AND NOT EXISTS (SELECT 1 FROM ev b WHERE a.user_id = b.user_id AND b.event_type = 'purchase' AND b.t BETWEEN a.t - 1800 AND a.t + 1800)")
sql("rescue_anchor_topm", "lineitem", "SELECT l_orderkey, l_linenumber, anchor_ix FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS anchor_ix, l_quantity, max(l_quantity) OVER (PARTITION BY l_orderkey) AS best FROM lineitem) x WHERE l_quantity >= best - 17 AND anchor_ix <= 3")
sql("pos_to_bucket_asof", "events orders", "SELECT event_id, coalesce(contig, -1) AS contig FROM (SELECT event_id, kind, max(CASE WHEN kind = 0 THEN k END) OVER (PARTITION BY who ORDER BY t, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS contig FROM (SELECT user_id AS who, SECONDS{ts} % 86400 AS t, 1 AS kind, event_id, CAST(NULL AS BIGINT) AS k FROM events UNION ALL SELECT o_custkey AS who, (o_orderkey * 37) % 86400 AS t, 0 AS kind, CAST(NULL AS BIGINT) AS event_id, (o_orderkey * 37) % 86400 AS k FROM orders) u) x WHERE kind = 1")
sql("interval_overlap_sum", "lineitem", "SELECT a.l_orderkey, CAST(a.l_linenumber AS BIGINT) AS l_linenumber, CAST(sum(greatest(0, least(a.e, b.e) - greatest(a.s, b.s))) AS BIGINT) AS overlap FROM iv a JOIN iv b ON a.l_orderkey = b.l_orderkey AND a.s < b.e AND b.s < a.e GROUP BY a.l_orderkey, a.l_linenumber", parts="iv AS (SELECT l_orderkey, l_linenumber, DAYS{l_shipdate} AS s, DAYS{l_shipdate} + CAST(l_quantity AS BIGINT) AS e FROM lineitem)")
sql("bed_merge_islands", "lineitem", "SELECT l_suppkey, isle, min(s) AS s, max(e) AS e, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, CAST(sum(CASE WHEN far IS NULL OR s > far THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY s, e, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS isle FROM (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM iv) x) y GROUP BY l_suppkey, isle", parts="iv AS (SELECT l_suppkey, l_orderkey, l_linenumber, DAYS{l_shipdate} AS s, DAYS{l_shipdate} + CAST(l_quantity AS BIGINT) AS e FROM lineitem)")
sql("bed_exclude_anti", "orders lineitem", "SELECT a.o_orderkey, a.s FROM (SELECT o_orderkey, DAYS{o_orderdate} AS s FROM orders) a LEFT ANTI JOIN (SELECT l_orderkey, DAYS{l_shipdate} AS s, DAYS{l_shipdate} + CAST(l_quantity AS BIGINT) AS e FROM lineitem) b ON a.o_orderkey = b.l_orderkey AND b.s <= a.s + 60 AND b.e > a.s")
SQL["bed_exclude_anti"] = SQL["bed_exclude_anti"].replace("LEFT ANTI JOIN", "ANTI JOIN")
sql("lift_interval", "part", "SELECT brand, CAST(sum(CASE WHEN op = 'M' THEN least(qe, 60) - greatest(qs, 10) ELSE 0 END) AS BIGINT) AS aligned, CAST(sum(CASE WHEN op = 'I' THEN least(qe, 60) - greatest(qs, 10) ELSE 0 END) AS BIGINT) AS inserted, CAST(max(abs(diag)) AS BIGINT) AS max_diag FROM steps WHERE qs < 60 AND qe > 10 GROUP BY brand", parts="""ops AS (SELECT p_brand AS brand, p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN 'I' WHEN p_size % 5 = 1 THEN 'D' ELSE 'M' END AS op, CAST(p_size AS BIGINT) AS len FROM part),
steps AS (SELECT brand, op, len, (sum(CASE WHEN op <> 'D' THEN len ELSE 0 END) OVER w) - CASE WHEN op <> 'D' THEN len ELSE 0 END AS qs, sum(CASE WHEN op <> 'D' THEN len ELSE 0 END) OVER w AS qe, sum(CASE WHEN op = 'I' THEN len WHEN op = 'D' THEN -len ELSE 0 END) OVER w AS diag FROM ops WINDOW w AS (PARTITION BY brand ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
sql("alt_shadow_list", "lineitem", "SELECT l_orderkey, CAST(count(*) AS BIGINT) AS hn, CASE WHEN count(*) <= 5 THEN concat_ws('', transform(array_sort(collect_list(struct(l_linenumber, xa))), x -> x.xa)) END AS xa FROM hits WHERE l_quantity >= 0.8 * best GROUP BY l_orderkey", parts="hits AS (SELECT l_orderkey, l_linenumber, l_quantity, max(l_quantity) OVER (PARTITION BY l_orderkey) AS best, concat(CAST(l_partkey AS VARCHAR(12)), ',', CAST(l_suppkey AS VARCHAR(12)), ';') AS xa FROM lineitem)", oracle_parts="", oracle="SELECT l_orderkey, CAST(count(*) AS BIGINT) AS hn, CASE WHEN count(*) <= 5 THEN string_agg(concat(l_partkey, ',', l_suppkey, ';'), '' ORDER BY l_linenumber, concat(l_partkey, ',', l_suppkey, ';')) END AS xa FROM lineitem a WHERE l_quantity >= 0.8 * (SELECT max(l_quantity) FROM lineitem b WHERE b.l_orderkey = a.l_orderkey) GROUP BY l_orderkey")


#: Of each distance in the window: what it adds to a pair's score.
_FROM, _MODEL = 60, pairs.Insert(60, 3600, False, 1800.0, 600.0)
_TERMS = [0.721 * math.log(2 * math.erfc(abs(d - _MODEL.mean) / _MODEL.std * math.sqrt(0.5))) for d in range(_FROM, _MODEL.high + 1)]


@query("pair_erfc_score")
def _erfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances are whole and bounded by the window, so the normal tail is a constant table and no Python runs per row."""
    terms = F.lit(_TERMS)
    found = QUERIES["pair_range_join"](spark, sf_dir)
    score = F.greatest(F.lit(0), (F.col("q") + F.get(terms, (F.col("dist") - _FROM).cast("int")) + 0.499).cast("long"))
    return found.select("user_id", "e1", "e2", score.alias("score"))


SQL["pair_erfc_score"] = f"SELECT user_id, e1, e2, CAST(greatest(0, trunc(q + ([{', '.join(map(repr, _TERMS))}])[dist - {_FROM - 1}] + 0.499)) AS BIGINT) AS score FROM ({SQL['pair_range_join']}) p"


sql("sam_text", "", "SELECT doc_id, concat('d', CAST(doc_id AS VARCHAR(12)), chr(9), '0', chr(9), 'b', CAST(item_id AS VARCHAR(12)), chr(9), CAST(rbeg + 1 AS VARCHAR(12)), chr(9), '60', chr(9), CASE WHEN qbeg > 0 THEN concat(CAST(qbeg AS VARCHAR(12)), 'S') ELSE '' END, CAST(len AS VARCHAR(12)), 'M', chr(9), '*', chr(9), '0', chr(9), '0', chr(9), '*', chr(9), '*', chr(9), 'NM:i:0', chr(9), 'AS:i:', CAST(len AS VARCHAR(12))) AS line FROM mems", k=19)
