"""Exact seeds between texts and a reference collection: a k-mer join and islands on diagonals."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import matching

#: Characters of a piece that k-mers are cut from; cutting from whole texts would count characters anew for each.
PIECE = 256


def kmers(texts: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, pos, kmer) of every place of every text, from 0. Texts shorter than k, and null, have none."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.char_length(text) - k) / PIECE).cast("int")), lambda c: F.substring(F.col(text), c * PIECE + 1, F.lit(PIECE + k - 1)))
    pieces = texts.where(F.char_length(text) >= k).select(key, F.posexplode(cut).alias("__c", "__t"))
    inner = F.transform(F.sequence(F.lit(0), F.char_length("__t") - k), lambda i: F.substring(F.col("__t"), i + 1, F.lit(k)))
    return pieces.select(key, "__c", F.posexplode(inner).alias("__i", "kmer")).select(key, (F.col("__c") * PIECE + F.col("__i")).cast("long").alias("pos"), "kmer")


def mem_hits(reads: DataFrame, refs: DataFrame, k: int, read_key: str = "doc_id", ref_key: str = "item_id", text: str = "text") -> DataFrame:
    """Maximal exact matches of length k or more: read, ref, qbeg, qend, rbeg, len (0-based, end exclusive).

    A reference of bounded size goes to where reads are read; a larger one is joined.
    """
    found = matching.per_read(reads, refs, k, matching.mems, f"{ref_key}, qbeg, qend, rbeg, len", read_key, ref_key, text)
    return joined_hits(reads, refs, k, read_key, ref_key, text) if found is None else found


def joined_hits(reads: DataFrame, refs: DataFrame, k: int, read_key: str = "doc_id", ref_key: str = "item_id", text: str = "text") -> DataFrame:
    """``mem_hits`` of a reference of any size.

    A match of length L shares L-k+1 k-mers in a row on one diagonal, so islands
    on (read, ref, diagonal) are the maximal matches. The reference side is
    broadcast only if the planner finds it small; k-mers that many reads share
    are then no hot key, and beyond that adaptive execution splits them.
    """
    q = kmers(reads, read_key, text, k).withColumnRenamed("pos", "qpos")
    r = kmers(refs, ref_key, text, k).withColumnRenamed("pos", "rpos")
    hits = q.join(r, "kmer").withColumn("diag", F.col("qpos") - F.col("rpos"))
    order = Window.partitionBy(read_key, ref_key, "diag").orderBy("qpos")
    islands = hits.withColumn("isle", F.col("qpos") - F.row_number().over(order))
    found = islands.groupBy(read_key, ref_key, "diag", "isle").agg(F.min("qpos").alias("qbeg"), (F.max("qpos") + k).alias("qend"), F.min("rpos").alias("rbeg"), (F.count("*") + k - 1).alias("len"))
    return found.select(read_key, ref_key, "qbeg", "qend", "rbeg", "len")


def round_three(reads: DataFrame, refs: DataFrame, k: int, most: int, read_key: str = "doc_id", text: str = "text") -> DataFrame:
    """(read, qbeg, qend, hits): the forward walk that emits at the first end with fewer than ``most`` places.

    From a place, the walk tries ends from k+1 characters on until one has fewer
    than ``most`` places; it emits this match if it has any place, and restarts
    after it either way. A reference of bounded size goes to where reads are
    read; for a larger one, where the k+1-mer has ``most`` places or more, the
    maximal matches over it tell the end: it is one behind the ``most``-th
    farthest of theirs. Reads are walked where their counts have been gathered,
    one read's places at a time.
    """
    found = matching.per_read(reads, refs, k + 1, partial(matching.walked, most=most), "qbeg, qend, hits", read_key, refs.columns[0], text)
    if found is not None:
        return found
    grams = kmers(refs, refs.columns[0], text, k + 1).groupBy("kmer").agg(F.count("*").alias("n"))
    spots = kmers(reads, read_key, text, k + 1).join(grams, "kmer").select(read_key, "pos", "n")
    short = spots.where(F.col("n") < most).select(read_key, "pos", (F.col("pos") + k + 1).alias("end"), "n")
    hot = spots.where(F.col("n") >= most).select(read_key, "pos")
    mems = joined_hits(reads.join(hot.select(read_key).distinct(), read_key, "left_semi"), refs, k + 1, read_key, refs.columns[0], text)
    over = mems.select(read_key, "qend", F.explode(F.sequence("qbeg", F.col("qend") - k - 1)).alias("pos")).join(hot, [read_key, "pos"])
    ends = over.groupBy(read_key, "pos", "qend").agg(F.count("*").alias("c"))
    farther = F.sum("c").over(Window.partitionBy(read_key, "pos").orderBy(F.desc("qend")))
    ends = ends.withColumn("upto", farther).where(F.col("upto") >= most).groupBy(read_key, "pos").agg(F.max(F.struct("qend", (F.col("upto") - F.col("c")).alias("n"))).alias("e"))
    every = short.unionByName(ends.select(read_key, "pos", (F.col("e.qend") + 1).alias("end"), F.col("e.n").alias("n")))
    starts = every.groupBy(read_key).agg(F.array_sort(F.collect_list(F.struct("pos", "end", "n"))).alias("s"))
    zero = F.struct(F.lit(0).cast("long").alias("next"), F.array().cast("array<struct<pos:bigint,end:bigint,n:bigint>>").alias("out"))

    def step(z, x):
        # without any place, the walk goes on by k+1 characters
        at = z["next"] + F.greatest(F.lit(0), F.ceil((x["pos"] - z["next"]) / (k + 1))) * (k + 1)
        hit = at == x["pos"]
        return F.struct(F.when(hit, x["end"]).otherwise(at).alias("next"), F.when(hit & (x["n"] > 0), F.concat(z["out"], F.array(x))).otherwise(z["out"]).alias("out"))

    walked = starts.select(read_key, F.explode(F.aggregate("s", zero, step)["out"]).alias("w"))
    return walked.select(read_key, F.col("w.pos").alias("qbeg"), F.col("w.end").alias("qend"), F.col("w.n").alias("hits"))


def matches(reads: DataFrame, kmer_table: DataFrame, k: int, read_key: str = "read_id", text: str = "seq") -> DataFrame:
    """(read, rid, rev, qbeg, qend, rbeg) of the maximal exact matches with both strands of an index, ``kmer_table(kmer, rid, rev, rpos)``."""
    hits = kmers(reads, read_key, text, k).withColumnRenamed("pos", "qpos").join(kmer_table, "kmer").withColumn("diag", F.col("qpos") - F.col("rpos"))
    order = Window.partitionBy(read_key, "rid", "rev", "diag").orderBy("qpos")
    isles = hits.withColumn("isle", F.col("qpos") - F.row_number().over(order))
    return isles.groupBy(read_key, "rid", "rev", "diag", "isle").agg(F.min("qpos").alias("qbeg"), (F.max("qpos") + k).alias("qend"), F.min("rpos").alias("rbeg")).select(read_key, "rid", "rev", "qbeg", "qend", "rbeg")


def maximal(mems: DataFrame, read_key: str = "read_id") -> DataFrame:
    """(read, qbeg, qend, s): round 1, the intervals of a read that no other of its intervals contains, and how often each occurs."""
    spans = mems.groupBy(read_key, "qbeg", "qend").agg(F.count("*").alias("s"))
    far = F.max("qend").over(Window.partitionBy(read_key).orderBy("qbeg", F.desc("qend")).rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("far", far).where("far is null or far < qend").drop("far")


def reseeded(mems: DataFrame, first: DataFrame, k: int, split_len: int, split_width: int, read_key: str = "read_id") -> DataFrame:
    """(read, qbeg, qend): round 2, for each long interval of ``first`` with few places, the maximal intervals through its middle that occur once more than it.

    The t-th farthest end of the matches that cover a start is the end of the
    longest interval from there with t places.
    """
    middles = first.where((F.col("qend") - F.col("qbeg") >= split_len) & (F.col("s") <= split_width)).select(F.col(read_key).alias("r"), (F.col("s") + 1).alias("t"), F.floor((F.col("qbeg") + F.col("qend")) / 2).alias("x"))
    long = mems.join(middles.select(F.col("r").alias(read_key)).distinct(), read_key, "left_semi")
    starts = long.select(F.col(read_key).alias("r0"), F.col("qbeg").alias("b")).distinct()
    ends = starts.join(long, (F.col("r0") == F.col(read_key)) & (F.col("qbeg") <= F.col("b")) & (F.col("qend") >= F.col("b") + k)).select(read_key, F.col("b").alias("qbeg"), "qend")
    ranked = ends.withColumn("t0", F.row_number().over(Window.partitionBy(read_key, "qbeg").orderBy(F.desc("qend")))).where(F.col("t0") <= split_width + 1)
    prior = F.max("qend").over(Window.partitionBy(read_key, "t0").orderBy("qbeg").rowsBetween(Window.unboundedPreceding, -1))
    bounds = ranked.withColumn("prior", prior).where("prior is null or prior < qend")
    return bounds.join(middles, (F.col(read_key) == F.col("r")) & (F.col("t0") == F.col("t")) & (F.col("qbeg") <= F.col("x")) & (F.col("qend") > F.col("x"))).select(read_key, "qbeg", "qend").distinct()


def walked(reads: DataFrame, mems: DataFrame, k: int, most: int, read_key: str = "read_id", text: str = "seq") -> DataFrame:
    """(read, qbeg, qend): round 3, the forward walk over a read that emits at the first end from k+1 characters on with fewer than ``most`` places.

    After it, the walk goes on behind; where nothing occurs that long, too, and
    behind anything but A, C, G and T. How often a string of k or more occurs is
    told by the matches that cover it: at an end, those that reach it. A read is
    walked by itself, over its matches' begins and ends and how many there are.
    """
    import pandas as pd

    spans = mems.groupBy(read_key, "qbeg", "qend").agg(F.count("*").alias("n")).groupBy(read_key).agg(F.collect_list(F.struct("qbeg", "qend", "n")).alias("spans"))
    joined = reads.select(read_key, F.col(text).alias("seq")).join(spans, read_key)

    def run(parts):
        for p in parts:
            out = []
            for key, seq, found in zip(p[read_key], p["seq"], p["spans"], strict=True):
                out += [(key, b, e) for b, e in walk(seq, [(s["qbeg"], s["qend"], s["n"]) for s in found], k, most)]
            yield pd.DataFrame(out, columns=[read_key, "qbeg", "qend"])

    return joined.mapInPandas(run, f"{read_key} long, qbeg long, qend long")


def walk(seq: str, spans: list[tuple[int, int, int]], k: int, most: int) -> list[tuple[int, int]]:
    """The walk of one read, given its matches (begin, end, how many) of k characters and more."""
    out, x = [], 0
    while x + k < len(seq):
        here = sorted(((e, n) for b, e, n in spans if b <= x and e > x + k - 1), reverse=True)
        stop = next((i for i in range(x, min(len(seq), x + k + 1)) if seq[i] not in "ACGT"), -1)
        if stop >= 0:
            x = stop + 1
            continue
        # the places left at end e are those of the matches that reach it
        total, end = 0, x + k + 1
        for e, n in here:
            if total + n >= most:
                end = max(end, e + 1)
                break
            total += n
        stop = next((i for i in range(x, min(end, len(seq))) if seq[i] not in "ACGT"), -1)
        if stop >= 0:
            x = stop + 1
            continue
        if end > len(seq):
            break
        if any(e >= end for e, _ in here):
            out.append((x, end))
        x = end
    return out


def places(intervals: DataFrame, mems: DataFrame, read_key: str = "read_id") -> DataFrame:
    """(read, qbeg, qend, rid, rev, rbeg): every place of each interval, from the matches that cover it."""
    i = intervals.select(F.col(read_key).alias("r"), F.col("qbeg").alias("b"), F.col("qend").alias("e"))
    over = i.join(mems, (F.col("r") == F.col(read_key)) & (F.col("qbeg") <= F.col("b")) & (F.col("qend") >= F.col("e")))
    return over.select(read_key, F.col("b").alias("qbeg"), F.col("e").alias("qend"), "rid", "rev", (F.col("rbeg") + F.col("b") - F.col("qbeg")).alias("rbeg"))
