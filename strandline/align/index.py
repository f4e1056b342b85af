"""The reference as tables: contigs, holes, pieces of text and k-mers of both strands; built once, written, and read again."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import sequences
from strandline.operators import seeding
from strandline.sources import reads

#: Characters of a piece of reference text.
PIECE = 1024
#: A code point that is no character.
NO_BASE = "\U0010ffff"


@dataclass
class Index:
    """``contigs(rid, name, anno, len, offset, is_alt)``, ``holes(rid, pos, len)``, ``pieces(rid, ix, text)``, ``kmers(kmer, rid, rev, rpos)``."""

    k: int
    contigs: DataFrame
    holes: DataFrame
    pieces: DataFrame
    kmers: DataFrame

    def write(self, path: str, files: int = 0) -> "Index":
        """The tables as Parquet below ``path``; k-mers are dealt by hash and sorted, so that a filter on some reads few row groups."""
        spark = self.contigs.sparkSession
        kmers = self.kmers.repartition(files, "kmer") if files else self.kmers.repartition("kmer")
        for name, df in (("contigs", self.contigs), ("holes", self.holes), ("pieces", self.pieces), ("kmers", kmers.sortWithinPartitions("kmer"))):
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        spark.createDataFrame([(json.dumps({"k": self.k}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/options")
        return load(spark, path)

    def jump_table(self, size: int) -> DataFrame:
        """(kmer, n, first) of every string of up to ``size`` characters (k at most) that begins a k-mer of the index; first is its least (rid, rev, rpos)."""
        place = F.struct("rid", "rev", "rpos")
        prefixes = self.kmers.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(min(size, self.k))), lambda n: F.substring("kmer", F.lit(1), n))).alias("kmer"), place.alias("p"))
        return prefixes.groupBy("kmer").agg(F.count("*").alias("n"), F.min("p").alias("first"))


def build(refs: DataFrame, k: int = 19, alts: DataFrame | None = None, order: list[str] = ("path", "ix")) -> Index:
    """An index of ``refs(name, comment, seq, ...)``, in the order of ``order``; ``alts(name)`` names alternative contigs.

    Contigs are numbered in one task, by their names and lengths alone. Text is
    upper-case; k-mers with anything but A, C, G and T are in no table, and none
    reaches over a contig's end.
    """
    numbered = refs.select("name", F.coalesce("comment", F.lit("")).alias("anno"), F.char_length("seq").cast("long").alias("len"), *order)
    w = Window.orderBy(*order)
    numbered = numbered.select((F.row_number().over(w) - 1).cast("int").alias("rid"), "name", "anno", "len", F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("offset"))
    if alts is not None:
        numbered = numbered.join(alts.select("name").distinct().withColumn("is_alt", F.lit(True)), "name", "left")
    else:
        numbered = numbered.withColumn("is_alt", F.lit(False))
    contigs = numbered.select("rid", "name", "anno", "len", "offset", F.coalesce("is_alt", F.lit(False)).alias("is_alt"))
    text = refs.select("name", F.upper("seq").alias("seq")).join(contigs.select("rid", "name"), "name")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.char_length("seq") - 1) / PIECE).cast("int")), lambda i: F.substring(F.col("seq"), i * PIECE + 1, F.lit(PIECE)))
    pieces = text.where("seq <> ''").select("rid", F.posexplode(cut).alias("ix", "text"))
    both = text.select("rid", F.lit(0).alias("rev"), "seq").unionByName(text.select("rid", F.lit(1).alias("rev"), sequences.reverse_complement(F.col("seq")).alias("seq")))
    named = both.select((F.col("rid") * 2 + F.col("rev")).alias("key"), "seq")
    kmers = seeding.kmers(named, "key", "seq", k).where("kmer rlike '^[ACGT]+$'")
    kmers = kmers.select("kmer", F.floor(F.col("key") / 2).cast("int").alias("rid"), (F.col("key") % 2).cast("int").alias("rev"), F.col("pos").alias("rpos"))
    return Index(k, contigs, reads.holes(text, "rid", "seq"), pieces, kmers)


def load(spark: SparkSession, path: str) -> Index:
    """The index that ``Index.write`` left at ``path``."""
    k = json.loads(spark.read.text(f"{path}/options").first()[0])["k"]
    return Index(k, *(spark.read.parquet(f"{path}/{name}") for name in ("contigs", "holes", "pieces", "kmers")))


def both_strands(index: Index) -> tuple[list[int], list[str]]:
    """2 * rid + rev and text of both strands of every contig, with what is no base as a character that no read has; for small references."""
    pieces: dict[int, list[tuple[int, str]]] = {}
    for r in index.pieces.select("rid", "ix", "text").collect():
        pieces.setdefault(r.rid, []).append((r.ix, r.text))
    whole = {rid: re.sub("[^ACGT]", NO_BASE, "".join(t for _, t in sorted(p))) for rid, p in sorted(pieces.items())}
    turn = str.maketrans("ACGT", "TGCA")
    two = [(2 * rid + rev, t[::-1].translate(turn) if rev else t) for rid, t in whole.items() for rev in (0, 1)]
    return [i for i, _ in two], [t for _, t in two]


def slices(jobs: DataFrame, index: Index, *keys: str) -> DataFrame:
    """``keys`` and ``text`` for each of ``jobs(keys, rid, rev, rb, re)``: the reference from rb to re in the frame of the strand, clamped to the contig.

    Jobs meet the pieces that they need by an equi-join, so no task holds a contig.
    """
    size = index.contigs.select("rid", F.col("len").alias("__len"))
    at = jobs.select(*keys, "rid", "rev", "rb", "re").join(size, "rid")
    rb, re_ = F.greatest("rb", F.lit(0)), F.least("re", "__len")
    at = at.select(*keys, "rid", "rev", F.when(F.col("rev") == 0, rb).otherwise(F.col("__len") - re_).alias("__b"), F.when(F.col("rev") == 0, re_).otherwise(F.col("__len") - rb).alias("__e")).where("__b < __e")
    wanted = at.select("*", F.explode(F.sequence(F.floor(F.col("__b") / PIECE), F.floor((F.col("__e") - 1) / PIECE))).alias("__p"))
    pieces = index.pieces.select(F.col("rid").alias("__r"), F.col("ix").cast("long").alias("__ix"), "text")
    found = wanted.join(pieces, (F.col("rid") == F.col("__r")) & (F.col("__p") == F.col("__ix"))).groupBy(*keys, "rid", "rev", "__b", "__e").agg(F.array_sort(F.collect_list(F.struct("__p", "text"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["text"]), "")
    forward = F.substring(whole, (F.col("__b") % PIECE + 1).cast("int"), (F.col("__e") - F.col("__b")).cast("int"))
    return found.select(*keys, F.when(F.col("rev") == 0, forward).otherwise(sequences.reverse_complement(forward)).alias("text"))
