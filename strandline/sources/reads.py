"""Readers of FASTA and FASTQ (plain or gzip) and of BED, pairing of reads, and a writer of SAM text."""

from __future__ import annotations

import gzip
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

READ = "path string, ix long, name string, comment string, seq string, qual string"
#: First bytes of files that aren't read.
REFUSED = {b"BZh": "bzip2", b"\xfd7zXZ": "xz", b"\x28\xb5\x2f\xfd": "zstd"}


def records(lines: Iterator[str]) -> Iterator[tuple[str, str, str, str | None]]:
    """(name, comment, sequence, qualities) of FASTA and FASTQ records; sequences and qualities may take several lines."""
    head, seq = "", []
    lines = iter(lines)

    def done(qual: str | None) -> tuple[str, str, str, str | None]:
        name, _, comment = head[1:].replace("\t", " ", 1).partition(" ")
        return name, comment, "".join(seq), qual

    for line in lines:
        line = line.rstrip("\r\n")
        if line[:1] in (">", "@"):
            if head:
                yield done(None)
            head, seq = line, []
        elif line[:1] == "+" and head[:1] == "@":
            want, qual = sum(map(len, seq)), ""
            while len(qual) < want and (more := next(lines, None)) is not None:
                qual += more.rstrip("\r\n")
            if len(qual) != want:
                raise ValueError(f"record {head[1:60]}: {len(qual)} qualities for {want} bases")
            yield done(qual)
            head, seq = "", []
        elif head:
            seq.append(line.strip())
    if head:
        yield done(None)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files at ``path``, by Spark's own file access; ``ix`` counts from 0 in each file.

    The codec is told by the first bytes, not the name. A file is one task; a
    large collection comes as many files.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            for where, data in zip(batch["path"], batch["content"], strict=True):
                for magic, name in REFUSED.items():
                    if data.startswith(magic):
                        raise ValueError(f"{where}: {name} isn't read")
                text = (gzip.decompress(data) if data.startswith(b"\x1f\x8b") else data).decode("latin-1")
                rows = [(where, i, *r) for i, r in enumerate(records(text.splitlines()))]
                yield pd.DataFrame(rows, columns=["path", "ix", "name", "comment", "seq", "qual"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, READ)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTQ files of four lines each, in splits of Spark's own: a large plain file is many tasks.

    A line's number in its file comes from the lines of the splits before its
    own, which are counted first; the four lines of a record then meet by file
    and number. Compressed files are one split each, and BGZF is read as gzip.
    A record that isn't four lines ends the job; ``read_sequences`` reads these.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("m"), F.rtrim(F.col("value"), F.lit("\r")).alias("line"))
    splits = lines.groupBy("path", "start").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = splits.select(F.col("path").alias("p"), F.col("start").alias("s"), (before - F.col("first")).alias("shift"))
    numbered = lines.join(F.broadcast(at), (F.col("path") == F.col("p")) & (F.col("start") == F.col("s"))).withColumn("no", F.col("m") + F.col("shift"))
    part = lambda k: F.max(F.when(F.col("no") % 4 == k, F.col("line")))
    rows = numbered.groupBy("path", F.floor(F.col("no") / 4).alias("ix")).agg(*[part(k).alias(f"l{k}") for k in range(4)]).where("l0 <> '' or l1 is not null")
    good = F.col("l0").startswith("@") & F.col("l2").startswith("+") & (F.char_length("l1") == F.char_length("l3"))
    head = F.when(F.coalesce(good, F.lit(False)), F.substring("l0", F.lit(2), F.char_length("l0"))).otherwise(F.raise_error(F.concat(F.lit("record "), F.col("ix").cast("string"), F.lit(" isn't four lines of FASTQ"))))
    rows = rows.withColumn("h", F.split(F.regexp_replace(head, "\t", " "), " ", 2))
    return rows.select("path", "ix", F.col("h")[0].alias("name"), F.coalesce(F.get("h", F.lit(1)), F.lit("")).alias("comment"), F.col("l1").alias("seq"), F.col("l3").alias("qual"))


def mates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two readings in lockstep, file by file in the order of their paths, up to the shorter one: pair_id, mate, and the columns of reads.

    pair_id is the file's number times 2^40 and the record's number. Files are
    few, and only their names are numbered in one place. If one side has more
    records, a warning says so.
    """

    def numbered(df: DataFrame) -> DataFrame:
        files = df.select(F.col("path").alias("p")).distinct().select("p", (F.row_number().over(Window.orderBy("p")) - 1).cast("long").alias("f"))
        return df.join(F.broadcast(files), F.col("path") == F.col("p")).withColumn("pair_id", F.col("f") * (1 << 40) + F.col("ix")).drop("p", "f")

    first, second = numbered(first), numbered(second)
    both = first.select("pair_id").join(second.select("pair_id"), "pair_id")
    counts = [df.count() for df in (first, second, both)]
    if counts[0] != counts[1]:
        warnings.warn(f"the {'2nd' if counts[1] < counts[0] else '1st'} side has fewer reads; {max(counts[:2]) - counts[2]} of the other are left out", stacklevel=2)
    side = lambda df, mate: df.join(both, "pair_id", "left_semi").select("pair_id", F.lit(mate).alias("mate"), "name", "comment", "seq", "qual")
    return side(first, 1).unionByName(side(second, 2))


def smart_pairs(reads: DataFrame) -> DataFrame:
    """Reads of one file each with pair_id and mate: two of one name in a row (``/1`` and ``/2`` taken off) are a pair, the others single, with mate 0."""
    name = F.regexp_replace("name", "(?<=.)/[0-9]$", "")
    w = Window.partitionBy("path").orderBy("ix")
    runs = reads.withColumn("__n", name).withColumn("__new", (F.coalesce(F.lag("__n").over(w), F.lit("\n")) != F.col("__n")).cast("int"))
    runs = runs.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("path", "__run")
    placed = runs.withColumn("__k", F.row_number().over(inside.orderBy("ix")) - 1).withColumn("__c", F.count("*").over(inside))
    single = (F.col("__k") % 2 == 0) & (F.col("__k") == F.col("__c") - 1)
    return placed.select("path", F.when(F.col("__k") % 2 == 1, F.col("ix") - 1).otherwise(F.col("ix")).alias("pair_id"), F.when(single, 0).otherwise((F.col("__k") % 2 + 1).cast("int")).alias("mate"), "ix", "name", "comment", "seq", "qual")


def holes(contigs: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """(name, pos, len) of the runs of anything but A, C, G, T."""
    gaps, runs = F.split(F.col(seq), "[^ACGTacgt]+", -1), F.regexp_extract_all(F.col(seq), F.lit("[^ACGTacgt]+"), F.lit(0))
    pieces = F.zip_with(runs, F.slice(gaps, 1, F.size(runs)), lambda r, g: F.struct(F.char_length(g).alias("g"), F.char_length(r).alias("r")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,len:int>>").alias("out"))
    step = lambda z, p: F.struct((z["at"] + p["g"] + p["r"]).alias("at"), F.concat(z["out"], F.array(F.struct((z["at"] + p["g"]).alias("pos"), p["r"].alias("len")))).alias("out"))
    return contigs.select(name, F.explode(F.aggregate(pieces, zero, step)["out"]).alias("h")).select(name, F.col("h.pos").cast("long").alias("pos"), F.col("h.len").cast("long").alias("len"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(contig, s, e): the intervals of a BED file, those that touch or overlap merged."""
    rows = spark.read.text(path).where("value not rlike '^(#|track|browser|\\\\s*$)'").select(F.split("value", "\t").alias("c"))
    rows = rows.select(F.col("c")[0].alias("contig"), F.col("c")[1].cast("long").alias("s"), F.col("c")[2].cast("long").alias("e")).where("s < e")
    w = Window.partitionBy("contig").orderBy("s", "e")
    far = rows.withColumn("far", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    isle = far.withColumn("isle", F.sum(F.when(F.col("far").isNull() | (F.col("s") > F.col("far")), 1).otherwise(0)).over(w))
    return isle.groupBy("contig", "isle").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("isle")


def lines_of(spark: SparkSession, path: str) -> list[str] | None:
    """The lines of a small text file (a header or sidecar, as long as the reference has contigs), or None if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return [r.value.rstrip("\r") for r in spark.read.text(path, wholetext=False).coalesce(1).collect()]


def header_sidecar(spark: SparkSession, prefix: str) -> list[str]:
    """The lines of ``prefix``.hdr, else of the .dict beside it: without a last .gz and then without the last suffix; none if both are missing."""
    found = lines_of(spark, prefix + ".hdr")
    if found is None:
        base = prefix.removesuffix(".gz")
        folder, _, name = base.rpartition("/")
        name = name.rsplit(".", 1)[0] if "." in name else name
        found = lines_of(spark, f"{folder}/{name}.dict" if folder else f"{name}.dict")
    return [x for x in found or [] if x]


def header_lines(spark: SparkSession, given: str) -> list[str]:
    """Header lines as given, if they begin with @, else those of the file named."""
    if given.startswith("@"):
        return given.split("\n")
    found = lines_of(spark, given)
    if found is None:
        raise FileNotFoundError(given)
    return [x for x in found if x]


def without_excluded(contigs: DataFrame, bed: DataFrame) -> DataFrame:
    """Those of ``contigs(contig, s, e, ...)`` whose whole footprint on the primary no interval of ``bed(contig, s, e)`` touches."""
    b = bed.select(F.col("contig").alias("__c"), F.col("s").alias("__s"), F.col("e").alias("__e"))
    return contigs.join(b, (F.col("contig") == F.col("__c")) & (F.col("__s") < F.col("e")) & (F.col("s") < F.col("__e")), "left_anti")


def write_sam(lines: DataFrame, header: list[str], path: str) -> None:
    """``lines(read_id, rec_ix, line)`` in read order, below the header, as text files that follow one another."""
    spark = lines.sparkSession
    top = spark.createDataFrame([(-1, i, h) for i, h in enumerate(header)], "read_id long, rec_ix long, line string")
    rows = top.unionByName(lines.selectExpr("CAST(read_id AS BIGINT) AS read_id", "CAST(rec_ix AS BIGINT) AS rec_ix", "line"))
    rows.orderBy("read_id", "rec_ix").select("line").write.text(path)
