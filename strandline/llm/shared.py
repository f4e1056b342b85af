"""Helpers of this subpackage: shared storage, native match positions, graph components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a table that tells which rows can't be joined; 2 MB, whatever the number of keys.
BITS = 1 << 24
#: ASCII white space as the contracts of the queries have it: space and TAB to CR.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one of our own if driver and executors are one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='strandline-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder, in folders by ``parts``, and read again.

    It cuts the lineage, survives lost executors and gives the planner true
    sizes, so that only what is small is broadcast. The files go when the
    driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.partitionBy(*parts).parquet(path)
    fs, hadoop = _file_system(spark, path)
    fs.deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str) -> tuple:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Has a query delete its shuffle files when it has ended, as what it wrote stands for them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def dropped(*frames: DataFrame, parts: tuple[str, ...] = ()) -> None:
    """Deletes the files of frames that ``stored`` returned and nothing reads any more; of these, only the folders ``parts`` if given."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if not parts or path.rsplit("/", 1)[1] in parts:
                fs, hadoop = _file_system(df.sparkSession, path)
                fs.delete(hadoop, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def text_id(text: Column) -> Column:
    """A 64-bit name of a text; null is empty. With an id it tells rows from one another."""
    return F.xxhash64(F.coalesce(text.cast("binary"), F.lit(b"")))


def spread_join(rows: DataFrame, facts: DataFrame, key: str, shares: int = 256) -> DataFrame:
    """``rows`` inner-joined with ``facts(k, n, ...)``, one row per key, of which n of ``rows`` have the key.

    A key of more than 1/``shares`` of all rows is one of fewer than ``shares``
    keys, so the facts of these are broadcast and their rows stay where they
    are. The other keys are shuffled, none of them with more rows than that.
    """
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * shares > total
    often = rows.join(F.broadcast(facts.where(hot)), F.col(key) == F.col("k"))
    names = F.broadcast(facts.where(hot).select(F.col("k").alias("__hot")))
    rest = rows.join(names, F.col(key) == F.col("__hot"), "left_anti").join(facts.where(~hot), F.col(key) == F.col("k"))
    return often.unionByName(rest)


def fixed(value: Column) -> Column:
    """``value``, worked out once a row where it stands.

    The condition always holds, but isn't deterministic: the optimiser neither
    copies the expression into lambdas nor pushes filters on it below.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often and in whatever lambdas it is used."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Of each place of the array ``values``, all values before it folded by the associative ``op``, from its neutral ``zero``.

    A fold copies its state at each step, so blocks are folded by themselves,
    then their results, and both are brought together: no state is long.
    """
    block = lambda v: F.greatest(F.lit(16), F.pow(F.size(v).cast("double"), F.lit(0.4)).cast("int"))

    def fold(part: Column) -> Column:
        start = F.struct(zero.alias("at"), F.slice(F.array(zero), 1, 0).alias("out"))
        return F.aggregate(part, start, lambda z, x: F.struct(op(z["at"], x).alias("at"), F.concat(z["out"], F.array(z["at"])).alias("out")))

    def scan(v: Column) -> Column:
        blocks = let(block(v), lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / n).cast("int")), lambda b: fold(F.slice(v, b * n + 1, n))))
        both = let(blocks, lambda done: F.zip_with(done, fold(F.transform(done, lambda d: d["at"]))["out"], lambda d, at: F.transform(d["out"], lambda x: op(at, x))))
        return F.when(F.size(v) > 0, F.flatten(both)).otherwise(F.slice(F.array(zero), 1, 0))

    return let(values, scan)


def match_spans(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """Every match of ``pattern`` as struct(start, rank, end, kind, hit), by start.

    Matches are leftmost and non-overlapping. The pieces between the matches
    and the matches themselves alternate, so running sums of their lengths are
    the positions (code points, end exclusive). The pattern matches no empty
    string.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = let(hits, lambda found: F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda hit, gap: F.struct(hit.alias("hit"), F.char_length(gap).alias("gap"), F.char_length(hit).alias("size"))))

    def spans(found: Column) -> Column:
        before = running(F.transform(found, lambda p: p["gap"] + p["size"]), lambda x, y: x + y, F.lit(0))
        return F.zip_with(found, before, lambda p, at: F.struct((at + p["gap"]).alias("start"), F.lit(rank).alias("rank"), (at + p["gap"] + p["size"]).alias("end"), F.lit(kind).alias("kind"), p["hit"].alias("hit")))

    return let(pieces, spans)


def uncovered(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that none of ``others`` overlaps, by start; both are arrays of structs with start and end."""
    mark = lambda at, mine, end, s: F.struct(at.alias("at"), mine.alias("mine"), end.alias("far"), s.alias("s"))
    # at its end, a span meets all others that start before; the farthest of their ends tells
    events = F.array_sort(F.concat(F.transform(others, lambda o: mark(o["start"], F.lit(1), o["end"], o)), F.transform(spans, lambda s: mark(s["end"], F.lit(0), F.lit(0), s))))

    def free(e: Column) -> Column:
        far = running(F.transform(e, lambda x: x["far"]), F.greatest, F.lit(0))
        kept = F.filter(F.zip_with(e, far, lambda x, f: F.struct(x.alias("x"), f.alias("f"))), lambda y: (y["x"]["mine"] == 0) & (y["f"] <= y["x"]["s"]["start"]))
        return F.transform(kept, lambda y: y["x"]["s"])

    return let(events, free)


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,hit:string>>")


def spans_text(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: Column, spans: Column, cut: int = 256) -> Column:
    """``text`` with each span replaced by its kind in brackets; spans that overlap an earlier one are dropped into it.

    Pieces are taken from parts of ``cut`` characters, so that none is counted
    from the beginning of the text.
    """

    def built(parts: Column, sorted_spans: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            first = F.floor(start / cut).cast("int")
            some = F.array_join(F.slice(parts, first + 1, F.floor(end / cut).cast("int") - first + 1), "")
            return F.when(end > start, F.substring(some, start - first * cut + 1, end - start)).otherwise("")

        far = running(F.transform(sorted_spans, lambda s: s["end"]), F.greatest, F.lit(0))
        marked = F.zip_with(sorted_spans, far, lambda s, at: F.when(s["start"] >= at, F.concat(piece(at, s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(""))
        last = F.array_max(F.transform(sorted_spans, lambda s: s["end"]))
        return F.concat(F.array_join(marked, ""), piece(last, F.greatest(last, (F.size(parts) * cut).cast("int"))))

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{cut}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(parts, lambda p: let(F.array_sort(spans), lambda s: built(p, s)))).otherwise(text)


def bitmap(keys: DataFrame, bits: int = BITS) -> Column:
    """The hashes of ``keys(h)`` as a constant of up to ``bits`` bits for ``in_bitmap``, smaller where they are few.

    It only spares shuffles: what is not in it is surely no key. With many more
    keys than bits it lets everything pass.
    """
    spot = F.pmod("h", F.lit(bits))
    rows = keys.select(F.shiftright(spot, 6).cast("int").alias("w"), F.expr("shiftleft(1L, CAST(pmod(h, 64) AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()  # at most bits / 64 rows
    size = min(bits // 64, 1 << (16 * len(rows)).bit_length())
    words = [0] * size
    for r in rows:
        words[r.w % size] |= r.b
    return keys.sparkSession.createDataFrame([(words,)], "w array<long>").scalar()


def in_bitmap(table: Column, h: Column) -> Column:
    word = F.get(table, F.pmod(F.shiftright(h, 6), F.size(table)).cast("int"))
    return F.getbit(word, F.pmod(h, F.lit(64)).cast("int")) == 1


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges(u, v)``: root is the smallest node it is connected to.

    Alternating large-star and small-star rounds: each round is a minimum per
    node (combined before the shuffle) and an equi-join; rounds grow with the
    logarithm of the longest path. Every round is checkpointed. Rounds end when
    every node has one edge, to a node that has none itself: then all are stars
    on their smallest nodes.
    """
    e = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    while not is_stars(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), F.least("a", "low").alias("low"))
        large = both.join(low, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "n")
        pair = F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b"))))
        small = large.join(low, F.col("a") == F.col("n")).select(pair.alias("p")).select("p.a", "p.b").where("a <> b").distinct()
        e = checkpointed(small)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def is_stars(e: DataFrame) -> bool:
    """Whether every a of ``e(a, b)`` has one row and is no b."""
    sides = e.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up")))).alias("s")).select("s.*")
    per = sides.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return per.where((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("low") == 0))).limit(1).count() == 0
