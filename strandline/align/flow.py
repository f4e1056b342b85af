"""Reads to SAM lines: seeds by joins, chains and regions read by read, insert sizes by aggregation, pairs, records.

What is one read's or one pair's is bounded by its length and the cap on
occurrences, and is folded in Arrow batches; everything else is joins and
aggregations. The only step over many reads is the insert-size model of a batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.align import alt, chains, index, pairs, records, regions
from strandline.align.chains import Seed
from strandline.align.options import DEFAULTS, Options
from strandline.align.regions import Region
from strandline.operators import matching, seeding
from strandline.session import settled


def seeds_of(reads: DataFrame, ref: index.Index, o: Options = DEFAULTS) -> DataFrame:
    """(read_id, qbeg, qend, s, rid, rev, rbeg): the intervals of all three rounds at their places, ``max_occ`` of each at most.

    An interval that occurs s times, more than that, gives every s // max_occ-th of its places in order.
    """
    return _seeded(reads, ref, o)[0]


def _matched(reads: DataFrame, ref: index.Index) -> tuple[DataFrame, DataFrame]:
    """The maximal matches, and (read_id, upper, seq) of the reads that may have any: those of a small reference are found where reads are read, of a larger one by a join of k-mers."""
    upper = reads.select("read_id", F.upper("seq").alias("upper"), "seq")
    size = ref.contigs.agg(F.sum("len")).first()[0] or 0
    if 2 * size <= matching.MOST and reads.schema["read_id"].dataType.simpleString() == "bigint":
        known = matching.Matcher(*index.both_strands(ref), ref.k)
        known.coded[ord(index.NO_BASE) :] = 0
        found = settled(matching.tagged(upper, known, "read_id", "upper", "seq"))
        # matches of two reads of one id, or of none, belong together
        if found.groupBy("read_id").agg(F.min("tag").alias("a"), F.max("tag").alias("b")).where("a < b or read_id is null").isEmpty():
            return found.drop("tag", "upper", "seq"), found.where("upper is not null").select("read_id", "upper", "seq")
    return settled(seeding.matches(upper, ref.kmers, ref.k, "read_id", "upper")), upper


def _seeded(reads: DataFrame, ref: index.Index, o: Options) -> tuple[DataFrame, DataFrame]:
    """The seeds, and (read_id, seq) of the reads that may have any."""
    mems, some = _matched(reads, ref)
    first = settled(seeding.maximal(mems))
    found = first.select("read_id", "qbeg", "qend").unionByName(seeding.reseeded(mems, first, ref.k, o.split_len, o.split_width))
    if o.round3:
        found = found.unionByName(seeding.walked(some, mems, ref.k, o.round3, "read_id", "upper"))
    spots = seeding.places(found.distinct(), mems)
    w = Window.partitionBy("read_id", "qbeg", "qend")
    spots = spots.withColumn("s", F.count("*").over(w)).withColumn("n", F.row_number().over(w.orderBy("rid", "rev", "rbeg")) - 1)
    step = F.when(F.col("s") > o.max_occ, F.floor(F.col("s") / o.max_occ)).otherwise(1)
    return spots.where((F.col("n") % step == 0) & (F.floor(F.col("n") / step) < o.max_occ)).drop("n"), some.select("read_id", "seq")


def _mapped(df: DataFrame, f: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that ``f`` gives for each row of ``df``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([row for x in p.itertuples(index=False) for row in f(*x)], columns=names)

    return df.mapInPandas(run, schema)


def _contigs(ref: index.Index) -> tuple[dict[int, int], dict[int, str], dict[int, str], frozenset[int]]:
    """Lengths, names and notes of the contigs, which are as many as the reference has, and those that are ALT."""
    rows = ref.contigs.collect()
    return {r.rid: r.len for r in rows}, {r.rid: r.name for r in rows}, {r.rid: r.anno for r in rows}, frozenset(r.rid for r in rows if r.is_alt)


def chains_of(reads: DataFrame, seeds: DataFrame, ref: index.Index, o: Options = DEFAULTS, order: str = "off") -> DataFrame:
    """(read_id, ix, rid, rev, chain, rb, re): each read's chains that stay, as JSON, and the reference span that their extension may need."""
    lengths, _, _, alts = _contigs(ref)
    per = seeds.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("qbeg", "qend", "rid", "rev", "rbeg", "s"))).alias("seeds"))

    def run(read_id: int, seq: str, found: list) -> Iterator[tuple]:
        some = [Seed(x["rid"], x["rev"], x["rbeg"], x["qbeg"], x["qend"] - x["qbeg"], x["s"]) for x in found]
        repeats = chains.repeat_fraction(sorted({(x["qbeg"], x["qend"], x["s"]) for x in found}), len(seq), o)
        kept, left_out = chains.capped(chains.filtered(chains.chained(chains.ordered(some, order), o, alts), o), o)
        for ix, c in enumerate(kept):
            c.frac_rep, c.capped_w = repeats, left_out
            c = chains.without_short_seeds(c, o)
            reach = len(seq) + o.band * 2 + chains.NEARBY
            b = max(0, min(x.rbeg - x.qbeg for x in c.seeds) - reach)
            e = min(lengths[c.seeds[0].rid], max(x.rbeg + len(seq) - x.qbeg for x in c.seeds) + reach)
            yield read_id, ix, *c.strand, json.dumps(asdict(c)), b, e

    joined = reads.select("read_id", "seq").join(per, "read_id")
    return _mapped(joined, run, "read_id long, ix long, rid int, rev int, chain string, rb long, re long")


def _chain(text: str) -> chains.Chain:
    d = json.loads(text)
    return chains.Chain(**d | {"seeds": [Seed(**s) for s in d["seeds"]]})


def packed(a: list[Region]) -> str:
    return json.dumps([asdict(r) for r in a])


def unpacked(text: str | None) -> list[Region]:
    return [Region(**r) for r in json.loads(text)] if text else []


def regions_of(reads: DataFrame, kept: DataFrame, ref: index.Index, o: Options = DEFAULTS) -> DataFrame:
    """(read_id, regions): each read's regions by score, redundant ones gone, as JSON; reads without any are left out."""
    kept = settled(kept)
    texts = index.slices(kept, ref, "read_id", "ix")
    per = kept.join(texts, ["read_id", "ix"]).groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("ix", "chain", "rb", "text"))).alias("c"))

    def run(read_id: int, seq: str, found: list) -> Iterator[tuple]:
        out, spans = [], []
        for x in found:
            c = _chain(x["chain"])
            spans.append((*c.strand, x["rb"], x["text"]))
            out += regions.extended(c, seq.upper(), x["text"], x["rb"], o)

        def slice_of(rid: int, rev: int, rb: int, re: int) -> str | None:
            return next((t[rb - b : re - b] for r, v, b, t in spans if (r, v) == (rid, rev) and b <= rb and re <= b + len(t)), None)

        yield read_id, packed(regions.deduped(out, o, seq.upper(), slice_of))

    found = _mapped(reads.select("read_id", "seq").join(per, "read_id"), run, "read_id long, regions string")
    return found


def projected(found: DataFrame, ref: index.Index, lifts: dict[int, alt.Lift], o: Options) -> DataFrame:
    """``found(read_id, regions)`` with hits on ALT contigs lifted to the primary assembly."""
    lengths, *_ = _contigs(ref)

    def move(read_id: int, text: str) -> Iterator[tuple]:
        a = alt.project(unpacked(text), lifts, lengths, o)
        if o.project_only:
            a = alt.without_unlifted(a, o)[0]
        yield read_id, packed(a)

    moved = settled(_mapped(found.select("read_id", "regions"), move, "read_id long, regions string"))
    jobs = _mapped(moved, lambda i, text: [(i, k, r.rid, r.rev, r.rb, r.re) for k, r in enumerate(unpacked(text)) if not r.ref], "read_id long, ix long, rid int, rev int, rb long, re long")
    texts = index.slices(jobs, ref, "read_id", "ix").groupBy("read_id").agg(F.collect_list(F.struct("ix", "text")).alias("t"))

    def fill(read_id: int, text: str, told: list | None) -> Iterator[tuple]:
        a = unpacked(text)
        for x in told if told is not None else ():
            a[x["ix"]].ref = x["text"]
        yield read_id, packed(a)

    return _mapped(moved.join(texts, "read_id", "left"), fill, "read_id long, regions string")


def batches(reads: DataFrame, bases: int, block: int = 1 << 16) -> DataFrame:
    """(pair_id, batch_id): pairs in order, a new batch with every ``bases`` characters before a pair.

    Sums go by blocks of pairs, then over the blocks. What a batch has too much
    isn't taken off the next one, unlike a cut that starts counting anew.
    """
    size = reads.groupBy("pair_id").agg(F.sum(F.char_length("seq")).alias("n")).withColumn("block", F.floor(F.col("pair_id") / block))
    whole = size.groupBy("block").agg(F.sum("n").alias("t"))
    before = whole.select("block", F.coalesce(F.sum("t").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("pair_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return size.withColumn("inner", inner).join(before, "block").select("pair_id", F.floor((F.col("before") + F.col("inner")) / bases).cast("long").alias("batch_id"))


PAIR = "pair_id long, way int, size long"


def insert_models(found: DataFrame, ref: index.Index, o: Options, batch: DataFrame) -> DataFrame:
    """(batch_id, models): the four orientations of every batch as JSON, from ``found(pair_id, r1, r2)``."""
    lengths, *_ = _contigs(ref)

    def run(pair_id: int, one: str | None, two: str | None) -> Iterator[tuple]:
        got = pairs.candidate(unpacked(one), unpacked(two), lengths, o)
        if got:
            yield pair_id, *got

    sizes = _mapped(found.where("r1 is not null and r2 is not null").select("pair_id", "r1", "r2"), run, PAIR).join(batch, "pair_id")
    counts = sizes.groupBy("batch_id", "way", "size").count().groupBy("batch_id").agg(F.collect_list(F.struct("way", "size", "count")).alias("c"))  # 4 x max_ins at most

    def fit(batch_id: int, counted: list | None) -> Iterator[tuple]:
        models = pairs.fitted({(x["way"], x["size"]): x["count"] for x in (counted if counted is not None else ())})
        yield batch_id, json.dumps([asdict(m) for m in models])

    return _mapped(batch.select("batch_id").distinct().join(counts, "batch_id", "left"), fit, "batch_id long, models string")


def align(reads: DataFrame, ref: index.Index, o: Options = DEFAULTS, lifts: dict[int, alt.Lift] | None = None) -> DataFrame:
    """(read_id, rec_ix, line): SAM lines of ``reads(read_id, pair_id, mate, name, comment, seq, qual)``.

    mate is 1 and 2 for pairs, else 0; a pair's two rows have one pair_id, and
    pair_ids follow the input's order. A read without sequence is unmapped.
    """
    reads = reads.withColumn("seq", F.coalesce("seq", F.lit("")))
    seeds, some = _seeded(reads, ref, o)
    found = regions_of(some, chains_of(some, seeds, ref, o), ref, o)
    if o.project and lifts:
        found = projected(found, ref, lifts, o)
    whole = settled(reads.join(found, "read_id", "left"))
    return _single(whole.where("mate = 0"), ref, o).unionByName(_paired(whole.where("mate > 0"), ref, o))


LINES = "read_id long, rec_ix long, line string"


def _single(whole: DataFrame, ref: index.Index, o: Options) -> DataFrame:
    lengths, names, notes, _ = _contigs(ref)

    def run(read_id: int, name: str, comment: str | None, seq: str, qual: str | None, text: str | None) -> Iterator[tuple]:
        a, _ = regions.marked(unpacked(text), o, regions.tie_id(o, name, read_id))
        if o.primary5:
            a = regions.reordered(a, o)
        regions.with_capped_sub(a, o)
        read = records.Read(name, seq, qual, comment or "")
        hits = records.single(a, seq.upper(), lengths, names, o)
        for k in range(len(hits)):
            yield read_id, k, "\t".join(records.fields_of(read, hits, k, None, names, o, notes))

    return _mapped(whole.select("read_id", "name", "comment", "seq", "qual", "regions"), run, LINES)


def _paired(whole: DataFrame, ref: index.Index, o: Options) -> DataFrame:
    lengths, names, notes, _ = _contigs(ref)
    side = lambda m: whole.where(F.col("mate") == m).select(F.col("pair_id").alias(f"p{m}"), F.struct("read_id", "name", "comment", "seq", "qual").alias(f"d{m}"), F.col("regions").alias(f"r{m}"))
    both = side(1).join(side(2), F.col("p1") == F.col("p2")).select(F.col("p1").alias("pair_id"), "d1", "d2", "r1", "r2")
    batch = settled(batches(whole, o.batch_bases))
    if o.insert:
        fixed = json.dumps([asdict(m) for m in pairs.given(o.insert)])
        both = settled(both.withColumn("models", F.lit(fixed)))
    else:
        models = insert_models(both, ref, o, batch)
        both = settled(both.join(batch, "pair_id").join(models, "batch_id"))

    def wanted(pair_id: int, d1: dict, d2: dict, one: str | None, two: str | None, told: str) -> Iterator[tuple]:
        a, fits = [unpacked(one), unpacked(two)], [pairs.Insert(**m) for m in json.loads(told)]
        jobs = {(r.rid, r.rev, w.rb, w.re) for e, mate in ((0, d2), (1, d1)) if a[e] for r in pairs.anchors(a[e], o) for w in pairs.windows(r, a[1 - e], len(mate["seq"]), fits, lengths, o)}
        for rid, rev, rb, re in jobs:
            yield pair_id, rid, rev, rb, re

    columns = both.select("pair_id", "d1", "d2", "r1", "r2", "models")
    if o.no_rescue:
        told = both.select("pair_id", F.lit(None).cast("array<struct<rid:int,rev:int,rb:long,re:long,text:string>>").alias("t"))
    else:
        jobs = _mapped(columns.where("r1 is not null or r2 is not null"), wanted, "pair_id long, rid int, rev int, rb long, re long").selectExpr("pair_id", "rid", "rev", "rb", "re", "rid AS a", "rev AS b", "rb AS c", "re AS d")
        told = index.slices(jobs, ref, "pair_id", "a", "b", "c", "d").groupBy("pair_id").agg(F.collect_list(F.struct(F.col("a").alias("rid"), F.col("b").alias("rev"), F.col("c").alias("rb"), F.col("d").alias("re"), "text")).alias("t"))

    def run(pair_id: int, d1: dict, d2: dict, one: str | None, two: str | None, told: str, texts: list | None) -> Iterator[tuple]:
        fits = [pairs.Insert(**m) for m in json.loads(told)]
        near = {(x["rid"], x["rev"], x["rb"], x["re"]): x["text"] for x in (texts if texts is not None else ())}
        both_reads = [records.Read(d["name"], d["seq"], d["qual"], d["comment"] or "") for d in (d1, d2)]
        for e, k, line in lines_of(both_reads, [unpacked(one), unpacked(two)], fits, lengths, names, notes, o, pair_id, lambda *key: near.get(key)):
            yield (d1, d2)[e]["read_id"], k, line

    return _mapped(columns.join(told, "pair_id", "left"), run, LINES)


def lines_of(reads: list[records.Read], a: list[list[Region]], models: list[pairs.Insert], lengths: dict[int, int], names: dict[int, str], notes: dict[int, str], o: Options, ident: int, text_of: Callable[..., str | None]) -> Iterator[tuple[int, int, str]]:
    """(end, number, SAM line) of a pair, from both ends' regions."""
    seqs = [r.seq.upper() for r in reads]
    a = pairs.with_rescues(a, seqs, models, lengths, o, text_of)
    marked = [regions.marked(x, o, regions.tie_id(o, reads[0].name, ident) << 1 | e) for e, x in enumerate(a)]
    a, plain = [x for x, _ in marked], [n for _, n in marked]
    if o.primary5:
        a = [regions.reordered(x, o) for x in a]
    for x in a:
        regions.with_capped_sub(x, o)
    done = pairs.resolved(a, plain, models, lengths, o, regions.tie_id(o, reads[0].name, ident))
    side = (0x40, 0x80)
    if done.paired:
        hits: list[list[records.Hit]] = []
        for e in (0, 1):
            more = records.other_hits(a[e], seqs[e], lengths, names, o) if not o.all_hits else {}
            h = records.hit_of(a[e][done.places[e]], seqs[e], lengths, o, done.quality[e])
            h.flag = h.flag & ~0x100 | side[e] | done.flag & 2
            h.xa, h.hn = more.get(done.places[e], ("", 0))
            some = [h]
            k = regions.first_alt(a[e], plain[e], o)
            if k >= 0:
                g = records.hit_of(a[e][k], seqs[e], lengths, o)
                g.flag |= 0x800 | side[e] | done.flag & 2
                g.xa, g.hn = more.get(k, ("", 0))
                some.append(g)
            hits.append(some)
        tops = [x[0] for x in hits]
    else:
        best = [next((r for r in [*x[:1], *x[n:]] if r.score >= o.least), None) for x, n in zip(a, plain, strict=True)]
        tops = [records.hit_of(b, s, lengths, o) for b, s in zip(best, seqs, strict=True)]
        pair = 2 if not o.no_pairing and pairs.proper(best[0], best[1], models, lengths) else 0
        hits = [records.single(a[e], seqs[e], lengths, names, o, side[e] | pair) for e in (0, 1)]
    for e in (0, 1):
        for k in range(len(hits[e])):
            yield e, k, "\t".join(records.fields_of(reads[e], hits[e], k, tops[1 - e], names, o, notes))


def write_bam(lines: DataFrame, header: list[str], path: str, level: int = 6) -> None:
    """``lines(read_id, rec_ix, line)`` in read order as BGZF parts, a row each, of a BAM file: header, then records, then the closing block.

    Parts are Parquet rows (part, data); their data one after another is the
    file, so no task or driver holds more than a part.
    """
    rids = {f.split("SN:", 1)[1].split("\t")[0]: i for i, f in enumerate(x for x in header if x.startswith("@SQ"))}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, p in enumerate(parts):
            data = b"".join(records.bam_record(x.split("\t"), rids) for x in p["line"])
            yield pd.DataFrame({"part": [part << 32 | k + 1], "data": [records.bgzf(data, level)]})

    spark = lines.sparkSession
    ends = spark.createDataFrame([(0, bytearray(records.bgzf(records.bam_header(header), level))), (1 << 62, bytearray(records.LAST))], "part long, data binary")
    lines.orderBy("read_id", "rec_ix").select("line").mapInPandas(run, "part long, data binary").unionByName(ends).write.parquet(path)
