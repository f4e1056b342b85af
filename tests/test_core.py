import gzip
import random
from pathlib import Path

import pytest

from strandline import catalogue
from strandline.functions import sequences
from strandline.operators import kernels, seeding
from strandline.sources import reads
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_mem_hits_against_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 400)))) for i in range(12)]
    refs = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(4)]
    want = set()
    for d, a in docs:
        for r, b in refs:
            for i in range(len(a)):
                for j in range(len(b)):
                    if i and j and a[i - 1] == b[j - 1]:
                        continue
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    if n >= 6:
                        want.add((d, r, i, i + n, j, n))
    got = seeding.mem_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(refs, "item_id long, text string"), 6)
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_round_three_extends_common_places(spark):
    rng = random.Random(8)
    word = lambda n, letters="abcdef": "".join(rng.choice(letters) for _ in range(n))
    common = word(60)
    refs = [(i, word(rng.randint(0, 9)) + common[: rng.randint(20, 60)] + word(9)) for i in range(45)] + [(50 + i, word(300, "ab")) for i in range(3)] + [(60, "x" * 50)]
    docs = [(0, word(7) + common + word(30)), (1, common[5:40]), (2, common), (3, word(400, "ab")), (4, "zz" + "x" * 70), (5, "x" * 60 + "zy"), (6, word(5)), (7, "x" * 20 + "b" + "x" * 12 + common * 2)]
    docs += [(10 + i, "".join(rng.choice((common[:30], common[20:], word(11), refs[46][1][:50], "q")) for _ in range(12))) for i in range(10)]
    k, most, want = 8, 20, set()
    count = lambda s: sum(r.startswith(s, i) for _, r in refs for i in range(len(r) - len(s) + 1))
    for d, text in docs:
        x = 0
        while x + k + 1 <= len(text):
            end = next((e for e in range(x + k + 1, len(text) + 1) if count(text[x:e]) < most), len(text) + 1)
            if end <= len(text) and count(text[x:end]):
                want.add((d, x, end, count(text[x:end])))
            x = end
    got = [tuple(r) for r in seeding.round_three(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(refs, "item_id long, text string"), k, most).collect()]
    assert max(e - b for _, b, e, _ in want) > k + 1
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("case", [((100, 0, 100, 0, 0), 60), ((20, 0, 20, 0, 0), 6), ((100, 90, 100, 0, 0), 26), ((100, 90, 100, 2, 0), 21), ((100, 90, 100, 2, 0.25), 16), ((100, 90, 100, 0, 0.25), 19), ((50, 45, 50, 0, 0), 18), ((90, 85, 110, 0, 0), 11)])
def test_mapq(spark, case):
    (score, sub, span, n, rep), want = case
    lit = lambda v: F.lit(float(v))
    q = sequences.single_mapq(lit(score), lit(sub), lit(0), lit(span), lit(span), lit(n), lit(rep))
    assert spark.range(1).select(q.alias("q")).first().q == want


def test_kernels():
    assert kernels.local_score("ACGTACGT", "TTACGTACGTTT") == (8, 10, 8)
    assert kernels.global_cigar("ACGT" * 6, "ACGT" * 3 + "GG" + "ACGT" * 3)[:2] == ("12M2D12M", 2)
    assert kernels.extended("ACGT", "ACGT", 10) == (14, 4, 4)
    rng = random.Random(1)
    for _ in range(30):
        q, t = ("".join(rng.choice("AC") for _ in range(rng.randint(1, 14))) for _ in "qt")
        h = {(0, 0): 0}
        best = 0
        low = -99
        hh = [[0] * (len(q) + 1) for _ in range(len(t) + 1)]
        e = [[low] * (len(q) + 1) for _ in range(len(t) + 1)]
        f = [[low] * (len(q) + 1) for _ in range(len(t) + 1)]
        for i in range(1, len(t) + 1):
            for j in range(1, len(q) + 1):
                e[i][j] = max(e[i - 1][j], hh[i - 1][j] - 6) - 1
                f[i][j] = max(f[i][j - 1], hh[i][j - 1] - 6) - 1
                hh[i][j] = max(0, hh[i - 1][j - 1] + (1 if q[j - 1] == t[i - 1] else -4), e[i][j], f[i][j])
                best = max(best, hh[i][j])
        assert kernels.local_score(q, t)[0] == best, h


def test_kernels_take_every_seed_both_ways(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(n))
    items = [(0, word(300)), (1, word(200))]
    changed = items[0][1][:150] + "?" + items[0][1][151:]  # a mismatch in the middle
    text = word(90) + changed + word(50) + items[1][1][:120] + items[1][1][125:] + word(40)  # and five characters left out
    docs = spark.createDataFrame([(5, text), (6, word(100)), (7, items[1][1])], "doc_id long, text string")
    refs = spark.createDataFrame(items, "item_id long, text string")
    run = lambda name: catalogue.seed_kernel(docs, refs, *{"sw": (catalogue._local, "item_id long, score long, t_end long, q_end long"), "ext": (catalogue._extensions, "item_id long, qbeg long, rbeg long, len long, score long, q_start long, q_taken long, t_start long, t_taken long"), "cigar": (catalogue._cigars, "item_id long, qbeg long, qend long, rbeg long, rend long, cigar string, nm long, score long")}[name]).collect()
    second = 90 + 300 + 50
    assert {tuple(r) for r in run("sw")} == {(5, 0, 295, 300, 390), (5, 1, 195 - 6 - 5, 200, second + 195), (7, 1, 200, 200, 200)}
    assert {tuple(r)[:2] + tuple(r)[2:4] + tuple(r)[5:] for r in run("ext")} == {(5, 0, 90, 0, 295, 90, 300, 0, 300), (5, 0, 241, 151, 295, 90, 300, 0, 300), (5, 1, second, 0, 184, second, 195, 0, 200), (5, 1, second + 120, 125, 184, second, 195, 0, 200), (7, 1, 0, 0, 200, 0, 200, 0, 200)}
    assert {tuple(r) for r in run("cigar")} == {(5, 0, 90, 390, 0, 300, "300M", 1, 295), (5, 1, second, second + 195, 0, 200, "120M5D75M", 5, 184), (7, 1, 0, 200, 0, 200, "200M", 0, 200)}
    assert catalogue.seed_kernel(docs.limit(0), refs, catalogue._local, "item_id long, score long, t_end long, q_end long").collect() == []


def test_reader(spark, tmp_path: Path):
    text = "@a/1 one two\nAC\nGT\n+\nII\nII\n>b\nACNNNGT\r\nNA\n"
    (tmp_path / "x.fq").write_text(text)
    (tmp_path / "y.fq").write_bytes(gzip.compress(text.encode()))
    rows = reads.read_sequences(spark, str(tmp_path)).orderBy("path", "ix").collect()
    assert [(r.ix, r.name, r.comment, r.seq, r.qual) for r in rows] == 2 * [(0, "a/1", "one two", "ACGT", "IIII"), (1, "b", "", "ACNNNGTNA", None)]
    found = reads.holes(reads.read_sequences(spark, str(tmp_path / "x.fq"))).collect()
    assert {(r.name, r.pos, r.len) for r in found} == {("b", 2, 3), ("b", 7, 1)}
    (tmp_path / "r.bed").write_text("#c\nq\t5\t9\nq\t9\t12\nq\t20\t22\n")
    assert {tuple(r) for r in reads.read_bed(spark, str(tmp_path / "r.bed")).collect()} == {("q", 5, 12), ("q", 20, 22)}


def test_fastq_in_splits(spark, tmp_path: Path):
    rng = random.Random(4)
    want = []
    for name, n in (("a.fq", 700), ("b.fq", 3)):
        rows = [(f"r{i}", f"c{i}" if i % 3 else "", "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 90)))) for i in range(n)]
        (tmp_path / name).write_text("".join(f"@{r}{' ' * bool(c)}{c}\n{q}\n+\n{'@' * len(q)}\n" for r, c, q in rows))
        want += [(name, i, r, c, q, "@" * len(q)) for i, (r, c, q) in enumerate(rows)]
    (tmp_path / "c.fq.gz").write_bytes(gzip.compress(b"@z\r\nAC\r\n+\r\nII\r\n"))
    want.append(("c.fq.gz", 0, "z", "", "AC", "II"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = reads.read_fastq(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        assert sorted((r.path.rsplit("/", 1)[1], *r[1:]) for r in df.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "bad.fq").write_text("@x\nACG\n+\nII\n")
    with pytest.raises(Exception, match="four lines"):
        reads.read_fastq(spark, str(tmp_path / "bad.fq")).collect()


def test_sidecars(spark, tmp_path: Path):
    (tmp_path / "ref.dict").write_text("@HD\tVN:1.6\r\n@CO\tx\n\n")
    prefix = str(tmp_path / "ref.fa.gz")
    assert reads.header_sidecar(spark, prefix) == ["@HD\tVN:1.6", "@CO\tx"] and reads.header_sidecar(spark, str(tmp_path / "none")) == []
    (tmp_path / "ref.fa.gz.hdr").write_text("@CO\ty\n")
    assert reads.header_sidecar(spark, prefix) == ["@CO\ty"] == reads.header_lines(spark, prefix + ".hdr") and reads.header_lines(spark, "@CO\tz") == ["@CO\tz"]
    foot = spark.createDataFrame([("p", 10, 20, 1), ("p", 30, 40, 2), ("q", 10, 20, 3)], "contig string, s long, e long, alt long")
    bed = spark.createDataFrame([("p", 19, 30)], "contig string, s long, e long")
    assert sorted(r.alt for r in reads.without_excluded(foot, bed).collect()) == [2, 3]


def test_mates_of_many_files(spark):
    schema = "path string, ix long, name string, comment string, seq string, qual string"
    side = lambda m, sizes: spark.createDataFrame([(f"f{k}_{m}", i, f"p{k}.{i}", "", f"{m}", None) for k, n in enumerate(sizes) for i in range(n)], schema)
    rows = reads.mates(side(1, (3, 2)), side(2, (3, 2))).collect()
    pairs = {}
    for r in rows:
        pairs.setdefault(r.pair_id, {})[r.mate] = (r.name, r.seq)
    assert sorted(pairs.values(), key=str) == [{1: (f"p{k}.{i}", "1"), 2: (f"p{k}.{i}", "2")} for k, n in ((0, 3), (1, 2)) for i in range(n)]
    with pytest.warns(UserWarning, match="2nd side has fewer reads; 1 "):
        assert reads.mates(side(1, (2,)), side(2, (1,))).count() == 2


def test_smart_pairs(spark):
    names = ["a", "a", "b", "c/1", "c/2", "d", "d", "d", "e"]
    frame = spark.createDataFrame([("f", i, n, "", "A", None) for i, n in enumerate(names)], "path string, ix long, name string, comment string, seq string, qual string")
    assert [(r.pair_id, r.mate) for r in reads.smart_pairs(frame).orderBy("ix").collect()] == [(0, 1), (0, 2), (2, 0), (3, 1), (3, 2), (5, 1), (5, 2), (7, 0), (8, 0)]


@pytest.mark.parametrize("name", ["smem_intervals", "smem_dedup", "insert_size_stats", "pair_top1", "pair_erfc_score", "lift_interval", "encode", "meth_index", "chain_cap_topn", "chain_weight", "pos_to_bucket_asof", "reseed_intervals", "seed_absorb_count", "region_dedup", "alt_shadow_list", "rescue_skip_anti"])
def test_queries_against_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        db.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(cols)} FROM ({catalogue.SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, want))
