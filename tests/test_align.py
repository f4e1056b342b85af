"""The aligner on a synthetic reference with planted repeats, and its parts against plain versions and cases worked by hand."""

import itertools
import math
import random

import numpy as np
import pytest

from strandline.align import alt, chains, flow, index, kernels, methylation, pairs, records, regions
from strandline.align.chains import Seed
from strandline.align.options import options
from strandline.align.regions import Region
from strandline.operators import seeding

OPT = options()


def genome():
    """Four contigs: R three times, once turned around; S and a copy with every twentieth base changed; short repeats and a hole."""
    x = 20261024

    def draw(n):
        nonlocal x
        out = []
        for _ in range(n):
            x = 48271 * x % (2**31 - 1)
            out.append("ACGT"[x >> 29])
        return out

    a, b, c, d = (draw(n) for n in (5000, 4000, 3000, 600))
    r, s = a[2000:2300], a[3000:3500]
    b[1000:1300] = r
    b[2000:2500] = [dict(zip("ACGT", "CGTA", strict=True))[y] if i % 20 == 10 else y for i, y in enumerate(s)]
    c[500:620], c[1500:1540], c[2200:2250] = list("AC" * 60), list("N" * 40), list("A" * 50)
    d[100:400] = list(kernels.revcomp("".join(r)))
    return ["".join(t) for t in (a, b, c, d)]


GENOME = genome()
LENGTHS = dict(enumerate(map(len, GENOME)))


@pytest.fixture(scope="module")
def ref(spark, tmp_path_factory):
    rows = [("g", i, f"ctg{i + 1}", None, g) for i, g in enumerate(GENOME)]
    made = index.build(spark.createDataFrame(rows, "path string, ix long, name string, comment string, seq string"))
    return made.write(str(tmp_path_factory.mktemp("index")), files=4)


def test_index(ref):
    assert [(r.rid, r.name, r.len, r.offset) for r in ref.contigs.orderBy("rid").collect()] == [(0, "ctg1", 5000, 0), (1, "ctg2", 4000, 5000), (2, "ctg3", 3000, 9000), (3, "ctg4", 600, 12000)]
    assert [tuple(r) for r in ref.holes.collect()] == [(2, 1500, 40)]
    mers = {}
    for rid, g in enumerate(GENOME):
        for rev, t in enumerate((g, kernels.revcomp(g))):
            for i in range(len(t) - 18):
                if "N" not in t[i : i + 19]:
                    mers.setdefault(t[i : i + 19], []).append((rid, rev, i))
    assert {(r.kmer, r.rid, r.rev, r.rpos) for r in ref.kmers.collect()} == {(k, *p) for k, ps in mers.items() for p in ps}
    jump = {r.kmer: (r.n, tuple(r["first"])) for r in ref.jump_table(3).collect()}
    for n in (1, 3):
        for some in map("".join, itertools.product("ACGT", repeat=n)):
            at = [p for k, ps in mers.items() if k.startswith(some) for p in ps]
            assert jump.get(some) == ((len(at), min(at)) if at else None)


def test_slices(spark, ref):
    rng = random.Random(4)
    jobs = [(i, rng.randrange(4), rng.randrange(2), b := rng.randrange(-50, 590), b + rng.randrange(1, 2500)) for i in range(40)]
    got = {r.i: r.text for r in index.slices(spark.createDataFrame(jobs, "i long, rid int, rev int, rb long, re long"), ref, "i").collect()}
    for i, rid, rev, b, e in jobs:
        strand = kernels.revcomp(GENOME[rid]) if rev else GENOME[rid]
        assert got.get(i, "") == strand[max(b, 0) : max(e, 0)]


def occurrences(s):
    return sum(t.startswith(s, i) for g in GENOME for t in (g, kernels.revcomp(g)) for i in range(len(t) - len(s) + 1)) if "N" not in s else 0


def test_three_rounds(spark):
    """All rounds against counting every substring, over a small reference of two letters and both strands."""
    rng = random.Random(12)
    word = lambda n, letters="AC": "".join(rng.choice(letters) for _ in range(n))
    core = word(40, "ACGT")
    texts = [word(60) + core + word(20) + core[:30], core[10:] + word(50) + "N" + core, word(30, "ACGT")]
    reads = [(i, t) for i, t in enumerate([core, word(25) + core[5:30] + word(10), texts[0][30:90], core[:15] + "N" + core[16:], word(40, "ACGT"), kernels.revcomp(texts[1][20:80]), "AC", ""])]
    k, split_len, width, most = 5, 8, 4, 3
    strands = [t for g in texts for t in (g, kernels.revcomp(g))]
    count = lambda s: sum(t.startswith(s, i) for t in strands for i in range(len(t) - len(s) + 1)) if "N" not in s else 0
    frame = spark.createDataFrame([("p", i, f"c{i}", "", t) for i, t in enumerate(texts)], "path string, ix long, name string, comment string, seq string")
    ref = index.build(frame, k)
    df = spark.createDataFrame(reads, "read_id long, seq string")
    mems = seeding.matches(df, ref.kmers, k).persist()
    first = seeding.maximal(mems)
    want1, want2, want3 = set(), set(), set()
    for key, t in reads:
        def longest(least, t=t):
            out = {}
            for b in range(len(t)):
                e = b
                while e < len(t) and count(t[b : e + 1]) >= least:
                    e += 1
                if e - b >= k and e > out.get(b - 1, 0) and all(x < e for x in out.values()):
                    out[b] = e
            return out

        for b, e in longest(1).items():
            s = count(t[b:e])
            want1.add((key, b, e, s))
            if e - b >= split_len and s <= width:
                mid = (b + e) >> 1
                want2 |= {(key, b2, e2) for b2, e2 in longest(s + 1).items() if b2 <= mid < e2}
        x = 0
        while x + k < len(t):
            e = x
            while e < len(t) and t[e] != "N" and not (e - x >= k + 1 and count(t[x:e]) < most):
                e += 1
            if e - x >= k + 1 and count(t[x:e]) < most:
                if count(t[x:e]):
                    want3.add((key, x, e))
                x = e
            elif e < len(t):
                x = e + 1
            else:
                break
    assert {tuple(r) for r in first.collect()} == want1
    assert {tuple(r) for r in seeding.reseeded(mems, first, k, split_len, width).collect()} == want2
    assert {tuple(r) for r in seeding.walked(df, mems, k, most).collect()} == want3
    assert want2 and want3
    spots = seeding.places(first.select("read_id", "qbeg", "qend"), mems).collect()
    assert {(r.read_id, r.qbeg, r.qend, r.rid, r.rev, r.rbeg) for r in spots} == {(key, b, e, i // 2, i % 2, p) for key, b, e, _ in want1 for i, s in enumerate(strands) for p in range(len(s)) if s.startswith(reads[key][1][b:e], p)}


def simulated(rng, n, length=100, insert=300):
    out = []
    for i in range(n):
        rid = rng.choice((0, 0, 1))
        g = GENOME[rid]
        size = insert + rng.randrange(-40, 41)
        at = rng.choice([x for x in range(len(g) - size) if "N" not in g[x : x + size]])
        one, two = g[at : at + length], kernels.revcomp(g[at + size - length : at + size])
        flip = rng.random() < 0.5
        out.append((i, rid, at, size, *((two, one) if flip else (one, two)), flip))
    return out


def changed(rng, s, n):
    s = list(s)
    for i in rng.sample(range(5, len(s) - 5), n):
        s[i] = rng.choice([c for c in "ACGT" if c != s[i]])
    return "".join(s)


def test_pairs_end_to_end(spark, ref):
    rng = random.Random(5)
    sims = simulated(rng, 60)
    rows = []
    for i, _, _, _, one, two, _ in sims:
        for m, s in ((1, one), (2, two)):
            rows.append((2 * i + m - 1, i, m, f"r{i}", None, changed(rng, s, 2), "I" * 100))
    damaged = changed(rng, "".join(rng.choice("ACGT") for _ in range(100)), 1)
    rows += [(200, 100, 1, "half", "c", GENOME[0][100:200], None), (201, 100, 2, "half", "c", damaged, None)]
    weak = "".join(c if i % 12 else rng.choice("ACGT".replace(c, "")) for i, c in enumerate(kernels.revcomp(GENOME[0][4300:4400])))
    rows += [(202, 101, 1, "saved", None, GENOME[0][4100:4200], None), (203, 101, 2, "saved", None, weak, None)]
    reads = spark.createDataFrame(rows, "read_id long, pair_id long, mate int, name string, comment string, seq string, qual string")
    lines = [(r.read_id, r.rec_ix, r.line.split("\t")) for r in flow.align(reads, ref).orderBy("read_id", "rec_ix").collect()]
    first = {i: f for i, k, f in lines if k == 0}
    assert len(first) == len(rows)
    for i, rid, at, size, _, _, flip in sims:
        a, b = first[2 * i], first[2 * i + 1]
        left, right = (b, a) if flip else (a, b)
        unique = all(int(x[4]) >= 20 for x in (a, b))
        if unique:
            assert (left[2], int(left[3]), int(right[3])) == (f"ctg{rid + 1}", at + 1, at + size - 99), (i, a, b)
            assert int(left[8]) == size == -int(right[8]) and left[5] == right[5] == "100M"
        assert int(a[1]) & 0x41 == 0x41 and int(b[1]) & 0x81 == 0x81
        if unique:
            assert int(a[1]) & 2 and int(b[1]) & 2 and int(right[1]) & 0x10 and int(left[1]) & 0x20
    assert sum(int(first[i][4]) == 60 for i in range(120)) > 90
    assert int(first[200][1]) & 8 and int(first[201][1]) & 4 and first[201][2:4] == ["ctg1", "101"] and first[201][5] == "*"
    saved = first[203]
    assert saved[2] == "ctg1" and 4301 <= int(saved[3]) <= 4313 and int(saved[1]) & 0x10 and int(saved[1]) & 2  # no seed, found from its mate
    tags = dict(x.split(":", 1) for x in first[0][11:])
    assert tags["NM"] == "i:2" and tags["MC"] == "Z:100M" and tags["AS"] == "i:90" and set(tags) >= {"MD", "MQ", "XS", "HN"}


def test_single_end_and_options(spark, ref):
    r, s = GENOME[0][2050:2150], GENOME[0][3100:3200]
    gone = GENOME[2][1000:1050] + GENOME[2][1056:1110]
    more = GENOME[1][300:350] + "GATTACA" + GENOME[1][350:400]
    split = GENOME[0][700:780] + kernels.revcomp(GENOME[2][1800:1860])
    rows = [(0, "repeat", r), (1, "twin", s), (2, "del", gone), (3, "ins", kernels.revcomp(more)), (4, "split", split), (5, "none", "ACGT" * 3), (6, "empty", "")]
    reads = spark.createDataFrame([(i, i, 0, n, "BC:Z:x", t, "".join(chr(33 + k % 40) for k in range(len(t)))) for i, n, t in rows], "read_id long, pair_id long, mate int, name string, comment string, seq string, qual string")
    got = {}
    for x in flow.align(reads, ref, options(comment=True, read_group="@RG\\tID:g1\\tSM:s")).orderBy("read_id", "rec_ix").collect():
        got.setdefault(x.read_id, []).append(x.line.split("\t"))
    tag = lambda f, k: next((x.split(":", 2)[2] for x in f[11:] if x.startswith(k + ":")), None)
    (one,) = got[0]
    assert one[4] == "0" and tag(one, "AS") == tag(one, "XS") == "100" and tag(one, "HN") == "2" and tag(one, "XA").count(";") == 2
    places = {("ctg1", 2050, "+"), ("ctg2", 1050, "+"), ("ctg4", 250, "-")}
    named = {(one[2], int(one[3]) - 1, "-" if int(one[1]) & 16 else "+")} | {(x.split(",")[0], int(x.split(",")[1][1:]) - 1, x.split(",")[1][0]) for x in tag(one, "XA").split(";")[:-1]}
    assert named == places
    (two,) = got[1]
    assert two[2:5] == ["ctg1", "3101", "60"] and tag(two, "AS") == "100"  # the copy has no seed that outlasts the chain filter
    assert got[2][0][3:6:2] == ["1001", "50M6D54M"] and tag(got[2][0], "NM") == "6" and tag(got[2][0], "MD") == f"50^{GENOME[2][1050:1056]}54"
    assert got[3][0][3] == "301" and int(got[3][0][1]) & 16 and got[3][0][5].count("I") == 1 and tag(got[3][0], "NM") == "7"
    main, extra = got[4]
    assert main[2:6] == ["ctg1", "701", main[4], "80M60S"] and extra[2:4] == ["ctg3", "1801"] and extra[5] == "60M80H" and int(extra[1]) == 0x810
    assert len(extra[9]) == 60 and tag(main, "SA").startswith("ctg3,1801,-,60M80S,") and tag(extra, "SA").startswith("ctg1,701,+,80M60S,")
    for i in (5, 6):
        assert got[i][0][1:6] == ["4", "*", "0", "0", "*"]
    assert all(f[-1] == "BC:Z:x" and tag(f, "RG") == "g1" for x in got.values() for f in x)
    soft = flow.align(reads.where("read_id = 4"), ref, options(soft_clip=True, split_secondary=True)).orderBy("rec_ix").collect()[1].line.split("\t")
    assert soft[5] == "60M80S" and int(soft[1]) & 0x100


def test_extension_and_global_against_full_tables():
    rng = random.Random(7)
    s = kernels.Scores.of(options(zdrop=0))
    for _ in range(60):
        t = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 24)))
        q = changed_text(rng, t) or "A"
        qc, tc = kernels.encoded(q), kernels.encoded(t)
        n, m, low = len(q), len(t), -(10**6)
        h = [[low] * (n + 1) for _ in range(m + 1)]
        mm, e, f = ([[low] * (n + 1) for _ in range(m + 1)] for _ in range(3))
        h[0][0] = mm[0][0] = 0
        for i in range(m + 1):
            for j in range(n + 1):
                if i:
                    e[i][j] = max(e[i - 1][j], h[i - 1][j] - 6) - 1
                if j:
                    f[i][j] = max(f[i][j - 1], h[i][j - 1] - 6) - 1
                if i and j:
                    mm[i][j] = h[i - 1][j - 1] + (1 if q[j - 1] == t[i - 1] else -4)
                h[i][j] = max(h[i][j], mm[i][j], e[i][j], f[i][j])
        score, cigar = kernels.aligned(qc, tc, s)
        assert score == h[m][n]
        assert sum(k for op, k in cigar if op in "MI") == n and sum(k for op, k in cigar if op in "MD") == m
        i = j = walked = 0
        for op, k in cigar:
            walked += sum(1 if q[j + x] == t[i + x] else -4 for x in range(k)) if op == "M" else -6 - k
            i, j = i + k * (op != "I"), j + k * (op != "D")
        assert walked == score
        ext = kernels.extend(qc, tc, s, 50, 100)
        # with a start that nothing can use up, adjacent gaps of both kinds apart, scores are those of the full table
        best = max(h[i][j] for i in range(m + 1) for j in range(n + 1))
        assert 50 <= ext.score <= 50 + best and (ext.score == 50 + best or best < 3)
        assert h[ext.target][ext.query] >= ext.score - 50


def changed_text(rng, t):
    out = []
    for c in t:
        x = rng.random()
        out += [] if x < 0.05 else [c, rng.choice("ACGT")] if x < 0.1 else [rng.choice("ACGT")] if x < 0.2 else [c]
    return "".join(out)


def test_local_second_and_starts():
    s = kernels.Scores.of(OPT)
    unit = "ACGTTGCAAGCTTAGGCATCGATTACGGCA"
    t = "TTTT" + unit + "GGGGGGGGGGGGGGGGGGGG" * 3 + unit[:20] + "CC"
    hit = kernels.local(kernels.encoded(unit), kernels.encoded(t), s, 19)
    assert (hit.score, hit.qb, hit.qe, hit.tb, hit.te, hit.second) == (30, 0, 30, 4, 34, 20)
    assert kernels.local(kernels.encoded("AAAA"), kernels.encoded("CCCC"), s).score == 0


def test_gaps_are_leftmost():
    s = kernels.Scores.of(OPT)
    q, t = "GATTACAGATC" + "A" * 5 + "CGTTGCATGCA", "GATTACAGATC" + "A" * 8 + "CGTTGCATGCA"
    assert kernels.aligned(kernels.encoded(q), kernels.encoded(t), s)[1] == [("M", 11), ("D", 3), ("M", 16)]
    assert kernels.edits(q, t, [("M", 11), ("D", 3), ("M", 16)]) == (3, "11^AAA16")
    assert kernels.edits("ACGA", "ACTA", [("M", 4)]) == (1, "2T1")


def test_chains():
    line = [Seed(0, 0, 1000 + x, x, 20) for x in (0, 30, 60)]
    assert [len(c.seeds) for c in chains.chained([*line, Seed(0, 0, 1005, 5, 10), Seed(0, 0, 9000, 70, 20), Seed(0, 1, 1090, 90, 20)], OPT)] == [3, 1, 1]
    assert [len(c.seeds) for c in chains.chained([Seed(0, 0, 100, 0, 20), Seed(0, 0, 300, 30, 20)], OPT)] == [1, 1]  # 170 apart on the diagonals
    assert len(chains.chained([Seed(0, 0, 100, 0, 20), Seed(0, 0, 100 + 20_100, 20_000, 20)], options(seed=19))) == 2
    (c,) = chains.chained([Seed(0, 0, 0, 0, 20), Seed(0, 0, 10, 10, 20), Seed(0, 0, 55, 50, 20)], OPT)
    assert chains.weight(c) == 50
    heavy, light, apart = ([chains.Chain([Seed(0, 0, p, q, n)])][0] for p, q, n in ((0, 0, 100), (5000, 10, 30), (9000, 110, 30)))
    assert [(c.w, c.kept) for c in chains.filtered([light, heavy, apart], OPT)] == [(100, 3), (30, 1), (30, 3)]  # the first one shadowed is promoted
    second = chains.Chain([Seed(0, 0, 7000, 20, 29)])
    assert [(c.w, c.kept) for c in chains.filtered([light, heavy, second], OPT)] == [(100, 3), (30, 1)]
    assert chains.filtered([light], options(min_weight=60)) == [] and chains.filtered([light], options(min_weight=60, profile="second")) == [light]
    some = [chains.Chain([Seed(0, 0, 0, 0, n)], w=n) for n in (50, 100, 96, 94)]
    assert [[c.w for c in x] if isinstance(x, list) else x for x in chains.capped(some, options(cap_chains=3))] == [[100, 96, 94], 50]
    assert [[c.w for c in x] if isinstance(x, list) else x for x in chains.capped(some, options(cap_chains=4, tie_frac=0.95, tie_floor=1))] == [[100, 96], 94]
    assert [s.size for s in chains.without_short_seeds(chains.Chain([Seed(0, 0, 0, 0, n) for n in (19, 35, 29)]), options(min_ext_len=30)).seeds] == [35]
    assert chains.concordant(chains.Chain([Seed(0, 0, 100, 0, 20)]), [chains.Chain([Seed(0, 1, 599, 0, 20)])], {0: 1000}, 300) and not chains.concordant(chains.Chain([Seed(0, 0, 100, 0, 20)]), [chains.Chain([Seed(0, 0, 400, 0, 20)])], {0: 1000}, 300)


def test_seed_orders():
    s = [Seed(0, 0, 0, 0, 20), Seed(0, 0, 5, 5, 10), Seed(0, 0, 100, 0, 30), Seed(1, 0, 5, 5, 10), Seed(0, 0, 5, 5, 10)]
    assert [chains.absorbs(s[0], 0, x, j) for j, x in enumerate(s)][1:] == [True, False, False, True]
    assert chains.absorbs(s[1], 1, s[4], 4) and not chains.absorbs(s[4], 4, s[1], 1)
    ids = lambda x: [next(i for i, y in enumerate(s) if y is z) for z in x]
    assert ids(chains.ordered(s, "global-longest")) == [2, 0, 1, 3, 4] and ids(chains.ordered(s, "local-longest")) == [2, 0, 1, 3, 4]
    assert ids(chains.ordered(s, "absorb-count")) == [0, 1, 2, 3, 4] and ids(chains.ordered(s, "most-absorb")) == [0, 1, 4, 2, 3]
    assert [x.size for x in chains.pruned([Seed(0, 0, 0, 0, n, h) for n, h in ((40, 3), (25, 9), (22, 1), (22, 2), (21, 1))])] == [40, 25, 22]
    assert len(chains.pruned([Seed(0, 0, 0, 0, n) for n in (29, 19)])) == 2


def region(score, qb, qe, rb=0, **more):
    return Region(0, 0, rb, rb + qe - qb, qb, qe, score, **more)


def test_dedup_and_patch():
    a, b = region(90, 0, 100, 1000), region(95, 1, 100, 1001)
    assert [r.score for r in regions.deduped([a, b], OPT)] == [95]
    assert len(regions.deduped([region(90, 0, 100, 1000), region(90, 0, 100, 1200)], OPT)) == 2
    assert [r.rb for r in regions.deduped([region(90, 0, 100, 1000), Region(0, 0, 1001, 1100, 0, 100, 90)], OPT)] == [1001]  # of equal ones the later stays
    text = GENOME[0][1000:1200]
    query = text[:97] + "".join(dict(zip("ACGT", "CGTA", strict=True))[c] for c in text[97:100]) + text[100:]
    one, two = region(97, 0, 97, 1000, w=100), region(100, 100, 200, 1100, w=100)
    (joined,) = regions.deduped([one, two], OPT, query, lambda rid, rev, rb, re: GENOME[0][rb:re])
    assert (joined.rb, joined.re, joined.qb, joined.qe, joined.score, joined.joined) == (1000, 1200, 0, 200, 197 - 12, 1)
    assert regions.patched(one, region(100, 100, 200, 1400, w=100), query, GENOME[0][1000:1500], OPT) == (0, 0)


def test_mix_and_primaries():
    def mix(k):
        w = 2**64
        k = (k + ~(k << 32)) % w
        k ^= k >> 22
        k = (k + ~(k << 13)) % w
        k ^= k >> 8
        k = (k + (k << 3)) % w
        k ^= k >> 15
        k = (k + ~(k << 27)) % w
        return k ^ k >> 31

    rng = random.Random(1)
    assert all(regions.mixed(k) == mix(k) for k in [0, 1, 2**64 - 1, *(rng.getrandbits(64) for _ in range(50))])
    a, n = regions.marked([region(80, 0, 100), region(100, 0, 100), region(96, 10, 90), region(50, 95, 160)], OPT, 7)
    assert n == 4 and [(r.score, r.secondary, r.sub, r.sub_n) for r in a] == [(100, -1, 96, 1), (96, 0, 0, 0), (80, 0, 0, 0), (50, -1, 0, 0)]
    ties = [region(90, 0, 100, p) for p in (0, 1000, 2000)]
    want = sorted(range(3), key=lambda i: mix(5 + i))
    assert [r.rb // 1000 for r in regions.marked(ties, OPT, 5)[0]] == want
    a, n = regions.marked([region(100, 0, 100, is_alt=True), region(90, 0, 100)], OPT, 0)
    assert n == 1 and [(r.is_alt, r.secondary, r.secondary_all, r.alt_sc, r.sub) for r in a] == [(False, -1, 1, 100, 0), (True, -1, -1, 0, 90)]
    assert [r.qb for r in regions.reordered([region(90, 50, 150), region(60, 0, 60)], OPT)] == [0, 50]


@pytest.mark.parametrize("case", [((100, 0, 100, 0, 0.0), 60), ((20, 0, 20, 0, 0.0), 6), ((100, 90, 100, 0, 0.0), 26), ((100, 90, 100, 2, 0.0), 21), ((100, 90, 100, 2, 0.25), 16), ((100, 90, 100, 0, 0.25), 19), ((50, 45, 50, 0, 0.0), 18), ((90, 85, 110, 0, 0.0), 11)])
def test_mapq(case):
    (score, sub, span, n, rep), want = case
    assert regions.mapq(region(score, 0, span, sub=sub, sub_n=n, frac_rep=rep), OPT) == want


def test_insert_model():
    rng = random.Random(3)
    sizes = [rng.gauss(300, 20) for _ in range(500)] + [5000.0] * 3
    counts = {}
    for x in sizes:
        counts[1, int(x)] = counts.get((1, int(x)), 0) + 1
    counts[0, 100] = 9
    fit = pairs.fitted(counts)
    flat = sorted(int(x) for x in sizes)
    p25, p50, p75 = (flat[int(p * len(flat) + 0.499)] for p in (0.25, 0.5, 0.75))
    low, high = int(p25 - 2 * (p75 - p25) + 0.499), int(p75 + 2 * (p75 - p25) + 0.499)
    inner = [x for x in flat if low <= x <= high]
    assert [m.failed for m in fit] == [True, False, True, True] and math.isclose(fit[1].mean, np.mean(inner)) and math.isclose(fit[1].std, np.std(inner))
    assert fit[1].low == min(int(p25 - 3 * (p75 - p25) + 0.499), int(fit[1].mean - 4 * fit[1].std + 0.499))
    assert pairs.given((300, 30))[1] == pairs.Insert(180, 420, False, 300, 30)


def test_best_pair_against_all_pairs():
    rng = random.Random(6)
    models = pairs.given((300, 30))
    models[0] = pairs.Insert(50, 200, False, 120, 40)
    for trial in range(60):
        a = []
        for _ in (0, 1):
            end = []
            for _ in range(rng.randint(1, 6)):
                rid, rev, at = rng.randrange(2), rng.randrange(2), rng.randrange(800)
                end.append(Region(rid, rev, at, at + 100, 0, 100, rng.randint(40, 100)))
            a.append(end)
        hits = sorted((r.rid, r.rb if not r.rev else LENGTHS[r.rid] - 1 - r.rb, r.score, i, r.rev, e) for e in (0, 1) for i, r in enumerate(a[e]))
        want = []
        for i, k in itertools.combinations(range(len(hits)), 2):
            x, y = hits[i], hits[k]
            if x[0] == y[0] and x[5] != y[5]:
                m, d = models[x[4] << 1 | y[4]], y[1] - x[1]
                if not m.failed and m.low <= d <= m.high:
                    want.append((pairs.pair_score(x[2], y[2], d, m, OPT), regions.mixed((i << 32 | k) ^ trial << 8) & 0xFFFFFFFF, i, k))
        got = pairs.best_pair(a, [len(x) for x in a], models, LENGTHS, OPT, trial)
        if not want:
            assert got == (0, 0, 0, (0, 0))
            continue
        want.sort()
        q, _, i, k = want[-1]
        ends = {hits[x][5]: hits[x][3] for x in (i, k)}
        sub = want[-2][0] if len(want) > 1 else 0
        assert got == (q, sub, sum(sub - w[0] <= 7 for w in want[:-1]), (ends[0], ends[1]))


def test_pair_score_and_orientation():
    m = pairs.given((300, 30))[1]
    assert pairs.pair_score(100, 100, 300, m, OPT) == int(200 + 0.721 * math.log(2) + 0.499) and pairs.pair_score(100, 100, 10**6, m, OPT) == 0 and pairs.pair_score(-1, 50, 300, m, OPT) == 0
    f, r = lambda p: Region(0, 0, p, p + 100, 0, 100, 100), lambda p: Region(0, 1, 1000 - p - 100, 1000 - p, 0, 100, 100)
    assert pairs.orientation(f(100), r(300), 1000) == (1, 299) and pairs.orientation(r(300), f(100), 1000) == (1, 299)
    assert pairs.orientation(f(300), r(100), 1000) == (2, 101) and pairs.orientation(f(0), f(50), 1000) == (0, 50) and pairs.orientation(f(50), f(0), 1000) == (3, 50)


def test_paired_qualities():
    lengths = {0: 100_000}
    f, r = lambda p, s=100, **m: Region(0, 0, p, p + 100, 0, 100, s, **m), lambda p, s=100, **m: Region(0, 1, 100_000 - p - 100, 100_000 - p, 0, 100, s, **m)
    models = pairs.given((300, 30))
    done = pairs.resolved([[f(1000)], [r(1200)]], [1, 1], models, lengths, OPT, 0)
    assert done.paired and done.flag == 3 and done.quality == (60, 60)
    far = pairs.resolved([[f(1000)], [r(9000)]], [1, 1], models, lengths, OPT, 0)
    assert not far.paired and not pairs.proper(f(1000), r(9000), models, lengths) and pairs.proper(f(1000), r(1200), models, lengths)
    # an end of two equal hits is decided by the other one
    ends = [regions.marked([f(1000), f(50_000)], OPT, 2)[0], [r(1200)]]
    twin = pairs.resolved(ends, [2, 1], models, lengths, OPT, 1)
    assert twin.paired and ends[0][twin.places[0]].rb == 1000 and twin.quality[0] == min(40, regions.raw_mapq(17, OPT))


def test_rescue():
    rng = random.Random(2)
    models = pairs.given((300, 30))
    mate = kernels.revcomp(GENOME[0][4300:4400])
    weak = "".join(c if i % 12 else rng.choice("ACGT".replace(c, "")) for i, c in enumerate(mate))
    anchor = Region(0, 0, 4100, 4200, 0, 100, 100)
    (w,) = pairs.windows(anchor, [], 100, models, LENGTHS, OPT)
    assert (w.way, w.turned, w.rb, w.re) == (1, True, 4100 + 180 - 100, 4100 + 420)
    strand = [GENOME[0], kernels.revcomp(GENOME[0])]
    a = pairs.with_rescues([[anchor], []], [GENOME[0][4100:4200], weak], models, LENGTHS, OPT, lambda rid, rev, b, e: strand[rev][b:e])
    (hit,) = a[1]
    assert (hit.rev, 5000 - hit.re, 5000 - hit.rb) == (1, 4300 + 100 - hit.qe, 4400 - hit.qb) and hit.score >= 19 and hit.ref == strand[1][hit.rb : hit.re]
    assert pairs.windows(anchor, [hit], 100, models, LENGTHS, OPT) == []
    assert pairs.with_rescues([[anchor], []], ["", weak], models, LENGTHS, options(no_rescue=True), None)[1] == []
    assert pairs.narrowed(mate, strand[1], 12) == (600 - 50, 700 + 50) and pairs.narrowed("ACGT" * 5, "T" * 60, 6) is None
    assert pairs.declined(9, 95) and not pairs.declined(10, 95) and not pairs.declined(9, 20)


def test_alt():
    rids, lengths = {"p": 0, "alt": 1, "bad": 2}, {0: 1000, 1: 210, 2: 50}
    lines = ["@HD", "alt\t0\tp\t101\t60\t100M10I100M\t*\t0\t0\t*\t*", "alt\t0\tp\t1\t60\t210M\t*\t0\t0\t*\t*", "bad\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*", "who\t0\tp\t1\t1\t5M"]
    alts, lifts, skipped = alt.sidecar(lines, rids, lengths)
    assert alts == {1, 2} and skipped == {"again": 1, "unmapped": 1, "contig": 1} and lifts[1].at == 100
    assert alt.lifted(lifts[1], 10, 60) == alt.Lifted(0, 0, 110, 160, 50, 0, 0, False)
    over = alt.lifted(lifts[1], 50, 160)
    assert (over.begin, over.end, over.aligned, over.widest, over.edge) == (150, 250, 100, 10, False) and alt.lifted(lifts[1], 50, 105).edge
    turned = alt.Lift(0, 1, 100, 210, (("M", 210),))
    assert (alt.lifted(turned, 0, 10).begin, alt.lifted(turned, 0, 10).end) == (300, 310)
    on_alt, primary = Region(1, 0, 10, 60, 0, 50, 50, is_alt=True), Region(0, 0, 110, 160, 0, 50, 40)
    (kept,) = alt.project([on_alt, primary], lifts, lengths, OPT)
    assert (kept.rid, kept.rb, kept.is_alt, kept.lifted_from) == (0, 110, False, 1)
    (tie,) = alt.project([Region(1, 0, 10, 60, 0, 50, 40, is_alt=True), primary], lifts, lengths, OPT)
    assert tie.lifted_from == -1
    elsewhere = Region(0, 0, 700, 750, 0, 50, 48)
    assert len(alt.project([on_alt, elsewhere], lifts, lengths, options(project_gap=1))) == 2
    assert all(r.lifted_from < 0 for r in alt.project([on_alt, elsewhere], lifts, lengths, options(project_gap=2)))
    left, best = alt.without_unlifted([on_alt, primary], OPT)
    assert left == [primary] and best.score == 50


def test_methylation():
    contig = "ACGTCAGTCTTCGN"
    assert methylation.calls(contig, 0, True, [("M", 14)], contig) == ".Z..X...H..Z.."
    read = contig.replace("C", "T")
    assert methylation.calls(contig, 0, True, [("M", 14)], read) == ".z..x...h..z.."
    assert methylation.calls(contig, 0, True, [("M", 14)], read, "taps") == ".Z..X...H..Z.."
    assert methylation.calls(contig, 0, False, [("M", 13)], contig[:13])[2] == "Z" and methylation.calls(contig, 0, True, [("S", 2), ("M", 2), ("D", 1), ("M", 3)], "GGACAGT") == "...Z..."
    assert methylation.calls("AC", 0, True, [("M", 2)], "AC") == ".U"
    assert methylation.projected("ACGTc", 1) == "ATGTT" and methylation.projected("ACGTg", 2) == "ACATA"
    assert methylation.contigs("x", "acg") == [("rx", "ACA"), ("fx", "ATG")] and methylation.original("fx") == ("x", "f")
    m = methylation.matrices(1, 4)
    assert m["f"][1, 3] == 1 and m["f"][3, 1] == -4 and m["r"][2, 0] == 1 and methylation.matrices(1, 4, "collapsed")["f"][3, 1] == 1 and methylation.matrices(1, 4, "neutral")["f"][1, 3] == 0
    assert methylation.unlabelled(methylation.labelled("acgNcNg")) == "ACGNCNG" and methylation.labelled("acg") == "A56"
    assert methylation.tags(2, "f", "z.", ("XR", "XG", "XM")) == ["XR:Z:GA", "XG:Z:CT", "XM:Z:z."]
    seeds = [Seed(rid, rev, 5, 0, 20) for rid in (0, 1) for rev in (0, 1)]
    told = methylation.remapped(seeds, {0: "rx", 1: "fx"}, {"x": 7}, 1)
    assert [(s.rid, s.rev, chain) for s, chain in told] == [(7, 1, "r"), (7, 0, "f")]
    assert methylation.checked(3, 60, "40M60S", 100, "f", chimera=True) == (0x201, 1) and methylation.checked(3, 60, "44M56S", 100, "f", chimera=True) == (3, 60)
    assert methylation.checked(1, 9, "9M", 9, "r", "r") == (0x201, 9) and methylation.spread_failure([0x203, 3]) == [0x201, 0x201]


def test_header_and_profiles():
    contigs = [("a", 10, False), ("b", 5, True)]
    assert records.header(contigs, OPT)[:3] == ["@HD\tVN:1.5\tSO:unsorted\tGO:query", "@SQ\tSN:a\tLN:10", "@SQ\tSN:b\tLN:5\tAH:*"]
    got = records.header(contigs, options(read_group="@RG\\tID:x"), ["@HD\tVN:1.6\n", "@SQ\tSN:a\tLN:10\tM5:z", "@CO\tone"], ["@CO\\ttwo"])
    assert got == ["@HD\tVN:1.6", "@SQ\tSN:a\tLN:10\tM5:z", "@CO\tone", "@CO\ttwo", "@RG\tID:x", got[-1]] and got[-1].startswith("@PG")
    assert records.header(contigs, options(profile="second"))[0].startswith("@SQ")
    for bad in ("RG\\tID:x", "@RG\\tSM:x", "@RG\\tID:" + "x" * 256):
        with pytest.raises(ValueError):
            records.group_id(bad)


def test_records():
    names, read = {0: "c0", 1: "c1"}, records.Read("r", "ACGTACGT", "ABCDEFGH")
    hit = lambda **m: records.Hit(**{"rid": 0, "pos": 9, "mapq": 60, "cigar": [("M", 8)], "nm": 0, "md": "8", "score": 8, "sub": 0} | m)
    f = records.fields_of(read, [hit(rev=1)], 0, None, names, OPT)
    assert f == ["r", "16", "c0", "10", "60", "8M", "*", "0", "0", "ACGTACGT", "HGFEDCBA", "NM:i:0", "MD:Z:8", "AS:i:8", "XS:i:0"]
    mate = hit(pos=99, rev=1, mapq=7)
    f = records.fields_of(read, [hit(flag=0x42)], 0, mate, names, OPT)
    assert f[1] == str(0x63) and f[6:9] == ["=", "100", "98"] and "MC:Z:8M" in f and "MQ:i:7" in f
    assert records.fields_of(read, [mate], 0, hit(), names, OPT)[8] == "-98"
    lost = records.fields_of(read, [records.Hit()], 0, hit(rev=1), names, OPT)
    assert lost[1:9] == [str(1 + 4 + 16 + 32), "c0", "10", "0", "*", "=", "10", "0"]
    both = [hit(cigar=[("M", 5), ("S", 3)]), hit(rid=1, cigar=[("S", 5), ("M", 3)], flag=0x800, alt_sc=10)]
    f = records.fields_of(read, both, 1, None, names, OPT)
    assert f[5] == "5H3M" and f[9] == "CGT" and "SA:Z:c0,10,+,5M3S,60,0;" in f and "pa:f:0.800" in f
    assert records.fields_of(read, both, 1, None, names, options(soft_clip=True))[9] == "ACGTACGT"
    assert records.fields_of(read, [hit(), hit(flag=0x100, sub=-1)], 1, None, names, OPT)[9:11] == ["*", "*"]
    assert not any(x.startswith("MQ") for x in records.fields_of(read, [hit()], 0, mate, names, options(profile="second")))


def test_bam(spark, tmp_path):
    import gzip
    import struct

    head = records.header([("c0", 100, False)], OPT)
    lines = ["\t".join(["r1", "16", "c0", "10", "60", "3M1D4M1S", "*", "0", "0", "ACGTACGT", "ABCDEFGH", "NM:i:1", "MD:Z:3^A4", "pa:f:0.5"]), "\t".join(["r0", "4", "*", "0", "0", "*", "*", "0", "0", "ACN", "*"])]
    flow.write_bam(spark.createDataFrame([(1, 0, lines[0]), (0, 0, lines[1])], "read_id long, rec_ix long, line string"), head, str(tmp_path / "b"))
    parts = spark.read.parquet(str(tmp_path / "b")).orderBy("part").collect()
    data = gzip.decompress(b"".join(bytes(p["data"]) for p in parts))
    assert data[:4] == b"BAM\1" and bytes(parts[-1]["data"]) == records.LAST
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    assert data[8:at].decode().splitlines() == head
    at += 4 + 4 + 3 + 4
    seen = []
    while at < len(data):
        size, rid, pos, n_name, mapq, bin_, n_ops, flag, n_seq, mrid, mpos, tlen = struct.unpack_from("<iiiBBHHHiiii", data, at)
        body = data[at + 36 : at + 4 + size]
        ops = [f"{x >> 4}{records.OPS[x & 15]}" for x in struct.unpack_from(f"<{n_ops}I", body, n_name)]
        packed = body[n_name + 4 * n_ops :][: (n_seq + 1) // 2]
        seq = "".join(records.BASES[b >> 4] + records.BASES[b & 15] for b in packed)[:n_seq]
        seen.append((body[: n_name - 1].decode(), flag, rid, pos, mapq, "".join(ops), seq, bin_))
        at += 4 + size
    assert seen == [("r0", 4, -1, -1, 0, "", "ACN", 4680), ("r1", 16, 0, 9, 60, "3M1D4M1S", "ACGTACGT", 4681)]


def test_options():
    o = options(match=2)
    assert (o.mismatch, o.least, o.open_del, o.clip5, o.unpaired) == (8, 60, 12, 10, 34) and options(match=2, mismatch=3).mismatch == 3
    assert options("fast").cap_chains == 20 and options("hic").no_pairing and options().split_len == 28
    for bad in ({"seed": 0}, {"extend_del": 0}, {"profile": "x"}, {"what": 1}):
        with pytest.raises(ValueError):
            options(**bad)


def test_stream(spark, ref, tmp_path):
    from strandline import streaming

    schema = "read_id long, pair_id long, mate int, name string, comment string, seq string, qual string"
    rows = [(i, i, 0, f"s{i}", None, GENOME[0][100 * i : 100 * i + 90], None) for i in range(3)]
    frame = spark.createDataFrame(rows, schema)
    for part in ("read_id = 0", "read_id > 0"):
        frame.where(part).write.mode("append").parquet(str(tmp_path / "in"))
    query = streaming.align_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), ref, str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True)
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() > 1
    assert {(r.read_id, r.line.split("\t")[3]) for r in got.collect()} == {(i, str(100 * i + 1)) for i in range(3)}
