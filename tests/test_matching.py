import random

import pytest
from pyspark.sql import functions as F

from strandline import catalogue
from strandline.align import flow, index
from strandline.operators import kernels, matching, seeding

FOLDED = ["smem_intervals", "smem_dedup", "reseed_intervals", "occ_cap_stride", "distinct_interval_resolve", "seed_order_global", "seed_order_local", "seed_absorb_count", "kmer_diagonal_votes", "round3_walk", "chain_weight", "min_chain_weight", "min_ext_len", "chain_cap_topn", "chain_tie_frac", "capped_sub", "repeat_fraction", "chain_filter", "primary_mark", "region_rank", "region_dedup", "region_emit_filter", "local_sw", "extend_score", "global_cigar"]


def _texts(rng, letters, n, most):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Texts of two letters, of repeats, of parts of the reference; null, empty and short ones."""
    rng, at = random.Random(5), tmp_path_factory.mktemp("matching")
    items = [*_texts(rng, "ab", 5, 120), "x" * 50, "common words and more common words", "", "é𝕏ü" * 9, *_texts(rng, "abcd", 30, 60)]
    items += [rng.choice(items)[:30] + "abcdabcdabcd" + items[-1][:20] for _ in range(30)]
    docs = [None, "", "ab", "x" * 90, "ab" * 60, "é𝕏ü" * 5 + "?" + "é𝕏ü" * 4, items[6] * 3, *_texts(rng, "ab", 10, 300), *_texts(rng, "abcdé", 10, 300)]
    docs += ["".join(rng.choice([*items, "zz", "\n"]) for _ in range(12)) for _ in range(15)]
    spark.createDataFrame([(7 * i + 1, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(99 - i, t) for i, t in enumerate(items)], "item_id long, text string").repartition(2).write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("name", FOLDED)
def test_folds_give_what_the_joins_give(spark, folder, name, monkeypatch):
    got = catalogue.QUERIES[name](spark, folder)
    if name != "distinct_interval_resolve":  # reads are matched and folded where they are read
        assert "Exchange" not in got._jdf.queryExecution().toString()
    rows = sorted(map(repr, got.collect()))
    monkeypatch.setattr(matching, "HELD", 7)
    monkeypatch.setattr(matching, "MOST", -1)
    assert rows and sorted(map(repr, catalogue.QUERIES[name](spark, folder).collect())) == rows


@pytest.mark.parametrize("k", [1, 3, 9, 17, 24, 33])
def test_matches_of_any_length_and_letters(spark, k):
    rng = random.Random(k)
    many = [chr(0x4E00 + i) for i in range(400)]
    for letters in ("ab", [*"ab", *many]):
        items = [*_texts(rng, letters, 4, 50 if k < 3 else 150), "".join(many)]
        docs = [*_texts(rng, letters, 6, 50 if k < 3 else 300), items[0] + items[1] + items[0], "".join(many[50:]), "a"]
        frames = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        rows = sorted(map(tuple, seeding.mem_hits(*frames, k).collect()))
        assert len(rows) == len(set(rows)) and rows == sorted(map(tuple, seeding.joined_hits(*frames, k).collect()))


def test_many_hits_come_in_blocks(monkeypatch):
    f = lambda: matching.Found(__import__("numpy").arange(2), ["a" * 500 + "b", "ba" * 90], __import__("numpy").zeros(2, bool))
    known = matching.Matcher([1, 2], ["a" * 70, "ab" * 40], 5)
    whole = known.find(f())
    monkeypatch.setattr(matching, "HELD", 3)
    parts = known.find(f())
    assert len(whole.b) > 500 and all((getattr(whole, c) == getattr(parts, c)).all() for c in ("b", "r", "n", "row", "item"))
    monkeypatch.setattr(matching, "HELD", 5)
    assert all((x == y).all() for x, y in zip(matching.deduped(whole)[1], matching.deduped(parts)[1], strict=True))


def test_ids_that_repeat_or_are_null_are_joined(spark):
    items = spark.createDataFrame([(1, "abcdefghijkl")], "item_id long, text string")
    for ids in ((1, 1), (None, 2)):
        docs = spark.createDataFrame(list(zip(ids, ("abcdefghij", "--cdefghijkl"), strict=True)), "doc_id long, text string")
        assert matching.per_read(docs, items, 8, matching.mems, "item_id, qbeg, qend, rbeg, len") is None
        assert seeding.mem_hits(docs, items, 8).count() == seeding.joined_hits(docs, items, 8).count() > 0
    assert matching.matcher(items.union(items), 8) is None and matching.matcher(items, 8).k == 8


def test_best_local_alignments_against_whole_tables():
    np = __import__("numpy")
    rng = random.Random(9)
    items = _texts(rng, "ab", 8, 90) + _texts(rng, "abcd", 8, 120)
    change = lambda t: "".join(rng.choice((c, c, c, c, c, c, c, c, c, c, c, rng.choice("abcd"), "", c + rng.choice("abcdab"))) for c in t)
    docs = [change("".join(rng.choice(items)[rng.randint(0, 20) :] for _ in range(4))) for _ in range(40)]
    ids = list(range(len(items)))
    found = matching.Matcher(ids, items, 10).find(matching.Found(np.arange(len(docs)), docs, np.zeros(len(docs), bool)))
    row, columns = matching.local(found, matching.Matcher(ids, items, 5))
    got = {(d, i): told for d, i, *told in zip(row.tolist(), *(c.tolist() for c in columns), strict=True)}
    assert len(got) > 200 and set(got) == set(zip(found.row.tolist(), found.item.tolist(), strict=True))
    assert got == {(d, i): list(kernels.local_score(docs[d], items[i])) for d, i in got}


def test_reads_meet_a_small_index_where_they_are_read(spark):
    rng = random.Random(12)
    contigs = [t + "NNN" + t[:40] + "RN" for t in _texts(rng, "ACGT", 4, 1500)]
    refs = spark.createDataFrame([("f", i, f"c{i}", "", t) for i, t in enumerate([*contigs, ""])], "path string, ix long, name string, comment string, seq string")
    ref = index.build(refs, 9)
    turned = lambda t: t[::-1].translate(str.maketrans("ACGT", "TGCA"))
    cut = lambda t: t[(i := rng.randint(0, len(t))) : i + rng.randint(0, 90)]
    seqs = [cut(rng.choice([t, turned(t), t.lower(), t + "".join(contigs)])) + rng.choice(["", "N", "NNN", "\U0010ffff", "ß"]) for t in contigs for _ in range(30)]
    rows = [(i, t) for i, t in enumerate([*seqs, "", None, "ACG", "N" * 30, "\U0010ffff" * 30])]
    key = ["read_id", "rid", "rev", "qbeg", "qend", "rbeg"]
    for more, tags in (([], True), ([(3, seqs[0])], False), ([(None, seqs[1])], False)):
        reads = spark.createDataFrame(rows + more, "read_id long, seq string").repartition(3)
        got, some = flow._matched(reads, ref)
        want = seeding.matches(reads.select("read_id", F.upper("seq").alias("seq")), ref.kmers, 9).select(*key)
        assert ("Join" not in got._jdf.queryExecution().optimizedPlan().toString()) and sorted(map(repr, got.select(*key).collect())) == sorted(map(repr, want.collect()))
        with_any = {r.read_id for r in want.collect()}
        kept = {(r.read_id, r.seq) for r in some.select("read_id", "seq").collect()}
        assert kept >= {r for r in rows + more if r[0] in with_any} and (not tags or len(kept) == len(with_any) > 50)


def test_reads_are_cut_from_the_letters(spark):
    texts = ["Kelvin \u212a \u0130stanbul \xdf\u017f ACGT acgt \x00", "", None, "...", "abc" * 80, "z" * 120, "é" * 200 + "q"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "abc")], "doc_id long, text string")
    want = {(d, n, x) for d, t in docs.select("doc_id", catalogue._bases(F.col("text"))).collect() if t for n, x in enumerate(t[i : i + 120] for i in range(0, len(t), 120))}
    reads = catalogue.text_reads(docs)
    got = [(None if r.read_id is None else r.read_id >> 20, 0 if r.read_id is None else r.read_id % (1 << 20), r.seq) for r in reads.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "regexp" not in reads._jdf.queryExecution().toString()
