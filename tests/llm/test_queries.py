"""The registered queries' digests and counts against plain versions of their contracts, over a whole small table and odd texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.llm import bpe, pii, queries, secrets, tokens, urls

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables with odd texts added, as a folder of their own."""
    rng = random.Random(13)
    where = str(tmp_path_factory.mktemp("tables"))
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for alphabet in ("0123 -", "01.25 ", "+1 (23).-a", "ab@c.-% ", 'token="=:AKIA09', "0af ", "secret:= 'x9_/") for _ in range(60)]
    odd += ["password = 'aaaaaaaaaaaa", "API_KEY: abcdefghijkl=", "apikey=" + "Z" * 40, "AKIA" + "A" * 14, "AKIA" + "A" * 13, "a" * 16 + " " + "f" * 15, "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.4", "4111-1111 1111-1111", "é𝕏 x@y.zz 10.0.0.1"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)] + [(2 * 10**6, None)], "doc_id long, text string")
    docs.unionByName(more).write.parquet(f"{where}/documents.parquet")
    return where


def spans(text, kind, pattern, good, group=0):
    return [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if good(m)]


def sha(found):
    return hashlib.sha256(",".join(f"{k}:{b}:{e}" for b, e, k in found).encode()).hexdigest()


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_op1(spark, folder):
    got = {r.doc_id: r for r in queries.op1_secrets(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        t = d.text or ""
        kinds = [
            spans(t, "assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
            spans(t, "access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
            spans(t, "hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
        ]
        base = [x for _, x in sorted(((b, k), (b, e, name)) for k, found in enumerate(kinds) for b, e, name in found)]
        r = got[d.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (*map(len, kinds), sha(base)), t
        told = [x for x in r.spans.split(",") if x]
        assert {f"{k}:{b}:{e}" for b, e, k in base} <= set(told)
        assert [int(x.split(":")[1]) for x in told] == sorted(int(x.split(":")[1]) for x in told)


def test_op6(spark, folder):
    got = {r.doc_id: r for r in queries.op6_pii(spark, folder).collect()}
    digits = lambda s: re.sub("[^0-9]", "", s)
    for d in spark.read.parquet(f"{folder}/documents.parquet").collect():
        t = d.text or ""
        kinds = [
            spans(t, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            spans(t, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
            spans(t, "card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
            spans(t, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
        ]
        base = [x for found in kinds for x in found]
        r = got[d.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (*map(len, kinds), sha(base)), t
        told = [x for x in r.spans.split(",") if x]
        assert told[: len(base)] == [f"{k}:{b}:{e}" for b, e, k in base]
        for x in told[len(base) :]:
            kind, b, e = x.split(":")
            assert kind == "term" and t[int(b) : int(e)].isalpha() and not any(int(b) < y and z < int(e) for z, y, _ in base)


def test_op8_hosts_and_rules(spark):
    fixed = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    got = queries.op8_urls(spark, DATA).collect()
    by_id = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url").collect()}
    assert len(got) == len(by_id)
    for r in got:
        url = by_id[r.page_id] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fit = [(len(h + p), h + p, v) for v, h, p in fixed if (host.lower() == h or host.lower().endswith("." + h)) and path.startswith(p)]
        rule = max(fit)[1:] if fit else None
        assert (r.host, r.path, r.rule) == (host.lower(), path, rule and rule[0])
        assert r.verdict == rule[1] if rule else r.verdict in ("allow", "block")
    assert urls.RULES


def test_sanitised_and_redacted_texts(spark):
    rows = [(1, "write to me@x.yz or +1 202 555 0100, password=abcdefghijkl99 end"), (2, None), (3, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitised(frame).collect()}
    assert "[email]" in clean[1] and "[phone]" in clean[1] and "me@x.yz" not in clean[1] and clean[2] is None and clean[3] == ""
    assert {r.doc_id: r.text for r in secrets.redacted(frame).collect()} == {1: "write to me@x.yz or +1 202 555 0100, [assign] end", 2: None, 3: ""}


def test_encoded_and_decoded(spark):
    pytest.importorskip("tokenizers")
    path = queries.vocabulary()
    frame = spark.createDataFrame([(1, "Hello, hello world 12"), (2, None), (3, "")], "doc_id long, text string")
    ids = tokens.encoded(frame, path)
    enc = bpe.Encoder(path)
    (want,) = enc.encode(["Hello, hello world 12"])
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert got == {1: memoryview(want).cast("I").tolist(), 2: [], 3: []}
    text = {r.doc_id: r.text for r in tokens.decoded(ids, path).collect()}
    assert text == {1: enc.decode(want).decode(), 2: "", 3: ""}


def test_running_folds(spark):
    from strandline.llm.shared import replaced, running

    for n in (0, 1, 15, 16, 17, 400, 5000):
        row = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).alias("v") if n else F.array().cast("array<int>").alias("v"))
        sums, tops = row.select(running(F.col("v"), lambda a, b: a + b, F.lit(0)), running(F.col("v"), F.greatest, F.lit(0))).first()
        assert sums == [k * (k + 1) // 2 for k in range(n)] and tops == list(range(n))
    text = "".join(chr(97 + i % 26) for i in range(1000)) + "é𝕏"
    cuts = [(0, 3), (255, 257), (256, 300), (511, 512), (999, 1002)]
    spans_of = F.array(*[F.struct(F.lit(b).alias("start"), F.lit(0).alias("rank"), F.lit(e).alias("end"), F.lit("k").alias("kind"), F.lit("").alias("hit")) for b, e in cuts])
    want = "[k]" + text[3:255] + "[k]" + text[300:511] + "[k]" + text[512:999] + "[k]"
    assert spark.range(1).select(replaced(F.lit(text), spans_of)).first()[0] == want


def test_bitmaps_pass_every_key(spark):
    from strandline.llm.shared import bitmap, in_bitmap

    for n, bits in ((0, 1 << 24), (1, 1 << 24), (3000, 1 << 24), (5000, 1 << 12)):
        keys = spark.range(n).select(F.xxhash64("id").alias("h"))
        rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h")).withColumn("b", bitmap(keys, bits))
        passed = {r.id for r in rows.where(in_bitmap(F.col("b"), F.col("h"))).select("id").collect()}
        assert passed >= set(range(n)) and (bits < 1 << 24 or len(passed) < n + 2500)
