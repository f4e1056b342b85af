"""Language-model scores: prediction by partial matching over bytes, and a unigram base.

The model is a byte-context trie of depth five, trained on the corpus: the
counts of every byte after every context of up to five bytes. A symbol's
probability starts at the longest context that training has; where the symbol
is new, the context escapes with q / (n + q) (n symbols seen, q of them
distinct) to the next shorter one, from which the symbols seen so far are
excluded, down to an even choice among the rest. The code length of a text is
the sum over its bytes and an end symbol.

Neither the trie nor the vocabulary has a bound, so no task or driver holds
them: documents are cut into chunks, each chunk lists the distinct grams and
tokens that it has, and gets back just their costs and counts. Both travel as
compressed arrays, one a chunk and bucket; a bucket of grams has all grams of
some two-byte contexts. A bucket's arrays are summed up as they stream by, and
its costs and counts stream along the arrays that ask for them, so a task holds
the distinct grams or tokens of one bucket, however many chunks there are.
Texts are compressed once and shuffled once, to meet what their chunk gets back.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import dropped, stored

#: Bytes of text in a chunk (a longer text is a chunk of its own).
CHUNK = 16 << 20
#: Grams in an array.
STEP = 1 << 20
#: Bytes of the longest context; a gram is a context and its symbol, in 64 bits.
DEPTH = 5
#: Buckets that two-byte contexts, and tokens, are dealt to.
BUCKETS = 1024
#: Chunks that are answered by one task.
ASKING = 1 << 16
# UTF-8 never has these two: the context before the first byte, and the end of a text.
BEFORE, END = 0xFE, 0xFF
#: Symbols: the bytes that UTF-8 may have, and the end.
ALPHABET = 0xF8 + 1


def held_out(key: int | None, folds: int = 7, fold: int = 2) -> bool:
    """Whether the CRC-32 of the id's decimal digits leaves ``fold``; a null id is the text ``null``."""
    return zlib.crc32(("null" if key is None else str(key)).encode()) % folds == fold


def grams_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each byte and each end: its gram (the DEPTH bytes before it and itself, as one number) and its text's place in ``texts``; about STEP at a time."""
    held: list[bytes] = []
    size = at = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        a = np.frombuffer(b"".join(held), np.uint8)
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        grams = np.zeros(len(a) - DEPTH, np.int64)
        for k in range(DEPTH + 1):
            grams <<= 8
            grams |= a[k : k + len(grams)]
        # the bytes that only stand before a piece are no symbols
        inner = np.ones(len(a), bool)
        starts = np.cumsum(sizes) - sizes
        inner[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
        return grams[inner[DEPTH:]], np.repeat(np.arange(at, at + len(held)), sizes - DEPTH)

    first, last = bytes([BEFORE]) * DEPTH, bytes([END])
    for i, text in enumerate(texts):
        if len(text) >= STEP:  # a long text goes in pieces, each with the bytes before it
            if held:
                yield flush()
                held, size = [], 0
            whole = first + text + last
            for cut in range(0, len(text) + 1, STEP):
                at, held = i, [whole[cut : cut + STEP + DEPTH]]
                yield flush()
            held = []
            continue
        if not held:
            at = i
        held.append(first + text + last)
        size += len(held[-1])
        if size >= STEP:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def runs(keys: np.ndarray) -> np.ndarray:
    """Where in sorted ``keys`` each new key begins."""
    return np.flatnonzero(np.concatenate(([len(keys) > 0], keys[1:] != keys[:-1])))


def counted(texts: list[bytes], out: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of all ``texts``, sorted, and how often those that aren't held ``out`` have each."""
    keys = np.empty(sum(map(len, texts)) + len(texts), np.int64)
    at, apart = 0, np.array(out, np.int64)
    for grams, of in grams_of(texts):
        keys[at : at + len(grams)] = grams << 1 | apart[of]
        at += len(grams)
    keys.sort()
    starts = runs(keys)
    keys, n = keys[starts], np.diff(np.append(starts, len(keys)))
    n[keys & 1 == 1] = 0
    starts = runs(keys >> 1)
    return keys[starts] >> 1, np.add.reduceat(n, starts) if len(n) else n


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[bytes]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(key.as_py())
            texts.append((text.as_py() or b"").lower())
            size += len(texts[-1]) + 64
            if size >= CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def packed(a: np.ndarray) -> bytes:
    """``a`` of 64-bit numbers, compressed by byte planes."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(b: bytes, kind: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1).T).view(kind).ravel()


def listed(tokens: list[bytes]) -> bytes:
    """``tokens``, none of which has white space, compressed."""
    return zstandard.compress(b" ".join(tokens), 1)


def unlisted(b: bytes) -> list[bytes]:
    return zstandard.decompress(b).split()


def _bucket(gram: np.ndarray) -> np.ndarray:
    return ((gram >> 8 & 0xFFFF) * 40503 >> 6) % BUCKETS


FIELDS = ["chunk", "kind", "bucket", "keys", "facts"]
KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
SHREDS = "chunk long, kind int, bucket int, keys binary, facts binary"
SUMS = "kind int, bucket int, keys binary, facts binary"
#: Kinds of rows: what a chunk has of tokens and of grams, and its documents.
TOKENS, GRAMS, DOCS = 0, 1, 2


def _rows(names: list[str], **columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f], KINDS[FIELDS.index(f)]) for f in names], names)


def _shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk: its tokens and its grams by bucket, with training counts, and its documents: ids and texts, and as bucket how many train."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for k, (ids, texts) in enumerate(_chunks(batches)):
        chunk = part << 24 | k
        out = [held_out(i) for i in ids]
        train, dealt = Counter(), [[] for _ in range(BUCKETS)]
        for text, apart in zip(texts, out, strict=True):
            if apart:
                train.update(dict.fromkeys(text.split(), 0))
            else:
                train.update(text.split())
        for token in train:
            dealt[zlib.crc32(token) % BUCKETS].append(token)
        full = [b for b in range(BUCKETS) if dealt[b]]
        for b in full:
            dealt[b].sort()
        counts = [packed(np.fromiter(map(train.__getitem__, dealt[b]), np.int64, len(dealt[b]))) for b in full]
        yield _rows(FIELDS, chunk=[chunk] * len(full), kind=[TOKENS] * len(full), bucket=full, keys=[listed(dealt[b]) for b in full], facts=counts)
        del train, dealt, counts
        codes, n = counted(texts, out)
        bucket = _bucket(codes)
        order = np.argsort(bucket, kind="stable")
        codes, n, bucket = codes[order], n[order], bucket[order]
        starts = runs(bucket)
        cuts = [slice(a, b) for a, b in pairwise([*starts.tolist(), len(codes)])]
        yield _rows(FIELDS, chunk=[chunk] * len(cuts), kind=[GRAMS] * len(cuts), bucket=bucket[starts], keys=[packed(codes[c]) for c in cuts], facts=[packed(n[c]) for c in cuts])
        for at in range(0, len(ids), 512):
            some, of = texts[at : at + 512], ids[at : at + 512]
            named = np.array([[i is None, i or 0, len(t)] for i, t in zip(of, some, strict=True)], np.int64).T
            yield _rows(FIELDS, chunk=[chunk], kind=[DOCS], bucket=[sum(not held_out(i) for i in of)], keys=[packed(named.ravel())], facts=[zstandard.compress(b"".join(some), 3)])


def _documents(keys: bytes, facts: bytes) -> tuple[list[int | None], list[bytes]]:
    none, ids, sizes = unpacked(keys).reshape(3, -1)
    whole, ends = zstandard.decompress(facts), np.cumsum(sizes).tolist()
    return [None if n else i for n, i in zip(none.tolist(), ids.tolist(), strict=True)], [whole[a:b] for a, b in pairwise([0, *ends])]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and the sums of their counts, from parts that are sorted each."""
    codes = np.concatenate([c for c, _ in parts])
    order = np.argsort(codes, kind="stable")  # which merges sorted parts
    codes, n = codes[order], np.concatenate([n for _, n in parts])[order]
    starts = runs(codes)
    return codes[starts], np.add.reduceat(n, starts)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, bucket, keys, facts), sorted by kind and bucket or by part of one, to one row each."""
    now, held, size, words = None, [], 0, {}

    def row() -> pa.RecordBatch:
        if now[0] == TOKENS:
            order = sorted(words)
            keys, facts = listed(order), packed(np.fromiter(map(words.__getitem__, order), np.int64, len(order)))
        else:
            keys, facts = map(packed, _merged(held))
        return _rows(FIELDS[1:], kind=[now[0]], bucket=[now[1]], keys=[keys], facts=[facts])

    for batch in batches:
        for kind, bucket, keys, facts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (kind, bucket):
                if now:
                    yield row()
                now, held, size, words = (kind, bucket), [], 0, {}
            if kind == TOKENS:
                get = words.get
                words.update([(t, n + get(t, 0)) for t, n in zip(unlisted(keys), unpacked(facts).tolist(), strict=True)])
                continue
            held.append((unpacked(keys), unpacked(facts)))
            size += len(held[-1][0])
            if size > 2 * max(STEP, len(held[0][0])):
                held = [_merged(held)]
                size = len(held[0][0])
    if now:
        yield row()


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (last byte of the context, symbol), and at -1 and -2 of all and of distinct training tokens."""
    sums = np.zeros(1 << 16, np.int64)
    total = distinct = 0
    for batch in batches:
        for kind, keys, facts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = unpacked(facts)
            if kind == TOKENS:
                total, distinct = total + int(n.sum()), distinct + int((n > 0).sum())
            else:
                sums += np.bincount(unpacked(keys) & 0xFFFF, n, 1 << 16).astype(np.int64)
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *at.tolist()], pa.int64()), pa.array([total, distinct, *sums[at].tolist()], pa.int64())], ["pair", "n"])


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, kind, keys, facts) of rows (kind, chunk, keys, facts), in which a bucket's own facts, of chunk null, come first.

    Facts are the counts of tokens and the costs of grams.
    """
    known: dict[bytes, int] = {}
    codes = costs = None
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for kind, chunk, keys, facts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if chunk is None:
                if kind == TOKENS:
                    known = dict(zip(unlisted(keys), unpacked(facts).tolist(), strict=True))
                else:
                    codes, costs = unpacked(keys), unpacked(facts, np.float64)
                continue
            if kind == TOKENS:
                told = packed(np.array(list(map(known.__getitem__, unlisted(keys))), np.int64))
            else:
                told = packed(costs[np.searchsorted(codes, unpacked(keys))])
            for column, x in zip(out, (chunk, kind, keys, told), strict=True):
                column.append(x)
        yield _rows(["chunk", "kind", "keys", "facts"], chunk=out[0], kind=out[1], keys=out[2], facts=out[3])


def _log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log10(a / b), each taken as 1 where there is no such node."""
    return np.log10(np.where(a > 0, a, 1)) - np.log10(np.where(b > 0, b, 1))


def costs_of(gram: np.ndarray, n: np.ndarray, last: np.ndarray, whole: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """log10 probabilities of distinct grams; ``n`` has their training counts.

    The grams are all those of their contexts' last two bytes, so that shorter
    contexts down to these sum up here. ``last`` has the counts of each symbol
    after each single byte, ``whole`` those after none.
    """
    seen, symbol, before = last > 0, gram & 255, gram >> 8 & 255
    cost, escaped, new = np.zeros(len(gram)), np.zeros(len(gram)), np.ones(len(gram), bool)

    def level(count: np.ndarray, left: np.ndarray, kinds: np.ndarray) -> None:
        """Ends the grams that a context has; the others escape. ``left`` and ``kinds`` leave excluded symbols out."""
        nonlocal escaped
        cost[:] = np.where(new & (count > 0), escaped + _log(count, left + kinds), cost)
        new[count > 0] = False
        escaped = escaped + _log(kinds, left + kinds)

    keys, count, of, told_n, told_q = gram, n, np.arange(len(gram)), None, None
    for k in range(depth, 1, -1):
        contexts, at = np.unique(keys >> 8, return_inverse=True)
        sums = np.bincount(at, count).astype(np.int64)
        kinds = np.bincount(at, count > 0).astype(np.int64)
        here = at[of]
        level(count[of], sums[here] - (told_n if k < depth else 0), kinds[here] - (told_q if k < depth else 0))
        if k > 2:
            fewer, up = np.unique(keys & (1 << 8 * k) - 1, return_inverse=True)
            shorter = np.bincount(up, count).astype(np.int64)
        else:
            fewer, up, shorter = keys, np.arange(len(keys)), last[keys >> 8 & 255, keys & 255]
        # what the next shorter context has of the symbols that this one has
        told_n = np.bincount(at, np.where(count > 0, shorter[up], 0)).astype(np.int64)[here]
        told_q = kinds[here]
        keys, count, of = fewer, shorter, up[of]
    level(last[before, symbol], last.sum(axis=1)[before] - told_n, seen.sum(axis=1)[before] - told_q)
    level(whole[symbol], whole.sum() - (seen * whole).sum(axis=1)[before], (whole > 0).sum() - seen.sum(axis=1)[before])
    return np.where(new, escaped - np.log10(max(1, ALPHABET - int((whole > 0).sum()))), cost)


def _sums(texts: list[bytes], codes: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """The costs of each text, from those of all grams, sorted by code."""
    sums = np.zeros(len(texts))
    for grams, of in grams_of(texts):
        # a gram takes 48 bits, which leaves 16 for a text among those from the first of this step
        for low in range(0, int(of[-1] - of[0]) + 1, 1 << 16):
            here = (of - of[0] >= low) & (of - of[0] < low + (1 << 16))
            keys = grams[here].astype(np.uint64) << np.uint64(16) | (of[here] - of[0] - low).astype(np.uint64)
            keys.sort()
            gram = (keys >> np.uint64(16)).astype(np.int64)
            starts = runs(gram)
            each = np.repeat(costs[np.searchsorted(codes, gram[starts])], np.diff(np.append(starts, len(gram))))
            part = np.bincount((keys & np.uint64(0xFFFF)).astype(np.int64), each)
            sums[of[0] + low : of[0] + low + len(part)] += part
    return sums


def _score(total: int, distinct: int, ends: int):
    """For one chunk: its documents against the costs of its grams and the counts of its tokens."""
    unknown = -float(np.log10(total + distinct + 1))

    def run(key: tuple, docs: pa.Table, facts: pa.Table) -> pa.Table:
        weight: dict[bytes, float] = {}
        codes, costs = [np.zeros(0, np.int64)], [np.zeros(0)]
        for kind, keys, told in zip(facts["kind"].to_pylist(), facts["keys"], facts["facts"], strict=True):
            if kind == TOKENS:
                weight.update(zip(unlisted(keys.as_py()), (np.log10(unpacked(told.as_py()) + 1) + unknown).tolist(), strict=True))
            else:
                codes.append(unpacked(keys.as_py()))
                costs.append(unpacked(told.as_py(), np.float64))
        codes, costs = np.concatenate(codes), np.concatenate(costs)
        order = np.argsort(codes)
        codes, costs = codes[order], costs[order]
        end = math.log10(ends + 1) + unknown
        out: list[list] = [[] for _ in range(6)]
        for blob in zip(docs["keys"], docs["facts"], strict=True):
            ids, texts = _documents(*(x.as_py() for x in blob))
            out[0] += ids
            out[1] += [held_out(i) for i in ids]
            for text in texts:
                weights = list(map(weight.__getitem__, text.split()))
                out[2].append(len(weights) + 1)
                out[3].append(len(weights) - weights.count(unknown) + (ends > 0))
                out[4].append(sum(weights) + end)
            out[5] += _sums(texts, codes, costs).tolist()
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Both models learn from the rows that aren't held out. A null text is empty:
    one token, the end. A null id counts as the text ``null`` where folds are
    dealt. Repeated rows train as often as they occur. Extra columns are ignored.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    shreds = stored(slim.mapInArrow(_shred, SHREDS), "lm", "kind")
    packs = shreds.where(F.col("kind") < DOCS)
    chunks, ends = shreds.where(F.col("kind") == DOCS).agg(F.count_distinct("chunk"), F.coalesce(F.sum("bucket"), F.lit(0))).first()
    # parts of a bucket first, about as many as each has chunks
    part = F.pmod(F.xxhash64("chunk"), F.lit(max(1, math.isqrt(chunks)))).alias("part")
    parts = packs.select("kind", "bucket", part, "keys", "facts").repartition("kind", "bucket", "part").sortWithinPartitions("kind", "bucket", "part")
    parts = parts.select("kind", "bucket", "keys", "facts").mapInArrow(_summed, SUMS)
    sums = stored(parts.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(_summed, SUMS), "lm-sums")
    last = np.zeros((256, 256), np.int64)
    total, distinct = ends, int(ends > 0)
    for r in sums.select("kind", "keys", "facts").mapInArrow(_totals, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most 65,538 rows
        if r.pair >= 0:
            last[r.pair >> 8, r.pair & 255] = r.n
        else:
            total, distinct = (total + r.n, distinct) if r.pair == -1 else (total, distinct + r.n)
    whole = last.sum(axis=0)

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, bucket, keys, facts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                told = facts if kind == TOKENS else packed(costs_of(unpacked(keys), unpacked(facts), last, whole))
                yield _rows(FIELDS[1:], kind=[kind], bucket=[bucket], keys=[keys], facts=[told])

    costs = stored(sums.mapInArrow(priced, SUMS), "lm-costs")
    dropped(sums)
    none, groups = F.lit(None).cast("long"), -(-chunks // ASKING) or 1
    to_all = costs.select("kind", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"), none.alias("chunk"), "keys", "facts")
    asked = packs.select("kind", "bucket", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("long").alias("part"), "chunk", "keys", F.lit(None).cast("binary").alias("facts"))
    dealt = to_all.unionByName(asked).repartition("kind", "bucket", "part").sortWithinPartitions("kind", "bucket", "part", F.col("chunk").asc_nulls_first())
    answers = stored(dealt.select("kind", "chunk", "keys", "facts").mapInArrow(_answered, "chunk long, kind int, keys binary, facts binary"), "lm-answers")
    dropped(costs)
    dropped(shreds, parts=(f"kind={TOKENS}", f"kind={GRAMS}"))
    texts = shreds.where(F.col("kind") == DOCS).select(F.col("chunk").alias("of"), "keys", "facts")
    schema = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    found = texts.groupBy("of").cogroup(answers.groupBy("chunk")).applyInArrow(_score(total, distinct, ends), schema)
    return found.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
