"""Exact matches with a reference of bounded size, and what the matches of one read give, in Arrow batches.

Every task has the whole reference, so reads are matched where they are read
and nothing is shuffled. Places of a batch's reads are counted on, as if the
reads were one text: a place tells the read, so sorting by place sorts by read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators import kernels

#: Characters of a reference that tasks have whole, of reads matched at once, and hits or pairs held at once.
MOST, CHUNK, HELD = 1 << 20, 1 << 18, 1 << 21
#: Odd multipliers of the words of a k-mer.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _words(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Of every place, its next ``n`` characters in one word."""
    w, have = codes.astype(np.uint64), 1
    while have < n:
        more = min(have, n - have)
        w = w[: len(w) - more] | (w[more:] << np.uint64(bits * more))
        have += more
    return w


def ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one range after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + counts, counts)


def blocks(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of about ``most`` in sum, one element at least."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


class Found:
    """The matches of a batch of reads: ``row``, ``item``, ``b`` and ``r`` (places among all reads' and items' characters), ``n`` (length); and its reads' ``keys``, ``texts``, ``starts``, ``ends``."""

    def __init__(self, keys: np.ndarray, texts: list[str], null: np.ndarray) -> None:
        self.keys, self.texts, self.null = keys, texts, null
        lens = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(lens)
        self.starts = self.ends - lens

    def rows(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


class Matcher:
    """The k-mers of a reference, sorted by hash. Items are in the order of their ids."""

    def __init__(self, ids: list[int], texts: list[str], k: int) -> None:
        self.k, self.texts, self.ids = k, texts, np.array(ids, np.int64)
        lens = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(lens + 1) - 1  # an item is followed by one code that no read has
        self.starts = self.ends - lens
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        letters = np.unique(points)
        self.bits = next(b for b in (8, 16, 32) if len(letters) + 2 < 1 << b)
        kind = {8: np.uint8, 16: np.uint16, 32: np.uint32}[self.bits]
        self.coded = np.zeros(max(129, int(letters[-1]) + 2 if len(letters) else 0), kind)  # 0: in no item, as the last one
        self.coded[letters] = np.arange(1, len(letters) + 1)
        self.codes = np.full(int((lens + 1).sum()) + k + 1, len(letters) + 1, kind)
        inside = ranges(self.starts, lens)
        self.codes[inside] = self.coded[points]
        at = ranges(self.starts, np.maximum(lens - k + 1, 0))
        words = [w[at] for w in self.words(self.codes)]
        for turn in range(1, 99):
            self.odd = _ODD[np.arange(len(words)) % 4] * np.uint64(2 * turn - 1) + np.arange(len(words), dtype=np.uint64) * np.uint64(2)
            h = self.hashed(words)
            order = np.lexsort((at, h))
            h, self.at = h[order], at[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            first = np.flatnonzero(new)
            whose = np.cumsum(new) - 1
            self.grams = [w[order][first] for w in words]
            if all((g[whose] == w[order]).all() for g, w in zip(self.grams, words, strict=True)):
                break  # no two k-mers share a hash
        else:
            raise ValueError("k-mers share hashes")
        self.h, self.first, self.count = h[first], first, np.diff(np.append(first, len(h)))
        self.shift = np.uint64(64 - min(24, max(12, int(16 * len(self.h) + 1).bit_length())))
        self.some = np.zeros(1 << (64 - int(self.shift)), bool)
        self.some[self.h >> self.shift] = True

    def words(self, codes: np.ndarray) -> list[np.ndarray]:
        """A place's k characters in words, the last of which may overlap the one before."""
        size = min(self.k, 64 // self.bits)
        if len(codes) < self.k:
            return [np.zeros(0, np.uint64) for _ in {*range(0, self.k - size, size), self.k - size}]
        whole = _words(codes, size, self.bits)
        n = len(codes) - self.k + 1
        return [whole[s : s + n] for s in sorted({*range(0, self.k - size, size), self.k - size})]

    def hashed(self, words: list[np.ndarray]) -> np.ndarray:
        h = words[0] * self.odd[0]
        for w, m in zip(words[1:], self.odd[1:], strict=True):
            h = (h ^ (h >> np.uint64(29))) + w * m
        return h

    def seen(self, f: Found) -> np.ndarray:
        """The k-mers that the places ``f.pos`` have, of all that stand in the reference."""
        text = "".join(f.texts)
        if text.isascii():
            q = self.coded[np.frombuffer(text.encode("ascii"), np.uint8)]
        else:
            q = self.coded[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), len(self.coded) - 1)]
        k = self.k
        words = self.words(q)
        h = self.hashed(words)
        pos = np.flatnonzero(self.some[h >> self.shift])
        row = f.rows(pos)
        ok = pos + k <= f.ends[row]
        pos, row = pos[ok], row[ok]
        gram = np.minimum(np.searchsorted(self.h, h[pos]), max(len(self.h) - 1, 0))
        ok = self.h[gram] == h[pos]
        for w, g in zip(words, self.grams, strict=True):
            ok &= w[pos] == g[gram]
        pos, row, gram = pos[ok], row[ok], gram[ok]
        f.pos, f.pos_row, f.pos_count = pos, row, self.count[gram]
        f.q = q
        return gram

    def find(self, f: Found) -> Found:
        gram = self.seen(f)
        q, k, n, pos, row = f.q, self.k, len(f.q), f.pos, f.pos_row
        left, right = np.concatenate([q[:1] * 0, q]), np.concatenate([q, q[:1] * 0])
        before = np.concatenate([self.codes[-1:], self.codes])  # what stands before a place of the reference
        begin, end = pos == f.starts[row], pos + k == f.ends[row]
        # hits on one diagonal follow each other, so its begins and ends, sorted, belong together
        bits = max(1, n.bit_length())
        b, e = [], []
        for s in blocks(f.pos_count, HELD):
            c = f.pos_count[s]
            qp, rp = np.repeat(pos[s], c), self.at[ranges(self.first[gram[s]], c)]
            key = (rp - qp + n) << bits | qp
            b.append(key[np.repeat(begin[s], c) | (left[qp] != before[rp])])
            e.append(key[np.repeat(end[s], c) | (right[np.minimum(qp + k, n)] != self.codes[rp + k])])
        b, e = (np.sort(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in (b, e))
        f.b, f.n = b & ((1 << bits) - 1), e - b + k
        f.r = (b >> bits) - n + f.b
        f.row, f.item = f.rows(f.b), np.searchsorted(self.starts, f.r, "right") - 1
        f.qbeg, f.rbeg = f.b - f.starts[f.row], f.r - self.starts[f.item]
        f.qend, f.id, f.ids, f.refs, f.k = f.qbeg + f.n, self.ids[f.item], self.ids, self.texts, k
        f.codes, f.item_starts, f.item_ends = self.codes, self.starts, self.ends
        f.pair = f.row * max(len(self.ids), 1) + f.item
        return f


    def begins(self, f: Found, pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in reads and items, and the pair, one of ``pairs``, where runs of k matches and more begin from which an alignment can get far.

        One of so few that no gap can follow (OPEN + EXTEND) has to match on
        behind a mismatch until it can afford another; if not, it scores less
        than it would cost.
        """
        gram = self.seen(f)
        pos, row, gap = f.pos, f.pos_row, kernels.OPEN + kernels.EXTEND
        far = 2 * kernels.MISMATCH + 2
        left, q = np.concatenate([f.q[:1] * 0, f.q]), np.concatenate([f.q, np.zeros(far, f.q.dtype)])
        before, codes = np.concatenate([self.codes[-1:], self.codes]), np.concatenate([self.codes, np.repeat(self.codes[-1:], far)])
        whose = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.ends - self.starts + 1)
        begin, items, wanted = pos == f.starts[row], max(len(self.ids), 1), None
        if len(f.starts) * items <= 8 * HELD:  # else other pairs come, too
            wanted = np.zeros(len(f.starts) * items, bool)
            wanted[pairs] = True
        for s in blocks(f.pos_count, HELD >> 3):
            c = f.pos_count[s]
            at, rp = np.repeat(np.arange(s.start, s.stop), c), self.at[ranges(self.first[gram[s]], c)]
            qp, pair = pos[at], row[at] * items + whose[rp]
            on = begin[at] | (left[qp] != before[rp])
            if wanted is not None:
                on &= wanted[pair]
            qp, rp, pair = qp[on], rp[on], pair[on]
            unlike = [q[qp + i] != codes[rp + i] for i in range(self.k, far)]
            on = (sum(x.view(np.int8) for x in unlike) <= 1) | ~np.logical_or.reduce(unlike[: gap + 1 - self.k])
            yield qp[on], rp[on], pair[on]


def matcher(refs: DataFrame, k: int, ref_key: str = "item_id", text: str = "text") -> Matcher | None:
    """The reference, if it has ``MOST`` characters at most and whole, different ids."""
    if not isinstance(refs.schema[ref_key].dataType, T.LongType):
        return None
    n, ids, letters = refs.agg(F.count("*"), F.count_distinct(ref_key), F.coalesce(F.sum(F.char_length(text)), F.lit(0))).first()
    if n != ids or letters > MOST or n > MOST:
        return None
    rows = sorted((r[0], r[1] or "") for r in refs.select(ref_key, text).collect())
    return Matcher([r[0] for r in rows], [r[1] for r in rows], k)


def per_read(reads: DataFrame, refs: DataFrame, k: int, f: Callable[[Found], tuple], names: str, read_key: str = "doc_id", ref_key: str = "item_id", text: str = "text") -> DataFrame | None:
    """The read's key and ``names`` (long, unless the type follows) of what ``f(found)`` gives: row and columns.

    None if the reference is too large to go to tasks, or if ids are null or
    repeat, as the matches of one id then aren't those of one read.
    """
    kind = reads.schema[read_key].dataType
    if not isinstance(kind, T.IntegralType) or (known := matcher(refs, k, ref_key, text)) is None:
        return None
    if not reads.groupBy(read_key).count().where(F.col(read_key).isNull() | (F.col("count") > 1)).isEmpty():
        return None
    schema = T.StructType([T.StructField(read_key, kind), *T._parse_datatype_string(", ".join(c if " " in c else f"{c} long" for c in names.split(", "))).fields])
    types = [{"bigint": pa.int64(), "string": pa.string()}[c.dataType.simpleString()] for c in schema.fields[1:]]

    def batch(keys: pa.Array, texts: list) -> pa.RecordBatch:
        null = np.array([t is None for t in texts], bool)
        found = known.find(Found(keys.to_numpy(zero_copy_only=False).astype(np.int64), ["" if t is None else t for t in texts], null))
        row, columns = f(found)
        arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), *arrays], names=schema.names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            keys, texts, at, size = p.column(0), p.column(1).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                size += len(t or "") + 1
                if size >= CHUNK or i + 1 == len(texts):
                    yield batch(keys.slice(at, i + 1 - at), texts[at : i + 1])
                    at, size = i + 1, 0

    return reads.select(read_key, text).mapInArrow(run, schema)


def tagged(reads: DataFrame, known: Matcher, read_key: str, text: str, carry: str) -> DataFrame:
    """(read, rid, rev, qbeg, qend, rbeg, tag, ``text``, ``carry``) of the matches of ``reads(read, text, carry)`` with items whose ids are 2 * rid + rev.

    A tag is a row of ``reads``: ids may repeat. Its texts stand on the first of its matches.
    """
    types = {read_key: pa.int64(), "rid": pa.int32(), "rev": pa.int32(), "qbeg": pa.int64(), "qend": pa.int64(), "rbeg": pa.int64(), "tag": pa.int64(), text: pa.string(), carry: pa.string()}

    def batch(p: pa.RecordBatch, tag: int) -> pa.RecordBatch:
        texts = p.column(1).to_pylist()
        f = known.find(Found(np.zeros(len(texts), np.int64), ["" if t is None else t for t in texts], np.zeros(len(texts), bool)))
        o = np.lexsort((f.r, f.b))
        row = pa.array(f.row[o], pa.int64())
        once = pa.array(np.where(news(f.row[o]), f.row[o], 0), pa.int64(), mask=~news(f.row[o]))
        ids = f.id[o]
        arrays = [p.column(0).take(row), ids >> 1, ids & 1, f.qbeg[o], f.qend[o], f.rbeg[o], f.row[o] + tag, p.column(1).take(once), p.column(2).take(once)]
        return pa.RecordBatch.from_arrays([(a if isinstance(a, pa.Array) else pa.array(a)).cast(t) for a, t in zip(arrays, types.values(), strict=True)], names=list(types))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tag = TaskContext.get().partitionId() << 40
        for p in parts:
            size = max(1, CHUNK * p.num_rows // max(1, p.column(1).nbytes))
            for at in range(0, p.num_rows, size):
                part = p.slice(at, size)
                yield batch(part, tag)
                tag += part.num_rows

    return reads.select(read_key, text, carry).mapInArrow(run, f"{read_key} long, rid int, rev int, qbeg long, qend long, rbeg long, tag long, {text} string, {carry} string")


# What the matches of a batch give. Each takes ``Found`` and returns rows and columns.


def news(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    return new


def ranks(new: np.ndarray) -> np.ndarray:
    """Numbers from 0 in each group."""
    n = np.arange(len(new))
    return n - np.maximum.accumulate(np.where(new, n, 0))


def sizes(new: np.ndarray) -> np.ndarray:
    return np.diff(np.append(np.flatnonzero(new), len(new)))


def prior_max(v: np.ndarray) -> np.ndarray:
    """The largest value before each, -1 for the first."""
    return np.concatenate([[-1], np.maximum.accumulate(v)[:-1]]) if len(v) else v


def covered(b: np.ndarray, e: np.ndarray, group: np.ndarray) -> np.ndarray:
    """What each interval adds to the union of those before it; sorted by group, then begin."""
    away = group * (int(e.max()) + 1 if len(e) else 1)
    return np.maximum(0, e + away - np.maximum(b + away, prior_max(e + away)))


def mems(f: Found) -> tuple:
    return f.row, [f.id, f.qbeg, f.qend, f.rbeg, f.n]


def spans(f: Found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and number of the different intervals, by begin and the longest first."""
    bits = int(f.n.max()).bit_length() if len(f.n) else 1
    key = np.sort(f.b << bits | ((1 << bits) - 1 - f.n))
    new = news(key)
    one = key[new]
    b = one >> bits
    return b, b + (1 << bits) - 1 - (one & ((1 << bits) - 1)), sizes(new)


def _spans_out(f: Found, b: np.ndarray, e: np.ndarray, *more: np.ndarray) -> tuple:
    row = f.rows(b)
    return row, [b - f.starts[row], e - f.starts[row], *more]


def smems(f: Found, least: int = 0) -> tuple:
    """The intervals that no other contains, and those of ``least`` and more, if told."""
    b, e, s = spans(f)
    stay = prior_max(e) < e
    if least:
        stay |= e - b >= least
    return _spans_out(f, b[stay], e[stay], s[stay])


def repeat_fraction(f: Found) -> tuple:
    b, e, s = spans(f)
    b, e = b[s >= 2], e[s >= 2]
    more = np.zeros(f.ends[-1] + 1 if len(f.ends) else 1, np.int64)
    more[1:] = np.cumsum(np.bincount(b, covered(b, e, np.zeros(len(b), np.int64)), len(more) - 1).astype(np.int64))
    total = pa.array(f.ends - f.starts, pa.int64(), mask=f.null)
    return np.arange(len(f.starts)), [more[f.ends] - more[f.starts], total]


def reseeded(f: Found, least: int = 9) -> tuple:
    """Of each begin, the end of the second longest interval over it; those through the middle of intervals that occur once."""
    order = np.argsort(f.b, kind="stable")
    b, e = f.b[order], (f.b + f.n)[order]
    second = np.maximum.accumulate(np.minimum(e, prior_max(e))) if len(e) else e
    last = np.append(news(b)[1:], True) if len(b) else np.zeros(0, bool)
    b, e = b[last], second[last]
    ok = e >= b + f.k
    b, e = b[ok], e[ok]
    ok = prior_max(e) < e
    b, e = b[ok], e[ok]
    row, (qb, qe, s) = smems(f)
    one = (s == 1) & (qe - qb >= least)
    x = np.sort(f.starts[row[one]] + (qb[one] + qe[one] + 1) // 2)
    ok = np.searchsorted(x, e, "left") > np.searchsorted(x, b, "left")
    return _spans_out(f, b[ok], e[ok])


def strided(f: Found, most: int = 2) -> tuple:
    """Every s // most-th place of an interval that has s places, if they are more than ``most``."""
    order = np.lexsort((f.r, f.n, f.b))
    new = news(f.b[order], f.n[order])
    s, n = np.repeat(sizes(new), sizes(new)), ranks(new)
    step = np.where(s > most, s // most, 1)
    o = order[(n % step == 0) & (n // step < most)]
    return f.row[o], [f.qbeg[o], f.qend[o], f.id[o], f.rbeg[o]]


def ordered(f: Found, keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The order by read and ``keys`` (descending with -), and the numbers of the matches of a read in it, from 1."""
    order = np.lexsort([-getattr(f, c[1:]) if c[0] == "-" else getattr(f, c) for c in reversed(("row", *keys))])
    return order, ranks(news(f.row[order])) + 1


def seed_order(f: Found, keys: tuple[str, ...]) -> tuple:
    o, n = ordered(f, keys)
    return f.row[o], [f.id[o], f.qbeg[o], f.qend[o], f.rbeg[o], n]


def region_rank(f: Found) -> tuple:
    o, n = ordered(f, ("-n", "rbeg", "qbeg", "id"))
    return f.row[o], [f.id[o], f.qbeg[o], f.qend[o], f.n[o], n]


def diagonal_votes(f: Found, least: int = 3) -> tuple:
    """The diagonal of each read and item with most k-mers."""
    diag = f.qbeg - f.rbeg
    order = np.lexsort((diag, f.pair))
    new = np.flatnonzero(news(f.pair[order], diag[order]))
    votes = np.add.reduceat((f.n - f.k + 1)[order], new) if len(new) else new
    o = order[new]
    best = np.lexsort((diag[o], -votes, f.pair[o]))
    best = best[news(f.pair[o][best])]
    best = best[votes[best] >= least]
    o = o[best]
    return f.row[o], [f.id[o], diag[o], votes[best]]


def overlapping(b: np.ndarray, e: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of intervals that share a place, in blocks."""
    order = np.argsort(b, kind="stable")
    s = b[order]
    first = np.arange(1, len(s) + 1)
    n = np.maximum(np.searchsorted(s, e[order], "left") - first, 0)
    for part in blocks(n, HELD):
        yield np.repeat(order[part], n[part]), order[ranges(first[part], n[part])]


def _same_item(f: Found) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of matches of one read and item that overlap in the read."""
    bits = int((f.ends - f.starts).max()).bit_length() + 1 if len(f.ends) else 1
    _, group = np.unique(f.pair, return_inverse=True)  # as few as there are, for short keys
    at = group << bits
    return overlapping(at + f.qbeg, at + f.qend)


def absorbed(f: Found) -> tuple:
    """How many shorter matches of the same read and item lie in each, in both texts."""
    n = np.zeros(len(f.b), np.int64)
    for x, y in _same_item(f):
        for a, c in ((x, y), (y, x)):
            inside = (f.n[c] < f.n[a]) & (f.b[c] >= f.b[a]) & (f.b[c] + f.n[c] <= f.b[a] + f.n[a]) & (f.r[c] >= f.r[a]) & (f.r[c] + f.n[c] <= f.r[a] + f.n[a])
            n += np.bincount(a[inside], minlength=len(n))
    return f.row, [f.id, f.qbeg, f.qend, f.rbeg, n]


def deduped(f: Found) -> tuple:
    """The matches without those that share over 0.7 of the shorter, in both texts, with a greater one by length and places."""
    stay = np.ones(len(f.b), bool)
    for x, y in _same_item(f):
        least = 7 * np.minimum(f.n[x], f.n[y])
        on = lambda at: 10 * (np.minimum(at[x] + f.n[x], at[y] + f.n[y]) - np.maximum(at[x], at[y])) > least  # noqa: E731, B023
        both = on(f.b) & on(f.r)
        x, y = x[both], y[both]
        same = f.n[x] == f.n[y]
        less = (f.n[x] < f.n[y]) | same & ((f.r[x] < f.r[y]) | (f.r[x] == f.r[y]) & (f.b[x] < f.b[y]))
        stay[np.where(less, x, y)] = False
    return f.row[stay], [f.id[stay], f.qbeg[stay], f.qend[stay], f.rbeg[stay]]


def chains(f: Found) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Matches of a read and item on near diagonals: their order, where a chain begins in it, and the chains."""
    band = (f.qbeg - f.rbeg) >> 6
    order = np.lexsort((f.b, band, f.pair))
    new = news(f.pair[order], band[order])
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    total = lambda how, v: how.reduceat(v, first) if len(first) else first
    on_read = total(np.add, covered(f.qbeg[order], f.qend[order], group))
    again = order[np.lexsort((f.rbeg[order], group))]
    on_item = total(np.add, covered(f.rbeg[again], (f.rbeg + f.n)[again], group))
    o = order[first]
    c = {"row": f.row[o], "id": f.id[o], "band": band[o], "qbeg": f.qbeg[o], "qend": total(np.maximum, f.qend[order]), "n_seeds": sizes(new), "anchor": total(np.maximum, f.n[order]), "w": np.minimum(on_read, on_item)}
    return order, new, c


def chain_columns(f: Found, names: tuple[str, ...], least: int = 0) -> tuple:
    _, _, c = chains(f)
    stay = c["w"] >= least
    return c["row"][stay], [c[x][stay] for x in names]


def near_best(f: Found) -> tuple:
    """The chains of 95 per cent of their read's best."""
    _, _, c = chains(f)
    best = np.zeros(len(f.starts), np.int64)
    np.maximum.at(best, c["row"], c["w"])
    stay = c["w"] >= 95 * best[c["row"]] // 100
    return c["row"][stay], [c[x][stay] for x in ("id", "band", "w")]


def _by_weight(f: Found) -> tuple:
    """Chains by read, weight, item and band; their numbers in the read; and of each read the weight of the fourth, else 0."""
    _, _, c = chains(f)
    o = np.lexsort((c["band"], c["id"], -c["w"], c["row"]))
    c = {k: v[o] for k, v in c.items()}
    n = ranks(news(c["row"]))
    fourth = np.zeros(len(f.starts), np.int64)
    fourth[c["row"][n == 3]] = c["w"][n == 3]
    return c, n, fourth


def top_chains(f: Found) -> tuple:
    c, n, fourth = _by_weight(f)
    c = {k: v[n < 3] for k, v in c.items()}
    return c["row"], [c["id"], c["band"], c["w"], fourth[c["row"]]]


def capped_sub(f: Found) -> tuple:
    c, n, fourth = _by_weight(f)
    row, w = c["row"][n == 0], c["w"][n == 0]
    return row, [w, np.minimum(fourth[row], w - 1)]


def anchored(f: Found, least: int = 12) -> tuple:
    """Matches of ``least`` and more, and all of chains that have none."""
    order, new, c = chains(f)
    anchor = np.repeat(c["anchor"], sizes(new))
    o = order[(anchor < least) | (f.n[order] >= least)]
    return f.row[o], [f.id[o], f.qbeg[o], f.qend[o], f.rbeg[o]]


def settled_greedily(later: np.ndarray, earlier: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` stay, if each falls that has a staying one before it among its pairs (later, earlier)."""
    state = np.ones(n, np.int8)  # 1 stays, 0 open, -1 falls
    state[later] = 0
    while len(later):
        state[later[state[earlier] == 1]] = -1
        open_ = (state[later] == 0) & (state[earlier] >= 0)
        waits = np.zeros(n, bool)
        waits[later[open_]] = True
        state[later[(state[later] == 0) & ~waits[later]]] = 1
        later, earlier = later[open_], earlier[open_]
    return state == 1


def filtered_chains(f: Found, mask: float, drop: float, gap: int, seed: int) -> tuple:
    """The chains kept, as ``regions.filtered_chains`` has them: those by weight, then place, that no kept one covers and outweighs, and the first that each kept one shadows."""
    f32 = np.float32
    _, _, c = chains(f)
    row, w, n = c["row"], c["w"], len(c["w"])
    b, e = f.starts[row] + c["qbeg"], f.starts[row] + c["qend"]
    rank = np.empty(n, np.int64)
    by_rank = np.lexsort((e, b, -w, row))
    rank[by_rank] = np.arange(n)
    later, earlier = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, y in overlapping(b, e):
        shorter = np.minimum(e[x] - b[x], e[y] - b[y])
        common = np.minimum(e[x], e[y]) - np.maximum(b[x], b[y])
        ok = (common.astype(f32) >= shorter.astype(f32) * f32(mask)) & (shorter < gap)
        x, y = rank[x[ok]], rank[y[ok]]
        later.append(np.maximum(x, y))
        earlier.append(np.minimum(x, y))
    i, j, w = np.concatenate(later), np.concatenate(earlier), w[by_rank]  # from here on, chains are their ranks
    strong = (w[i].astype(f32) < w[j].astype(f32) * f32(drop)) & (w[j] - w[i] >= 2 * seed)
    stays = settled_greedily(i[strong], j[strong], n)
    i, j, strong = (x[stays[j]] for x in (i, j, strong))
    upto = np.full(n, n)
    np.minimum.at(upto, i[strong], j[strong])
    seen = j <= upto[i]
    i, j = i[seen], j[seen]
    kept = np.where(stays, 3, 0)
    kept[i[stays[i]]] = 2
    first = np.full(n, n)
    np.minimum.at(first, j, i)
    first = first[first < n]
    kept[first[kept[first] == 0]] = 1
    o = by_rank[kept > 0]
    return row[o], [c["qbeg"][o], c["qend"][o], c["w"][o], kept[kept > 0]]


def mixed(key: np.ndarray) -> np.ndarray:
    """``align.regions.mixed`` of many."""
    key = key.astype(np.uint64)
    for kind, n in (("~", 32), ("^", 22), ("~", 13), ("^", 8), ("+", 3), ("^", 15), ("~", 27), ("^", 31)):
        n = np.uint64(n)
        key = key ^ (key >> n) if kind == "^" else key + (~(key << n) if kind == "~" else key << n)
    return key


def marked_primary(f: Found, mask: float, near: int) -> tuple:
    """Matches as regions by score, as ``regions.marked_primary`` has them: the first one that overlaps each is its primary."""
    o = np.lexsort((f.qbeg, f.rbeg, f.id, f.row))
    o = o[np.lexsort((mixed(f.keys[f.row[o]] + ranks(news(f.row[o]))), -f.n[o], f.row[o]))]
    b, e, s, row = f.b[o], (f.b + f.n)[o], f.n[o], f.row[o]
    ix, n = ranks(news(row)), len(o)
    later, earlier = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, y in overlapping(b, e):
        ok = np.minimum(e[x], e[y]) - np.maximum(b[x], b[y]) >= mask * np.minimum(s[x], s[y])
        later.append(np.maximum(x[ok], y[ok]))
        earlier.append(np.minimum(x[ok], y[ok]))
    i, j = np.concatenate(later), np.concatenate(earlier)
    head = settled_greedily(i, j, n)
    ok = head[j]
    head_of = np.full(n, n)
    np.minimum.at(head_of, i[ok], j[ok])
    i = np.flatnonzero(head_of < n)
    j = head_of[i]
    first = np.full(n, n)
    np.minimum.at(first, j, i)
    sub = np.where(first < n, s[np.minimum(first, max(n - 1, 0))], 0) if n else first
    sub_n = np.bincount(j[s[j] - s[i] <= near], minlength=n)
    secondary = pa.array(ix[np.minimum(head_of, max(n - 1, 0))] if n else ix, pa.int64(), mask=head_of == n)
    return row, [f.id[o], f.qbeg[o], f.qend[o], s, secondary, sub, sub_n]


def places(f: Found) -> tuple:
    """The different places and lengths of the reference's side."""
    bits = int(f.n.max()).bit_length() if len(f.n) else 1
    key = np.unique(f.r << bits | f.n)
    r, n = key >> bits, key & ((1 << bits) - 1)
    _, one = np.unique(f.r, return_index=True)
    o = one[np.searchsorted(f.r[one], r)] if len(one) else one
    return np.zeros(len(r), np.int64), [f.id[o], f.rbeg[o], n]


def intervals(f: Found) -> tuple:
    """The different intervals, with the first place of each."""
    order = np.lexsort((f.r, f.n, f.b))
    o = order[news(f.b[order], f.n[order])]
    return f.row[o], [f.qbeg[o], f.qend[o], f.id[o], f.rbeg[o], f.n[o]]


def walked(f: Found, most: int) -> tuple:
    """``seeding.round_three`` of k-mers one character longer: a read's k-mers one after another, but where one has ``most`` places or more, its longer matches tell the end."""
    k, pos, row, n = f.k, f.pos, f.pos_row, f.pos_count
    hot = n >= most
    has_hot = np.zeros(len(f.starts), bool)
    has_hot[row[hot]] = True
    plain = ~has_hot[row] & ((pos - f.starts[row]) % k == 0)
    out = [(pos[plain], pos[plain] + k, n[plain])]
    order = np.lexsort((f.b, f.row))
    b, e = f.b[order], (f.b + f.n)[order]
    for d in np.flatnonzero(has_hot):
        i, j = np.searchsorted(pos, [f.starts[d], f.ends[d]])
        p, c, h = pos[i:j], n[i:j], hot[i:j]
        x, y = np.searchsorted(b, [f.starts[d], f.ends[d]])
        db, de, at = b[x:y], e[x:y], f.starts[d]
        for s in [*p[h].tolist(), None]:
            if s is not None and (s < at or (s - at) % k):
                continue
            u, v = np.searchsorted(p, at), len(p) if s is None else np.searchsorted(p, s)
            on = u + np.flatnonzero((p[u:v] - at) % k == 0)
            out.append((p[on], p[on] + k, c[on]))
            if s is not None:
                over = np.sort(de[: np.searchsorted(db, s, "right")][de[: np.searchsorted(db, s, "right")] >= s + k])
                end, more = int(over[-most]), int((over > over[-most]).sum())
                if more:
                    out.append((np.array([s]), np.array([end + 1]), np.array([more])))
                at = end + 1
    return _spans_out(f, *(np.concatenate(x) for x in zip(*out, strict=True)))


def _extended(f: Found) -> tuple[np.ndarray, ...]:
    """Each match extended to the left, then from that score to the right: score, and begins and lengths in the read and the item."""
    score, dt, dq = kernels.extended_many(f.q, f.b - 1, f.qbeg, f.codes, f.r - 1, f.rbeg, f.n, -1)
    b, r = f.b + f.n, f.r + f.n
    score, et, eq = kernels.extended_many(f.q, b, f.ends[f.row] - b, f.codes, r, f.item_ends[f.item] - r, score)
    return score, f.qbeg - dq, dq + f.n + eq, f.rbeg - dt, dt + f.n + et


def extensions(f: Found) -> tuple:
    return f.row, [f.id, f.qbeg, f.rbeg, f.n, *_extended(f)]


def cigars(f: Found) -> tuple:
    """Each different region that a match extends to, aligned from end to end; equal texts have but matches."""
    _, qb, qn, rb, rn = _extended(f)
    order = np.lexsort((rn, rb, qn, qb, f.pair))
    o = order[news(*(x[order] for x in (f.pair, qb, qn, rb, rn)))]
    row, item, qb, qn, rb, rn = (x[o] for x in (f.row, f.item, qb, qn, rb, rn))
    same = qn == rn
    q0, r0 = f.starts[row] + qb, f.item_starts[item] + rb
    differ = np.zeros(len(o) + 1, np.int64)
    for s in blocks(qn * same, HELD):
        n = qn[s] * same[s]
        unlike = f.q[ranges(q0[s], n)] != f.codes[ranges(r0[s], n)]
        differ[1:][s] = np.bincount(np.repeat(np.arange(len(n)), n), unlike, len(n))
    differ, known, told = differ[1:], {}, []
    for k, (d, i, n) in enumerate(zip(row.tolist(), item.tolist(), qn.tolist(), strict=True)):
        if same[k] and not differ[k]:
            told.append((f"{n}M", 0, n * kernels.MATCH))
            continue
        two = f.texts[d][qb[k] : qb[k] + n], f.refs[i][rb[k] : rb[k] + rn[k]]
        if two not in known:
            known[two] = kernels.global_cigar(*two)
        told.append(known[two])
    return row, [f.ids[item], qb, qb + qn, rb, rb + rn, *(list(x) for x in (zip(*told, strict=True) if told else ([], [], [])))]


def local(f: Found, short: Matcher) -> tuple:
    """Best local score of a read and each item that it has a match with, and its ends; of equal ones, the first in the item, then in the read.

    All that a best alignment begins with is above 0, so it begins with more
    matches than a mismatch costs, and at the begin of a run of them: from
    every such run's begin on, all that stays above 0 is followed. ``f`` has
    matches longer than what ``begins`` leaves out can score.
    """
    if f.k * kernels.MATCH <= kernels.OPEN + kernels.EXTEND:
        raise ValueError("matches are too short")
    g, items, k = Found(f.keys, f.texts, f.null), max(len(f.ids), 1), short.k
    pairs, found = np.unique(f.pair), [(np.zeros(0, np.int64),) * 3]
    for q0, r0, pair in short.begins(g, pairs):
        at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
        on = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
        found.append((q0[on], r0[on], at[on]))
    q0, r0, at = (np.concatenate(x) for x in zip(*found, strict=True))
    row, item = pairs[at] // items, pairs[at] % items
    q0, r0, start = q0 + k, r0 + k, np.full(len(at), k * kernels.MATCH)
    score, dt, dq = kernels.extended_many(g.q, q0, g.ends[row] - q0, short.codes, r0, short.ends[item] - r0, start, zdrop=1 << 40)
    t_end, q_end = r0 + dt - short.starts[item], q0 + dq - g.starts[row]
    order = np.lexsort((q_end, t_end, -score, at))
    o = order[news(at[order])] if len(order) else order
    return pairs // items, [f.ids[pairs % items], score[o], t_end[o], q_end[o]]
