"""Regions of one read: extension of chains, redundancy, patching, primary marking and mapping quality."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, replace

import numpy as np

from strandline.align import kernels
from strandline.align.chains import Chain, screened
from strandline.align.options import Options

#: A secondary hit of an ALT hit alone.
OF_ALT = 1 << 30


@dataclass
class Region:
    """A hit in the frame of its strand: reference [rb, re), read [qb, qe); ``ref`` is the reference of this span, by its strand."""

    rid: int
    rev: int
    rb: int
    re: int
    qb: int
    qe: int
    score: int
    ref: str = ""
    truesc: int = 0
    sub: int = 0
    csub: int = 0
    sub_n: int = 0
    alt_sc: int = 0
    seedcov: int = 0
    w: int = 0
    is_alt: bool = False
    secondary: int = -1
    secondary_all: int = -1
    frac_rep: float = 0.0
    hits: int = 1
    joined: int = 0
    capped_w: int = 0
    tie: int = 0
    #: Before an ALT hit was lifted: its contig; and the band that the lifted alignment needs.
    lifted_from: int = -1
    lift_band: int = 0


def extended(c: Chain, query: str, window: str, start: int, o: Options) -> list[Region]:
    """One region per seed, longest seeds first, each extended to the left, then to the right, with both bands doubled once if the end needs it.

    ``window`` is the strand's reference from ``start`` on, around the chain. A
    seed that lies on an earlier region's diagonal is skipped unless another
    long seed overlaps it on another diagonal.
    """
    s = kernels.Scores.of(o)
    q, t = kernels.encoded(query), kernels.encoded(window)
    c = screened(c, q, t, start, o, s)
    out: list[Region] = []
    done: list = []
    for seed in sorted(c.seeds, key=lambda x: (-x.size, x.qbeg)):
        if any(_within(seed, r, len(query), o) for r in out) and not any(_crosses(seed, x) for x in done):
            continue
        done.append(seed)
        at, size = seed.rbeg - start, seed.size
        r = Region(seed.rid, seed.rev, 0, 0, 0, 0, size * o.match, is_alt=c.is_alt, frac_rep=c.frac_rep, hits=seed.hits, capped_w=c.capped_w)
        left = _both_bands(q[: seed.qbeg][::-1], t[:at][::-1], s, r.score, o, o.clip5)
        r.score, dq, dt, low = left
        r.qb, r.rb = seed.qbeg - dq, seed.rbeg - dt
        before = r.score
        right = _both_bands(q[seed.qbeg + size :], t[at + size :], s, r.score, o, o.clip3)
        r.score, dq, dt, high = right
        r.qe, r.re = seed.qbeg + size + dq, seed.rbeg + size + dt
        r.truesc, r.w = r.score, max(low, high)
        r.seedcov = sum(x.size for x in c.seeds if r.qb <= x.qbeg and x.qbeg + x.size <= r.qe and r.rb <= x.rbeg and x.rbeg + x.size <= r.re)
        r.ref = window[r.rb - start : r.re - start]
        if before >= 0:
            out.append(r)
    return out


def _both_bands(q: np.ndarray, t: np.ndarray, s: kernels.Scores, score: int, o: Options, clip: int) -> tuple[int, int, int, int]:
    """(score, read and reference taken, band): to the read's end unless stopping earlier scores more by over ``clip``."""
    if not len(q):
        return score, 0, 0, o.band
    found, band = None, o.band
    for band in (o.band, 2 * o.band):
        last, found = found, kernels.extend(q, t[: len(q) + band + 1], s, score, band)
        if last and last.score == found.score or abs(found.target - found.query) < band * 3 // 4:
            break
    if found.end_score <= 0 or found.end_score <= found.score - clip:
        return found.score, found.query, found.target, band
    return found.end_score, len(q), found.end_target, band


def _within(x, r: Region, length: int, o: Options) -> bool:
    if (x.rid, x.rev) != (r.rid, r.rev) or not (r.rb <= x.rbeg and x.rbeg + x.size <= r.re and r.qb <= x.qbeg and x.qbeg + x.size <= r.qe):
        return False
    if x.size > 0.1 * length and x.size * o.match > r.score:
        return False

    def near(dq: int, dt: int) -> bool:
        gap = min(dq, dt)
        most = max(1, int((gap * o.match - o.open_ins) / o.extend_ins + 1))
        return abs(dq - dt) < min(most, r.w or o.band)

    return near(x.qbeg - r.qb, x.rbeg - r.rb) or near(r.qe - x.qbeg - x.size, r.re - x.rbeg - x.size)


def _crosses(x, y) -> bool:
    """Whether a seed taken before overlaps a shorter or equal one by a quarter on another diagonal."""
    if y.size < 0.95 * x.size or (x.rid, x.rev) != (y.rid, y.rev):
        return False
    a, b = (x, y) if x.qbeg <= y.qbeg else (y, x)
    return a.qbeg + a.size - b.qbeg >= x.size >> 2 and b.qbeg - a.qbeg != b.rbeg - a.rbeg


def patched(a: Region, b: Region, query: str, between: str, o: Options) -> tuple[int, int]:
    """(score, band) of regions a and b of one strand as one, a before b; (0, 0) if they aren't colinear or score under 0.9 of what they promise.

    ``between`` is the reference from a's begin to b's end.
    """
    if a.qb >= b.qb or a.qe >= b.qe or a.re >= b.re:
        return 0, 0
    gap_r, gap_q = a.re - b.rb, a.qe - b.qb
    w = abs(gap_r - gap_q)
    r = abs(gap_r / (b.re - a.rb) - gap_q / (b.qe - a.qb))
    apart = a.re < b.rb or a.qe < b.qb
    if w > (2 if apart else 4) * o.band or np.float32(r) >= np.float32(0.05 if apart else 0.10) + np.float32(1e-9):
        return 0, 0
    w = min(w + a.w + b.w, 4 * o.band)
    score = kernels.aligned(kernels.encoded(query[a.qb : b.qe]), kernels.encoded(between), kernels.Scores.of(o), w)[0]
    total = a.score + b.score
    want_q = int((b.qe - a.qb) / ((b.qe - b.qb) + (a.qe - a.qb)) * total + 0.499)
    want_r = int((b.re - a.rb) / ((b.re - b.rb) + (a.re - a.rb)) * total + 0.499)
    return (score, w) if np.float32(score) >= np.float32(0.9) * max(want_q, want_r) else (0, 0)


def deduped(regions: list[Region], o: Options, query: str = "", slice_of=None) -> list[Region]:
    """Without redundant regions, colinear ones joined, by score, rb and qb.

    Regions go by (re, rb, score, qb); of two of one strand that share over
    ``redundant`` of the shorter span on reference and read, the lower score
    falls, and on a tie the earlier. ``slice_of(rid, rev, rb, re)`` gives
    reference text, or None where it isn't at hand; without it nothing is joined.
    """
    order = sorted(regions, key=lambda r: (r.rid, r.rev, r.re, r.rb, -r.score, r.qb))
    gone: set[int] = set()
    for i, p in enumerate(order):
        for j in range(i - 1, -1, -1):
            x = order[j]
            if (x.rid, x.rev) != (p.rid, p.rev) or p.rb >= x.re + o.chain_gap:
                break
            if j in gone:
                continue
            on_ref = x.re - p.rb
            on_read = x.qe - p.qb if x.qb < p.qb else p.qe - x.qb
            if on_ref > o.redundant * min(x.re - x.rb, p.re - p.rb) and on_read > o.redundant * min(x.qe - x.qb, p.qe - p.qb):
                if p.score < x.score:
                    gone.add(i)
                    break
                gone.add(j)
            elif slice_of and x.rb < p.rb and (ref := slice_of(p.rid, p.rev, x.rb, p.re)) is not None:
                score, w = patched(x, p, query, ref, o)
                if score > 0:
                    order[i] = p = replace(p, rb=x.rb, qb=x.qb, ref=ref, score=score, truesc=score, w=w, joined=p.joined + x.joined + 1, seedcov=max(p.seedcov, x.seedcov), sub=max(p.sub, x.sub), csub=max(p.csub, x.csub))
                    gone.add(j)
    left = sorted((r for i, r in enumerate(order) if i not in gone), key=lambda r: (-r.score, r.rb, r.qb, r.rid, r.rev))
    return [r for i, r in enumerate(left) if not i or (r.score, r.rid, r.rev, r.rb, r.qb) != (left[i - 1].score, left[i - 1].rid, left[i - 1].rev, left[i - 1].rb, left[i - 1].qb)]


def mixed(key: int) -> int:
    """A 64-bit integer mix."""
    whole = (1 << 64) - 1
    # Shifts, and whether each is added inverted, added, or xored from the right.
    for kind, n in (("~", 32), ("^", 22), ("~", 13), ("^", 8), ("+", 3), ("^", 15), ("~", 27), ("^", 31)):
        if kind == "^":
            key ^= key >> n
        else:
            more = key << n & whole
            key = key + (more ^ whole if kind == "~" else more) & whole
    return key


def tie_id(o: Options, name: str, index: int) -> int:
    """What breaks ties of a read: its number, or a 23-bit hash of its name."""
    return zlib.crc32(name.encode()) & 0x7FFFFF if o.tie_by_name else index


def _marked(a: list[Region], o: Options) -> None:
    """Sets secondary (the place of the first higher primary that covers ``mask`` of the shorter), sub and sub_n."""
    heads: list[int] = []
    for i, r in enumerate(a):
        for j in heads:
            h = a[j]
            common = min(h.qe, r.qe) - max(h.qb, r.qb)
            if common > 0 and common >= min(h.qe - h.qb, r.qe - r.qb) * o.mask:
                h.sub = h.sub or r.score
                h.sub_n += h.score - r.score <= o.near and (h.is_alt or not r.is_alt)
                r.secondary = j
                break
        else:
            heads.append(i)


def marked(a: list[Region], o: Options, ident: int) -> tuple[list[Region], int]:
    """Regions by score and hash, with primaries and secondaries marked, and how many aren't ALT; ALT hits come last and don't compete."""
    for i, r in enumerate(a):
        r.sub = r.sub_n = r.alt_sc = 0
        r.secondary = r.secondary_all = -1
        r.tie = mixed(ident + i & (1 << 64) - 1)
    a = sorted(a, key=lambda r: (-r.score, r.is_alt, r.tie))
    _marked(a, o)
    plain = sum(not r.is_alt for r in a)
    for r in a:
        if not r.is_alt and r.secondary >= 0 and a[r.secondary].is_alt:
            r.alt_sc = a[r.secondary].score
    if plain in (0, len(a)):
        for r in a:
            r.secondary_all = r.secondary
            if r.is_alt and r.secondary >= 0 and plain != len(a):
                r.secondary = OF_ALT
        return a, plain
    heads = [a[r.secondary] if r.secondary >= 0 else None for r in a]
    pairs = sorted(zip(a, heads, strict=True), key=lambda x: (x[0].is_alt, -x[0].score, x[0].tie))
    a = [r for r, _ in pairs]
    place = {id(r): i for i, r in enumerate(a)}
    for r, head in pairs:
        r.secondary_all = place[id(head)] if head is not None else -1
        if r.is_alt:
            r.secondary = OF_ALT if head is not None else -1
        else:
            r.sub = r.sub_n = 0
            r.secondary = -1
    _marked(a[:plain], o)
    return a, plain


def with_capped_sub(a: list[Region], o: Options) -> None:
    """A chain that wasn't extended counts as a rival of the best, never above it."""
    if o.capped_sub and a and a[0].capped_w:
        a[0].csub = max(a[0].csub, min(a[0].capped_w * o.match, a[0].score - 1))


def reordered(a: list[Region], o: Options) -> list[Region]:
    """The primary that begins first on the read comes first."""
    own = [i for i, r in enumerate(a) if r.secondary < 0 and not r.is_alt and r.score >= o.least]
    if len(own) < 2:
        return a
    first = min(own, key=lambda i: (a[i].qb, i))
    if not first:
        return a
    a = list(a)
    a[0], a[first] = a[first], a[0]
    swap = {0: first, first: 0}
    for r in a:
        r.secondary, r.secondary_all = swap.get(r.secondary, r.secondary), swap.get(r.secondary_all, r.secondary_all)
    return a


def raw_mapq(margin: float, o: Options) -> int:
    return int(6.02 * margin / o.match + 0.499)


def mapq(r: Region, o: Options) -> int:
    """Mapping quality of a region by itself, 0 to 60."""
    rival = max(r.sub or o.seed * o.match, r.csub)
    if rival >= r.score:
        return 0
    span = max(r.qe - r.qb, r.re - r.rb)
    identity = 1 - (span * o.match - r.score) / (o.match + o.mismatch) / span
    if not r.score:
        q = 0
    elif o.span50 > 0:
        t = (1 if span < o.span50 else int(math.log(o.span50)) / math.log(span)) * identity * identity
        q = int(6.02 * (r.score - rival) / o.match * t * t + 0.499)
    else:
        q = int(30 * (1 - rival / r.score) * math.log(max(r.seedcov, 1)) + 0.499)
        if identity < 0.95:
            q = int(q * identity * identity + 0.499)
    if r.sub_n > 0:
        q -= int(4.343 * math.log(r.sub_n + 1) + 0.499)
    return int(min(max(q, 0), 60) * (1 - r.frac_rep) + 0.499)


def emitted(r: Region, a: list[Region], o: Options) -> bool:
    """Whether a region becomes a record of a single read."""
    if r.score < o.least or r.secondary >= 0 and (r.is_alt or not o.all_hits):
        return False
    return not (0 <= r.secondary < OF_ALT and r.score < a[r.secondary].score * o.drop)


def first_alt(a: list[Region], plain: int, o: Options) -> int:
    """The place of the first ALT hit that becomes a supplementary record, or -1."""
    return next((i for i in range(plain, len(a)) if a[i].score >= o.least and a[i].secondary < 0), -1)
