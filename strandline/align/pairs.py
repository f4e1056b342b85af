"""Pairs of reads: orientation, insert sizes, choosing the best pair, rescue of mates, and the qualities of paired hits."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from strandline.align import kernels, regions
from strandline.align.options import Options
from strandline.align.regions import Region

# Pairs that an orientation needs, its share of the commonest one, the score that a rival may have, and
# the bounds of the insert sizes, in quartile distances and deviations.
LEAST_PAIRS, LEAST_SHARE, RIVAL, TRIM, WINDOW, DEVIATIONS = 10, 0.05, 0.8, 2.0, 3.0, 4.0
#: Orientations 0 to 3.
NAMES = ("FF", "FR", "RF", "RR")


@dataclass(frozen=True)
class Insert:
    """The insert sizes of one orientation."""

    low: int = 0
    high: int = 0
    failed: bool = True
    mean: float = 0.0
    std: float = 0.0


def orientation(a: Region, b: Region, length: int) -> tuple[int, int]:
    """(orientation, distance) of two hits on one contig of ``length``."""
    p2 = b.rb if a.rev == b.rev else length - 1 - b.rb
    return (a.rev != b.rev) ^ (0 if p2 > a.rb else 3), abs(p2 - a.rb)


def runner_up(a: list[Region], o: Options) -> int:
    """The score of the first hit that overlaps the best on the read, or of one seed."""
    top = a[0]
    for r in a[1:]:
        common = min(top.qe, r.qe) - max(top.qb, r.qb)
        if common > 0 and common >= o.mask * min(top.qe - top.qb, r.qe - r.qb):
            return r.score
    return o.seed * o.match


def candidate(a: list[Region], b: list[Region], lengths: dict[int, int], o: Options) -> tuple[int, int] | None:
    """(orientation, insert size) of a pair whose ends are each unique enough, on one contig and near."""
    if not a or not b or a[0].rid != b[0].rid or any(runner_up(x, o) > RIVAL * x[0].score for x in (a, b)):
        return None
    way, size = orientation(a[0], b[0], lengths[a[0].rid])
    return (way, size) if 0 < size <= o.max_ins else None


def fitted(counts: dict[tuple[int, int], int]) -> list[Insert]:
    """The four orientations, from counts by (orientation, size)."""
    totals = [sum(n for (w, _), n in counts.items() if w == way) for way in range(4)]
    out = []
    for way, total in enumerate(totals):
        if total < LEAST_PAIRS or total < LEAST_SHARE * max(totals):
            out.append(Insert())
            continue
        sizes = sorted((size, n) for (w, size), n in counts.items() if w == way)

        def at(rank: int, sizes=sizes) -> int:
            for size, n in sizes:
                rank -= n
                if rank < 0:
                    return size
            return sizes[-1][0]

        p25, p50, p75 = (at(int(p * total + 0.499)) for p in (0.25, 0.5, 0.75))
        low, high = max(1, int(p25 - TRIM * (p75 - p25) + 0.499)), int(p75 + TRIM * (p75 - p25) + 0.499)
        inner = [(size, n) for size, n in sizes if low <= size <= high]
        many = sum(n for _, n in inner)
        mean = sum(size * n for size, n in inner) / many
        std = math.sqrt(sum(n * (size - mean) ** 2 for size, n in inner) / many)
        low, high = int(p25 - WINDOW * (p75 - p25) + 0.499), int(p75 + WINDOW * (p75 - p25) + 0.499)
        if low > mean - DEVIATIONS * std:
            low = int(mean - DEVIATIONS * std + 0.499)
        if high < mean + DEVIATIONS * std:
            high = int(mean + DEVIATIONS * std + 0.499)
        out.append(Insert(max(low, 1), high, False, mean, std))
    return out


def given(insert: tuple[float, ...]) -> list[Insert]:
    """The model of a stated mean, deviation, most and least: inward pairs only."""
    mean = insert[0]
    std = insert[1] if len(insert) > 1 else 0.1 * mean
    high = insert[2] if len(insert) > 2 else mean + 4 * std
    low = insert[3] if len(insert) > 3 else mean - 4 * std
    return [Insert(), Insert(max(1, int(low + 0.499)), int(high + 0.499), False, mean, std), Insert(), Insert()]


def pair_score(s1: int, s2: int, distance: float, model: Insert, o: Options) -> int:
    """Score of two hits at a distance; never below 0, and 0 if one of them scores below 0."""
    if s1 < 0 or s2 < 0:
        return 0
    z = abs(distance - model.mean) / model.std if model.std > 0 else 0.0
    tail = math.erfc(z * math.sqrt(0.5))
    return max(0, int(s1 + s2 + 0.721 * math.log(2 * tail) * o.match + 0.499)) if tail > 0 else 0


def tie_key(first: int, second: int, ident: int) -> int:
    """The hash that decides between pairs of one score, from the places of their hits and the pair's number."""
    shifted = ident << 8 & 0xFFFFFFFF
    signed = shifted - (1 << 32) if shifted >> 31 else shifted
    return regions.mixed(((first << 32 | second) ^ signed) & (1 << 64) - 1) & 0xFFFFFFFF


def best_pair(a: list[list[Region]], plain: list[int], models: list[Insert], lengths: dict[int, int], o: Options, ident: int) -> tuple[int, int, int, tuple[int, int]]:
    """(score, runner-up, pairs near the runner-up, places of the two hits) of the best pair of hits that aren't ALT; score 0 if none fits."""
    hits = []
    for end in (0, 1):
        for i, r in enumerate(a[end][: plain[end]]):
            place = r.rb if not r.rev else lengths[r.rid] - 1 - r.rb
            hits.append((r.rid, place, r.score, i, r.rev, end))
    hits.sort()
    found = []
    begin = 0
    reach = max((m.high for m in models if not m.failed), default=0)
    for i, (rid, place, score, _, rev, end) in enumerate(hits):
        while hits[begin][0] != rid or place - hits[begin][1] > reach:
            begin += 1
        for k in range(begin, i):
            _, other, score2, _, rev2, end2 = hits[k]
            model = models[rev2 << 1 | rev]
            if end2 != end and not model.failed and model.low <= place - other <= model.high:
                found.append((pair_score(score, score2, place - other, model, o), tie_key(k, i, ident), k, i))
    if not found:
        return 0, 0, 0, (0, 0)
    found.sort()
    q, _, k, i = found[-1]
    sub = found[-2][0] if len(found) > 1 else 0
    near = sum(sub - x[0] <= o.near for x in found[:-1])
    ends = {hits[x][5]: hits[x][3] for x in (k, i)}
    return q, sub, near, (ends[0], ends[1])


@dataclass
class Resolved:
    """How a pair is written: whether as a pair, each end's hit and quality, and the flag bits that both have."""

    paired: bool
    places: tuple[int, int] = (0, 0)
    quality: tuple[int, int] = (0, 0)
    flag: int = 1


def resolved(a: list[list[Region]], plain: list[int], models: list[Insert], lengths: dict[int, int], o: Options, ident: int) -> Resolved:
    """The best pair against the two ends apart; changes sub and secondary marks of the hits chosen."""
    if o.no_pairing or not plain[0] or not plain[1]:
        return Resolved(False)
    score, sub, near, z = best_pair(a, plain, models, lengths, o, ident)
    if score <= 0 or any(r.secondary < 0 and r.score >= o.least for end in (0, 1) for r in a[end][1 : plain[end]]):
        return Resolved(False)
    apart = a[0][0].score + a[1][0].score - o.unpaired
    rival = max(sub, apart)
    if o.capped_sub:
        rival = max(rival, *(score - a[e][z[e]].score + a[e][z[e]].csub for e in (0, 1) if a[e][z[e]].capped_w), 0)
    margin = score - rival
    if o.meth:
        second = [a[e][1].score if plain[e] > 1 else 0 for e in (0, 1)]
        margin = min(margin, score + 4 * o.match - sum(second))
    q = regions.raw_mapq(max(margin, 0), o)
    if near > 0:
        q -= int(4.343 * math.log(near + 1) + 0.499)
    q = int(min(max(q, 0), 60) * (1 - 0.5 * (a[0][0].frac_rep + a[1][0].frac_rep)) + 0.499)
    flag = 1
    if score > apart:
        flag |= 2
        quality = []
        for e in (0, 1):
            r = a[e][z[e]]
            if r.secondary >= 0:
                r.sub, r.secondary = a[e][r.secondary].score, -2
            own = regions.mapq(r, o)
            own = max(own, min(q, own + 40))
            quality.append(max(0, min(own, regions.raw_mapq(r.score - r.csub, o))))
    else:
        z = (0, 0)
        quality = [regions.mapq(a[e][0], o) for e in (0, 1)]
    if o.project and o.project_gap > 0 and flag & 2 and any(a[e][z[e]].lift_band for e in (0, 1)):
        cap = min(60, regions.raw_mapq(max(0, score - rival - o.project_gap * o.match), o))
        quality = [min(x, cap) for x in quality]
    for e in (0, 1):
        k = a[e][z[e]].secondary_all
        if 0 <= k < plain[e]:
            for j, r in enumerate(a[e]):
                if r.secondary_all == k or j == k:
                    r.secondary_all = z[e]
            a[e][z[e]].secondary_all = -1
    return Resolved(True, z, (quality[0], quality[1]), flag)


def proper(a: Region | None, b: Region | None, models: list[Insert], lengths: dict[int, int]) -> bool:
    """Whether two hits, not chosen as a pair, still lie as pairs do."""
    if a is None or b is None or a.rid != b.rid:
        return False
    way, distance = orientation(a, b, lengths[a.rid])
    m = models[way]
    return not m.failed and m.low <= distance <= m.high


def anchors(a: list[Region], o: Options) -> list[Region]:
    """The hits of an end, at most ``rescue``, that are near enough to its best to look for the mate from."""
    return [r for r in a if r.score >= a[0].score - o.unpaired][: o.rescue]


@dataclass(frozen=True)
class Window:
    """Where a mate is looked for: orientation, whether it is turned around, and [rb, re) in the anchor's frame."""

    way: int
    turned: bool
    rb: int
    re: int


def windows(anchor: Region, mates: list[Region], length: int, models: list[Insert], lengths: dict[int, int], o: Options) -> list[Window]:
    """A window for each orientation that is fitted and that no hit of the mate has already."""
    out = []
    met = {orientation(anchor, r, lengths[r.rid]) for r in mates if r.rid == anchor.rid}
    for way, m in enumerate(models):
        if m.failed or any(w == way and m.low <= d <= m.high for w, d in met):
            continue
        turned, after = (way >> 1) != (way & 1), not way >> 1
        near, far = (anchor.rb + m.low, anchor.rb + m.high) if after else (anchor.rb - m.high, anchor.rb - m.low)
        rb, re = (near - length, far) if turned else (near, far + length)
        rb, re = max(rb, 0), min(re, lengths[anchor.rid])
        if re - rb >= o.seed:
            out.append(Window(way, turned, rb, re))
    return out


def votes(query: str, target: str, k: int) -> tuple[int, int]:
    """(diagonal, votes) of the commonest target-minus-read diagonal, each k-mer of the read counted at its newest place only."""
    newest = {query[i : i + k]: i for i in range(len(query) - k + 1)}
    count: dict[int, int] = {}
    for j in range(len(target) - k + 1):
        i = newest.get(target[j : j + k])
        if i is not None:
            count[j - i] = count.get(j - i, 0) + 1
    best = min(count, key=lambda d: (-count[d], d), default=0)
    return best, count.get(best, 0)


#: Votes for a band, its width, and what a rescue needs that ``declined`` lets through. Fixed values.
LEAST_VOTES, HALF_BAND, FEW_VOTES, FEW_SHARE = 3, 50, 10, 0.33


def narrowed(query: str, target: str, k: int) -> tuple[int, int] | None:
    """The part of the target around the diagonal that the k-mers vote for; None without enough votes or if it is shorter than the read."""
    diagonal, n = votes(query, target, k)
    begin, end = max(0, diagonal - HALF_BAND), min(len(target), diagonal + len(query) + HALF_BAND)
    return (begin, end) if n >= LEAST_VOTES and end - begin >= len(query) else None


def declined(n: int, kmers: int) -> bool:
    """Whether so few votes make a rescue not worth its while."""
    return n < FEW_VOTES and n < FEW_SHARE * kmers


def rescued(anchor: Region, mate: str, w: Window, ref: str, length: int, o: Options, kmer: int = 0) -> Region | None:
    """The mate's best local alignment in a window (reference text ``ref``), if it scores a seed or more."""
    query = kernels.revcomp(mate) if w.turned else mate
    begin = 0
    if kmer and (part := narrowed(query, ref, kmer)):
        begin, end = part
        ref = ref[begin:end]
    hit = kernels.local(kernels.encoded(query), kernels.encoded(ref), kernels.Scores.of(o), o.seed * o.match)
    if hit.score < o.seed:
        return None
    rb, re = w.rb + begin + hit.tb, w.rb + begin + hit.te
    qb, qe, text, rev = hit.qb, hit.qe, ref[hit.tb : hit.te], anchor.rev
    if w.turned:
        qb, qe = len(mate) - hit.qe, len(mate) - hit.qb
        rb, re, text, rev = length - re, length - rb, kernels.revcomp(text), 1 - rev
    return Region(anchor.rid, rev, rb, re, qb, qe, hit.score, text, hit.score, csub=hit.second, seedcov=min(re - rb, qe - qb) >> 1, is_alt=anchor.is_alt)


def with_rescues(a: list[list[Region]], reads: list[str], models: list[Insert], lengths: dict[int, int], o: Options, text_of: Callable[[int, int, int, int], str | None], kmer: int = 0) -> list[list[Region]]:
    """Both ends' hits with those found near the other end's best; anchors go in order, and what one finds spares later ones the search.

    ``text_of(rid, rev, rb, re)`` gives reference text, or None.
    """
    if o.no_rescue:
        return a
    a = [list(x) for x in a]
    starts = [anchors(x, o) if x else [] for x in a]
    for end in (0, 1):
        mates = a[1 - end]
        for anchor in starts[end]:
            for w in windows(anchor, mates, len(reads[1 - end]), models, lengths, o):
                ref = text_of(anchor.rid, anchor.rev, w.rb, w.re)
                hit = ref and rescued(anchor, reads[1 - end], w, ref, lengths[anchor.rid], o, kmer)
                if hit:
                    mates = regions.deduped([*mates, hit], o)
        a[1 - end] = mates
    return a
