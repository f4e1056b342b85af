"""Alternative contigs: the lift map of a sidecar, lifting of intervals, and projection of hits to the primary assembly."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from strandline.align.options import Options
from strandline.align.regions import Region

_OPS = re.compile(r"([0-9]+)([MIDNSHP=X])")
#: The widest excursion of a lifted hit's diagonal that is followed. Fixed value.
WIDEST = 1023


@dataclass(frozen=True)
class Lift:
    """One ALT contig on the primary assembly: ops (op, length) in the order of the primary, from ``at`` on."""

    contig: int
    rev: int
    at: int
    length: int
    ops: tuple[tuple[str, int], ...]


def parsed(cigar: str) -> tuple[tuple[str, int], ...] | None:
    """The ops of a CIGAR, or None if it isn't one."""
    ops = [(op, int(n)) for n, op in _OPS.findall(cigar)]
    return tuple(ops) if ops and "".join(f"{n}{op}" for op, n in ops) == cigar else None


def sidecar(lines: list[str], rids: dict[str, int], lengths: dict[int, int]) -> tuple[set[int], dict[int, Lift], dict[str, int]]:
    """(ALT contigs, lifts, skipped lines by reason) of SAM lines; a contig's first usable line counts."""
    alts: set[int] = set()
    lifts: dict[int, Lift] = {}
    skipped: dict[str, int] = {}
    for line in lines:
        if not line.strip() or line.startswith("@"):
            continue
        f = line.rstrip("\r\n").split("\t")
        reason, rid = "", rids.get(f[0])
        if rid is None:
            reason = "contig"
        else:
            alts.add(rid)
            if len(f) < 6:
                reason = "fields"
            elif int(f[1]) & 4 or f[2] not in rids:
                reason = "unmapped"
            elif int(f[1]) & 0x900:
                reason = "secondary"
            elif not (ops := parsed(f[5])):
                reason = "cigar"
            elif sum(n for op, n in ops if op in "MIS=XH") != lengths[rid]:
                reason = "length"
            elif int(f[3]) - 1 + sum(n for op, n in ops if op in "MDN=X") > lengths[rids[f[2]]]:
                reason = "end"
            elif rid in lifts:
                reason = "again"
            else:
                lifts[rid] = Lift(rids[f[2]], int(f[1]) >> 4 & 1, int(f[3]) - 1, lengths[rid], ops)
        if reason:
            skipped[reason] = skipped.get(reason, 0) + 1
    return alts, lifts, skipped


@dataclass(frozen=True)
class Lifted:
    contig: int
    rev: int
    begin: int
    end: int
    aligned: int
    clipped: int
    widest: int
    edge: bool


def lifted(x: Lift, begin: int, end: int) -> Lifted:
    """Where [begin, end) of an ALT contig (forward) lies on the primary: aligned and clipped bases, how far the diagonal strays, and whether an end is in an insertion."""
    if x.rev:
        begin, end = x.length - end, x.length - begin
    q, t = 0, x.at
    aligned = clipped = widest = 0
    start = stop = None
    edge = False
    base = None
    for op, n in x.ops:
        on_q, on_t = op in "MIS=XH", op in "MDN=X"
        lo, hi = max(begin, q), min(end, q + n if on_q else q)
        if on_q and lo < hi:
            if op in "SH":
                clipped += hi - lo
            elif op == "I":
                edge |= lo == begin or hi == end
                if base is not None:
                    widest = max(widest, abs(t - q - (hi - lo) - base))
            else:
                aligned += hi - lo
                if start is None:
                    start, base = t + lo - q, t - q
                stop = t + hi - q
                widest = max(widest, abs(t - q - base))
        elif op in "DN" and begin < q < end and base is not None:
            widest = max(widest, abs(t + n - q - base))
        q, t = q + n * on_q, t + n * on_t
    return Lifted(x.contig, x.rev, start or 0, stop or 0, aligned, clipped, widest, edge)


def same_locus(x: Region, y: Region, o: Options) -> bool:
    if (x.rid, x.rev) != (y.rid, y.rev):
        return False
    on_ref, on_read = min(x.re, y.re) - max(x.rb, y.rb), min(x.qe, y.qe) - max(x.qb, y.qb)
    return on_ref > o.redundant * min(x.re - x.rb, y.re - y.rb) and on_ref > 0 and on_read > 0 and 2 * on_read > min(x.qe - x.qb, y.qe - y.qb)


def replaces(x: Region, p: Region, o: Options) -> bool:
    """Whether a lifted hit outscores a primary one by more than the read's characters are worth that it leaves out."""
    return x.score > p.score + o.match * (max(0, x.qb - p.qb) + max(0, p.qe - x.qe))


def project(a: list[Region], lifts: dict[int, Lift], lengths: dict[int, int], o: Options) -> list[Region]:
    """Hits with those on ALT contigs moved to the primary where the lift describes them, and one hit per locus.

    A lifted hit replaces the primary hits of its locus only if it can replace
    each of them; one that can't stays only where no other hit is kept. With a
    gap, a lifted hit isn't moved if a hit elsewhere on the primary, over half
    of the shorter read span in common, comes that near to it.
    """
    out: list[tuple[Region, int, bool]] = []
    for r in a:
        x = lifts.get(r.rid) if r.is_alt else None
        if x:
            size = lengths[r.rid]
            m = lifted(x, *((size - r.re, size - r.rb) if r.rev else (r.rb, r.re)))
            band = max(_band(r.qe - r.qb, o), abs((m.end - m.begin) - (r.qe - r.qb)) + 3)
            if not m.clipped and not m.edge and 2 * m.aligned >= r.re - r.rb and m.widest <= min(o.band, WIDEST, band):
                rev, there = r.rev ^ m.rev, lengths[m.contig]
                rb, re_ = (there - m.end, there - m.begin) if rev else (m.begin, m.end)
                out.append((replace(r, rid=m.contig, rev=rev, rb=rb, re=re_, is_alt=False, lifted_from=r.rid, lift_band=m.widest + 1, ref=""), r.rid, True))
                continue
        out.append((r, r.rid, False))
    if o.project_gap:
        near = lambda r: any(not p.is_alt and p is not r and _shared(r, p) and not same_locus(r, p, o) and r.score - p.score <= o.project_gap * o.match for p, _, _ in out)
        veto = [up and near(r) for r, _, up in out]
        out = [(a[i], rid, False) if no else (r, rid, up) for i, ((r, rid, up), no) in enumerate(zip(out, veto, strict=True))]
    if not any(up for _, _, up in out):
        return a
    can = {id(r): all(replaces(r, p, o) for p, _, other in out if not other and same_locus(r, p, o)) for r, _, up in out if up}
    order = [(r, up) for r, _, up in sorted(out, key=lambda x: (-x[0].score, x[0].rb, x[0].qb, x[1]))]
    kept: set[int] = set()
    for r, up in order:
        if (not up or can[id(r)]) and not any(id(k) in kept and u and can[id(k)] and same_locus(k, r, o) for k, u in order):
            kept.add(id(r))
    for r, up in order:
        if up and not can[id(r)] and not any(id(k) in kept and same_locus(k, r, o) for k, _ in order):
            kept.add(id(r))
    return [r for r, _ in order if id(r) in kept]


def _band(length: int, o: Options) -> int:
    most = lambda op, ex: int((length * o.match - op) / ex + 1)
    return max(1, (max(most(o.open_ins, o.extend_ins), most(o.open_del, o.extend_del), 1) + 1) >> 1)


def _shared(x: Region, y: Region) -> bool:
    common = min(x.qe, y.qe) - max(x.qb, y.qb)
    return common > 0 and 2 * common > min(x.qe - x.qb, y.qe - y.qb)


def without_unlifted(a: list[Region], o: Options) -> tuple[list[Region], Region | None]:
    """Hits on the primary assembly only, and the best ALT hit that went, with its rivals among the ALT hits."""
    alts = [r for r in a if r.is_alt]
    best = min((r for r in alts if r.score >= o.least), key=lambda r: (-r.score, r.rid, r.rb, r.qb), default=None)
    if best is not None:
        others = [r for r in alts if r is not best and 0 < (c := min(r.qe, best.qe) - max(r.qb, best.qb)) and c >= o.mask * min(r.qe - r.qb, best.qe - best.qb)]
        best = replace(best, sub=max((r.score for r in others), default=0), sub_n=sum(best.score - r.score <= o.near for r in others), alt_sc=0, secondary=-1, secondary_all=-1)
    return [r for r in a if not r.is_alt], best
