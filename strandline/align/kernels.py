"""Dynamic programming with a score matrix, by NumPy rows: extension, local and global alignment."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from strandline.align.options import Options

LETTERS = "ACGTN"
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i
DEAD = -(1 << 29)


def encoded(seq: str) -> np.ndarray:
    """A, C, G, T as 0 to 3 in either case, anything else 4."""
    return _CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def revcomp(seq: str) -> str:
    return seq.translate(_COMPLEMENT)[::-1]


_COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")


def matrix(match: int, mismatch: int) -> np.ndarray:
    """Scores by target and query code; anything against N costs 1."""
    m = np.full((5, 5), -mismatch, np.int64)
    np.fill_diagonal(m, match)
    m[4, :] = m[:, 4] = -1
    return m


@dataclass(frozen=True)
class Scores:
    mat: np.ndarray
    open_del: int
    extend_del: int
    open_ins: int
    extend_ins: int
    zdrop: int
    match: int

    @staticmethod
    def of(o: Options) -> "Scores":
        return Scores(matrix(o.match, o.mismatch), o.open_del, o.extend_del, o.open_ins, o.extend_ins, o.zdrop, o.match)


def _gaps(m: np.ndarray, s: Scores, floor: int) -> np.ndarray:
    """Best insertion that ends at each column, from the values ``m`` of the columns before it."""
    steps = np.arange(len(m)) * s.extend_ins
    f = np.full(len(m), floor)
    if len(m) > 1:
        f[1:] = np.maximum.accumulate(m + steps)[:-1] - s.open_ins - steps[1:]
    return f


@dataclass
class Extension:
    score: int
    query: int
    target: int
    end_score: int
    end_target: int


def extend(q: np.ndarray, t: np.ndarray, s: Scores, start: int, band: int) -> Extension:
    """Extension to the right from score ``start``: the best score and what it takes, and the best that takes all of the query.

    A gap opens from a match only, so no insertion touches a deletion. It ends
    where no score is above 0, or the best of a row is more than ``zdrop``, the
    gap between the two not counted, under the best of all.
    """
    n = len(q)
    cols = np.arange(n + 1)
    h = np.where(cols, start - s.open_ins - s.extend_ins * cols, start)
    h[(h <= 0) | (cols > band)] = 0
    e = np.zeros(n + 1, np.int64)
    best, bi, bj = start, 0, 0
    end, end_t = (int(h[n]), 0) if n == 0 else (-1, 0)
    for i, c in enumerate(t.tolist(), 1):
        m = np.zeros(n + 1, np.int64)
        m[1:] = np.where(h[:-1] > 0, h[:-1] + s.mat[c][q], 0)
        if i <= band:
            first = start - s.open_del - s.extend_del * i
            e[0] = max(first, 0)
        h = np.maximum(np.maximum(m, e), np.maximum(_gaps(np.where(m > 0, m, DEAD), s, 0), 0))
        h[np.abs(cols - i) > band] = 0
        e = np.maximum(np.maximum(e - s.extend_del, m - s.open_del - s.extend_del), 0)
        if h[n] > 0 and h[n] >= end and i + band >= n:
            end, end_t = int(h[n]), i
        j = n - int(np.argmax(h[::-1]))
        top = int(h[j])
        if top <= 0:
            break
        if top > best:
            best, bi, bj = top, i, j
        elif s.zdrop > 0:
            off = (i - bi) - (j - bj)
            if best - top - (off * s.extend_del if off > 0 else -off * s.extend_ins) > s.zdrop:
                break
    return Extension(best, bj, bi, end, end_t)


@dataclass
class Local:
    score: int
    qb: int
    qe: int
    tb: int
    te: int
    second: int


def _local_rows(q: np.ndarray, t: np.ndarray, s: Scores) -> tuple[int, int, int, list[tuple[int, int]]]:
    n = len(q)
    h, e = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    best, te, qe, tops = 0, 0, 0, []
    for i, c in enumerate(t.tolist(), 1):
        e = np.maximum(np.maximum(e, h - s.open_del) - s.extend_del, 0)
        m = np.zeros(n + 1, np.int64)
        m[1:] = h[:-1] + s.mat[c][q]
        m = np.maximum(np.maximum(m, e), 0)
        h = np.maximum(m, _gaps(m, s, 0))
        j = int(np.argmax(h))
        tops.append((int(h[j]), i))
        if h[j] > best:
            best, te, qe = int(h[j]), i, j
    return best, te, qe, tops


def local(q: np.ndarray, t: np.ndarray, s: Scores, least: int = 0) -> Local:
    """Best local alignment, begins and ends (exclusive), and the best score of ``least`` or more that ends elsewhere on the target.

    Elsewhere is farther from the end than the characters that the score needs.
    """
    best, te, qe, tops = _local_rows(q, t, s)
    if not best:
        return Local(0, 0, 0, 0, 0, 0)
    back, tb, qb, _ = _local_rows(q[:qe][::-1], t[:te][::-1], s)
    reach = -(-best // s.match)
    second = max((x for x, i in tops if x >= max(least, 1) and abs(i - te) > reach), default=0)
    return Local(best, qe - qb, qe, te - tb, te, second if back == best else 0)


def aligned(q: np.ndarray, t: np.ndarray, s: Scores, band: int = 1 << 30) -> tuple[int, list[tuple[str, int]]]:
    """(score, CIGAR) of a global alignment within a band; gaps as far left as can be."""
    n, m = len(q), len(t)
    band = max(band, abs(n - m) + 3)
    cols = np.arange(n + 1)
    h = np.full((m + 1, n + 1), DEAD, np.int64)
    e, f = h.copy(), h.copy()
    h[0] = np.where(cols, -s.open_ins - s.extend_ins * cols, 0)
    f[0, 1:] = h[0, 1:]
    h[0][cols > band] = f[0][cols > band] = DEAD
    for i in range(1, m + 1):
        e[i] = np.maximum(e[i - 1], h[i - 1] - s.open_del) - s.extend_del
        x = e[i].copy()
        x[1:] = np.maximum(x[1:], h[i - 1, :-1] + s.mat[t[i - 1]][q])
        x[np.abs(cols - i) > band] = DEAD
        f[i] = _gaps(x, s, DEAD)
        h[i] = np.maximum(x, f[i])
        h[i][np.abs(cols - i) > band] = DEAD
    ops: list[list] = []

    def took(op: str) -> None:
        if ops and ops[-1][0] == op:
            ops[-1][1] += 1
        else:
            ops.append([op, 1])

    i, j, state = m, n, "M"
    while i or j:
        if state == "M":
            if i and j and h[i, j] == h[i - 1, j - 1] + s.mat[t[i - 1], q[j - 1]]:
                took("M")
                i, j = i - 1, j - 1
                continue
            state = "D" if i and h[i, j] == e[i, j] else "I"
        took(state)
        if state == "D":
            opened = e[i, j] == h[i - 1, j] - s.open_del - s.extend_del
            i -= 1
        else:
            opened = f[i, j] == h[i, j - 1] - s.open_ins - s.extend_ins
            j -= 1
        if opened:
            state = "M"
    return int(h[m, n]), [(op, k) for op, k in reversed(ops)]


def edits(query: str, target: str, cigar: list[tuple[str, int]]) -> tuple[int, str]:
    """(NM, MD) of an alignment."""
    i = j = nm = run = 0
    md = ""
    for op, k in cigar:
        if op == "M":
            for a, b in zip(query[j : j + k], target[i : i + k], strict=True):
                if a == b and a in "ACGT":
                    run += 1
                else:
                    md, run, nm = f"{md}{run}{b}", 0, nm + 1
            i, j = i + k, j + k
        elif op == "D":
            md, run, nm, i = f"{md}{run}^{target[i : i + k]}", 0, nm + k, i + k
        elif op == "I":
            nm, j = nm + k, j + k
    return nm, f"{md}{run}"
