"""Dynamic programming of one query against one target, by NumPy rows; and what the operators run in Arrow batches."""

from __future__ import annotations

import numpy as np

MATCH, MISMATCH, OPEN, EXTEND = 1, 4, 6, 1
#: Seeds that are extended together.
TOGETHER = 1 << 13


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def local_score(query: str, target: str) -> tuple[int, int, int]:
    """Best local score with affine gaps, and the ends (exclusive) in target and query; ties take the first end."""
    q, t = codes(query), codes(target)
    best = (0, 0, 0)
    h, e = np.zeros(len(q) + 1, np.int32), np.zeros(len(q) + 1, np.int32)
    steps = np.arange(len(q) + 1, dtype=np.int32) * EXTEND
    for i, c in enumerate(t, 1):
        e[1:] = np.maximum(e[1:], h[1:] - OPEN) - EXTEND
        np.maximum(e, 0, out=e)
        m = np.zeros(len(q) + 1, np.int32)
        m[1:] = np.where(q == c, h[:-1] + MATCH, h[:-1] - MISMATCH)
        m = np.maximum(np.maximum(m, e), 0)
        # a gap in the target reaches column j from the best m[k] - OPEN - EXTEND * (j - k), k < j
        f = np.maximum.accumulate(m + steps)[:-1] - OPEN - steps[1:]
        h = m
        h[1:] = np.maximum(h[1:], f)
        j = int(np.argmax(h))
        if h[j] > best[0]:
            best = (int(h[j]), i, j)
    return best


def extended(query: str, target: str, start: int, zdrop: int = 100) -> tuple[int, int, int]:
    """Extension of a seed of score ``start`` to the right: best score, and the characters of target and query taken."""
    q, t = codes(query), codes(target)
    low = -(10**9)
    n = len(q) + 1
    steps = np.arange(n) * EXTEND
    h = start - OPEN - steps
    h[0] = start
    h = np.where(h > 0, h, low)
    e = np.full(n, low)
    best = (start, 0, 0)
    for i, c in enumerate(t, 1):
        e = np.maximum(e, h - OPEN) - EXTEND
        m = np.full(n, low)
        m[1:] = np.where(h[:-1] > 0, h[:-1] + np.where(q == c, MATCH, -MISMATCH), low)
        m = np.maximum(m, e)
        f = np.maximum.accumulate(m + steps)[:-1] - OPEN - steps[1:]
        h = m
        h[1:] = np.maximum(h[1:], f)
        h = np.where(h > 0, h, low)
        j = int(np.argmax(h))
        if h[j] > best[0]:
            best = (int(h[j]), i, j)
        elif h[j] < 0 or best[0] - h[j] > zdrop:
            break
    return best


def extended_many(q: np.ndarray, q0: np.ndarray, nq: np.ndarray, t: np.ndarray, t0: np.ndarray, nt: np.ndarray, start: np.ndarray, step: int = 1, zdrop: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``extended`` of many seeds: each takes up to ``nq`` codes of ``q`` from ``q0`` on and ``nt`` of ``t`` from ``t0`` on, in direction ``step``.

    Seeds of like scores go together, row by row, over the columns that can be
    above 0 so far; those that are done leave. Results are in the seeds' order.
    """
    best, taken_t, taken_q = start.astype(np.int64), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    order = np.argsort(start, kind="stable")
    for at in range(0, len(order), TOGETHER):
        _extended_block(order[at : at + TOGETHER], best, taken_t, taken_q, q, q0, nq, t, t0, nt, start, step, zdrop)
    return best, taken_t, taken_q


def _extended_block(a, best, taken_t, taken_q, q, q0, nq, t, t0, nt, start, step, zdrop) -> None:
    low = np.int32(-(10**9))
    a = a[nt[a] > 0]
    if not len(a):
        return
    top = int(start[a].max())
    # at row i, a gap to column j > i leaves less than start + i - OPEN - (j - i)
    width = lambda i, a: min(int(nq[a].max()), max(i, top + 2 * i - OPEN)) + 1
    taken = lambda a, n: q[np.clip(q0[a][:, None] + step * np.arange(n), 0, len(q) - 1)]
    n = width(0, a)
    columns = np.arange(n, dtype=np.int32)
    h = start[a].astype(np.int32)[:, None] - np.int32(OPEN) - columns * np.int32(EXTEND)
    h[:, 0] = start[a]
    h = np.where((h > 0) & (columns <= nq[a][:, None]), h, low)
    e, text = np.full(h.shape, low, np.int32), taken(a, 32)
    i = 0
    while len(a):
        i += 1
        n = width(i, a)
        if n > h.shape[1]:
            more = np.full((len(a), n - h.shape[1]), low, np.int32)
            h, e = np.hstack([h, more]), np.hstack([e, more])
        n = h.shape[1]
        if n - 1 > text.shape[1]:
            text = taken(a, 2 * n)
        steps = np.arange(n, dtype=np.int32) * np.int32(EXTEND)
        e = np.maximum(e, h - np.int32(OPEN)) - np.int32(EXTEND)
        m = e.copy()
        same = text[:, : n - 1] == t[t0[a] + step * (i - 1)][:, None]
        m[:, 1:] = np.maximum(m[:, 1:], np.where(h[:, :-1] > 0, h[:, :-1] + np.where(same, np.int32(MATCH), np.int32(-MISMATCH)), low))
        f = np.maximum.accumulate(m + steps, 1)[:, :-1] - np.int32(OPEN) - steps[1:]
        h = m
        h[:, 1:] = np.maximum(h[:, 1:], f)
        h = np.where((h > 0) & (np.arange(n) <= nq[a][:, None]), h, low)
        j = h.argmax(1)
        score = h[np.arange(len(a)), j]
        up = score > best[a]
        best[a[up]], taken_t[a[up]], taken_q[a[up]] = score[up], i, j[up]
        on = (up | (score >= 0) & (best[a] - score <= zdrop)) & (nt[a] > i)
        if not on.all():
            a, h, e, text = a[on], h[on], e[on], text[on]


def reach(length: int, start: int) -> int:
    """Most characters that an extension from score ``start`` takes of one text, if the other has ``length``: beyond them no score is above 0."""
    return 2 * MATCH * length + start


def extended_both(query: str, target: str, qbeg: int, rbeg: int, size: int) -> tuple[int, int, int, int, int]:
    """A seed extended to the left, then from that score to the right: score, and begins and ends in query and target."""
    score, dt, dq = extended(query[max(0, qbeg - reach(rbeg, size)) : qbeg][::-1], target[max(0, rbeg - reach(qbeg, size)) : rbeg][::-1], size)
    qend, rend = qbeg + size, rbeg + size
    right_q, right_t = len(query) - qend, len(target) - rend
    score, et, eq = extended(query[qend : qend + reach(right_t, score)], target[rend : rend + reach(right_q, score)], score)
    return score, qbeg - dq, qend + eq, rbeg - dt, rend + et


def global_cigar(query: str, target: str) -> tuple[str, int, int]:
    """(CIGAR of M, I and D, edit distance, score) of a global alignment; gaps as far left as can be."""
    q, t = codes(query), codes(target)
    n, m, low = len(q), len(t), -(10**9)
    h = np.full((m + 1, n + 1), low, np.int32)
    e, f = h.copy(), h.copy()  # e: gap in the query (D), f: gap in the target (I)
    steps = np.arange(n + 1, dtype=np.int32) * EXTEND
    h[0] = -OPEN - steps
    h[0, 0] = 0
    f[0, 1:] = h[0, 1:]
    for i in range(1, m + 1):
        e[i] = np.maximum(e[i - 1], h[i - 1] - OPEN) - EXTEND
        h[i] = e[i]
        h[i, 1:] = np.maximum(h[i - 1, :-1] + np.where(q == t[i - 1], MATCH, -MISMATCH), e[i, 1:])
        f[i, 1:] = np.maximum.accumulate(h[i] + steps)[:-1] - OPEN - steps[1:]
        h[i, 1:] = np.maximum(h[i, 1:], f[i, 1:])
    ops, i, j, state, edits = [], m, n, "M", 0
    while i or j:
        if state == "M":
            if i and j and h[i, j] == h[i - 1, j - 1] + (MATCH if q[j - 1] == t[i - 1] else -MISMATCH):
                edits += int(q[j - 1] != t[i - 1])
                ops.append("M")
                i, j = i - 1, j - 1
                continue
            state = "D" if i and h[i, j] == e[i, j] else "I"
        grid, di, dj = (e, 1, 0) if state == "D" else (f, 0, 1)
        ops.append(state)
        edits += 1
        opened = grid[i, j] == h[i - di, j - dj] - OPEN - EXTEND
        i, j = i - di, j - dj
        if opened:
            state = "M"
    out, last = "", ""
    count = 0
    for op in [*reversed(ops), ""]:
        if op != last and count:
            out, count = out + f"{count}{last}", 0
        last, count = op, count + 1
    return out, edits, int(h[m, n])
