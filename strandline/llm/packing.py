"""Best-fit packing of token sequences by patterns from non-negative least squares.

The lengths of all pieces are counted. On a grid of cells, every pattern of up
to three cells that fills a sequence is a column of a least-squares problem
whose right side is the histogram; its non-negative solution, rounded, says how
often each pattern is used. Patterns are then filled with true lengths, and the
residual goes by best fit, longest first, into the gaps and into new sequences.
All of this works on counts of at most ``capacity`` lengths, never on documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import bpe
from strandline.llm.shared import stored

CAPACITY, CELLS, DEPTH = 2048, 256, 3
#: Weight in the fit of cells below an eighth of a sequence: what is left of them fills gaps.
SHORT = 0.1


def patterns(cells: int, depth: int = DEPTH) -> np.ndarray:
    """All non-increasing choices of up to ``depth`` cell sizes that add up to ``cells``; 0 pads."""
    out = [(cells, 0, 0)]
    if depth > 1:
        out += [(a, cells - a, 0) for a in range(cells - 1, cells // 2 - (cells % 2 == 0), -1) if a >= cells - a > 0]
    if depth > 2:
        out += [(a, b, cells - a - b) for a in range(1, cells) for b in range(1, a + 1) if 0 < cells - a - b <= b]
    return np.array(out)


def non_negative(columns: np.ndarray, target: np.ndarray, steps: int = 3000) -> np.ndarray:
    """argmin |Ax - b| over x >= 0 by active sets, A given as columns."""
    a = columns.T
    x, active = np.zeros(len(columns)), np.zeros(len(columns), bool)
    for _ in range(steps):
        slope = columns @ (target - a @ x)
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, float(np.abs(target).max())):
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            sub = columns[at]
            z = np.linalg.lstsq(sub @ sub.T + 1e-10 * np.eye(len(at)), sub @ target, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            ratio = (x[at][low] / np.maximum(x[at][low] - z[low], 1e-300)).min()
            x[at] += ratio * (z - x[at])
            gone = at[(x[at] <= 1e-12) & low]
            if not len(gone):
                gone = at[low][:1]
            active[gone] = False
            x[gone] = 0
    return x


def fitted(counts: dict[int, int], capacity: int = CAPACITY, cells: int = CELLS) -> list[tuple[tuple[int, ...], int]]:
    """(cells of a pattern, repeats), most used first, for counts of lengths up to ``capacity``."""
    width = capacity / cells
    target = np.zeros(cells)
    for length, n in counts.items():
        target[int(np.ceil(length / width)) - 1] += n
    if not target.any():
        return []
    shapes = patterns(cells)
    columns = np.zeros((len(shapes), cells + 1))
    for k in range(shapes.shape[1]):
        np.add.at(columns, (np.arange(len(shapes)), shapes[:, k]), 1.0)
    weight = np.where(np.arange(1, cells + 1) * 8 < cells, SHORT, 1.0)
    x = non_negative(columns[:, 1:] * weight, target * weight)
    repeats = np.floor(x + 0.5).astype(int)
    used = sorted(np.flatnonzero(repeats), key=lambda i: (-repeats[i], i))
    return [(tuple(c for c in shapes[i].tolist() if c), int(repeats[i])) for i in used]


def planned(counts: dict[int, int], capacity: int = CAPACITY, cells: int = CELLS) -> list[tuple[list[int], int]]:
    """Groups of sequences alike: (lengths in their order, number of such sequences). Every piece is in exactly one."""
    width = capacity / cells
    left = {n: c for n, c in counts.items() if c > 0}
    there = sorted(left)

    def take(most: int, least: int) -> int:
        """The longest length in (least, most] that is left, or 0."""
        at = bisect_right(there, most) - 1
        while at >= 0 and not left[there[at]]:
            del there[at]
            at -= 1
        return there[at] if at >= 0 and there[at] > least else 0

    groups: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    gaps: list[int] = []

    def put(lengths: list[int], n: int) -> None:
        gap = capacity - sum(lengths)
        if not groups[gap]:
            insort(gaps, gap)
        groups[gap].append((lengths, n))

    for cells_of, repeats in fitted(left, capacity, cells):
        while repeats:
            lengths, gap = [], capacity
            for k, c in enumerate(cells_of):  # the last one is the best fit, in its cell or one that true lengths leave room for
                most = gap if k == len(cells_of) - 1 else int(c * width)
                n = take(min(most, gap), int((c - 1) * width))
                if not n:
                    break
                left[n] -= 1
                lengths.append(n)
                gap -= n
            for n in lengths:
                left[n] += 1
            if len(lengths) < len(cells_of):
                break
            again = min([repeats, *(left[n] // lengths.count(n) for n in lengths)])
            for n in lengths:
                left[n] -= again
            put(lengths, again)
            repeats -= again
    for n in sorted(left, reverse=True):  # the residual, longest first, each into the tightest gap
        while left[n]:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                each = capacity // n
                whole, rest = divmod(left[n], each)
                left[n] = 0
                if whole:
                    put([n] * each, whole)
                if rest:
                    put([n] * rest, 1)
                break
            gap = gaps[at]
            lengths, free = groups[gap].pop()
            if not groups[gap]:
                gaps.pop(at)
            used = min(free, left[n])
            left[n] -= used
            if free > used:
                if not groups[gap]:
                    insort(gaps, gap)
                groups[gap].append((lengths, free - used))
            put([*lengths, n], used)
    return [g for gap in gaps for g in groups[gap]]


def slots(plan: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """Of each run of pieces of one length: length, rank of its first piece, its sequence and place; by length and rank."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, n in plan:
        place = 0
        for length in lengths:
            rows.append((length, used[length], sequence, place))
            used[length] += n
            place += length
        sequence += n
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 4).T)


def placed(pieces: DataFrame, length_col: str, order_cols: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; lengths are 1 to ``capacity``.

    Pieces of one length are ranked: counts by length and salt give each salt
    its first rank, and rows are numbered within length and salt only, so a
    length that a third of all pieces have is spread over many tasks.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # at most ``capacity`` rows
    runs = slots(planned(counts, capacity))
    salts = max(8, sum(counts.values()) // 20_000)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*order_cols), F.lit(salts)))
    number = f"row_number() over (partition by `{length_col}`, __salt order by {', '.join(f'`{c}`' for c in order_cols)}) - 1"
    first = "sum(n) over (partition by l order by s rows between unbounded preceding and current row) - n"
    firsts = salted.groupBy(F.col(length_col).alias("l"), F.col("__salt").alias("s")).agg(F.count("*").alias("n")).select("l", "s", F.expr(first).alias("first"))
    ranked = salted.withColumn("__k", F.expr(number)).join(firsts, (F.col(length_col) == F.col("l")) & (F.col("__salt") == F.col("s"))).withColumn("__rank", F.col("first") + F.col("__k"))
    lengths, starts, sequences, places = runs
    wide = np.int64(1) << np.int64(48)
    keys = lengths * wide + starts
    kept = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (batch.num_columns - 2, batch.num_columns - 1))
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            out = [pa.array(sequences[at] + rank - starts[at]), pa.array(places[at])] if len(keys) else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *out], [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*[F.col(c) for c in kept], F.col(length_col).cast("long").alias("__len"), F.col("__rank").cast("long")).mapInArrow(run, schema)


def pieces_of(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32): token ids and one ``end`` id, cut into pieces of ``capacity``."""
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            at = 0
            for texts in bpe.batches_of(x.as_py() for x in batch.column(1)):
                for ids in enc.encode(texts):
                    key, ids = batch.column(0)[at].as_py(), ids + last
                    at += 1
                    bounds = [*range(0, len(ids), 4 * capacity), len(ids)]
                    for k, (a, b) in enumerate(pairwise(bounds)):
                        for column, x in zip(out, (key, k, a // 4, (b - a) // 4, zlib.crc32(ids[a:b])), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], [id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long")


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Every row of ``docs`` is packed,
    with its id null or repeated too. Extra columns are ignored.
    """
    pieces = stored(pieces_of(docs, path, id_col, text_col, capacity), "packing")
    return placed(pieces, "length", [id_col, "piece", "ids_crc32", "start"], capacity)
