"""Near-duplicate groups by the Jaccard similarity of word shingles: SimHash blocks, Hamming distance, then exact verification.

A text is the set of its shingles of five words; its fingerprint is the SimHash
of the set, in as many bits as its blocks take. Fingerprints that agree on a
whole block and differ in at most ``APART`` of the first 64 * ``WORDS`` bits are
candidates, and only ever compared by their whole shingle sets. Sets of
similarity 0.8 or more differ in up to 0.162 of the bits (by their angle, 0.152,
where they aren't small), but in 3/16 if they are 4 shingles of 5: blocks are so
many that such a pair misses all of them with probability ``LOST``, and it is
farther apart than ``APART`` with 1.1e-5. Any other misses 58 blocks of 8 bits
with less than 1e-7 and is too far apart with as much. A fingerprint of 64 bits
with a distance of 4, as in ``simhash``, would find 3 per cent of such pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import bitmap, components, in_bitmap, stored, text_id
from strandline.llm.simhash import groups_of, shingle_hashes

#: Words of a shingle, and the least similarity of near copies.
WIDTH, LEAST = 5, 0.8
#: Share of bits that differ between similar sets at the worst, and the chance that they share no block.
DIFFER, LOST = 3 / 16, 5e-6
#: Words of the fingerprint that are compared, and the most of their bits in which candidates differ.
WORDS, APART = 3, 60
#: Odd factors: shingle hashes times a factor, mixed, are new hashes, one for each word of the fingerprint.
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, 1 << 9, np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles whose bits are added in one byte, and fingerprints that meet a unit at a time.
STEP, ROWS = 255, 64
#: Most fingerprints of a tile of a block's bucket on average.
BUCKET = 4096
#: Most texts, and most shingles, of a tile on average.
TILE, WEIGHT = 512, 1 << 19


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; of all its words if they are fewer; none without words."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width)]))


def blocks_for(count: int) -> tuple[int, int]:
    """(bits of a block, number of blocks) for ``count`` texts: buckets hold up to 4096 random fingerprints."""
    bits = max(8, count.bit_length() - 12)
    return bits, math.ceil(math.log(LOST) / math.log1p(-((1 - DIFFER) ** bits)))


def fingerprint_bits(x: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of a shingle set: a bit is 1 if it is set in over half of the shingles' hashes."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(x), STEP):
        y = x[at : at + STEP, None] * FACTORS[:words]
        y ^= y >> np.uint64(32)
        y *= FACTORS[-1]
        y ^= y >> np.uint64(29)
        ones += np.unpackbits(y.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return 2 * ones > len(x)


def block_keys(bits: np.ndarray, size: int, blocks: int) -> np.ndarray:
    """The number of each block of ``size`` bits, told from those of the other blocks."""
    values = bits[: size * blocks].reshape(blocks, size) @ (1 << np.arange(size))
    return values + (np.arange(blocks) << size)


def _name(x: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(x.tobytes())).view(np.int64))


def signatures(docs: DataFrame, width: int = WIDTH, cut: tuple[int, int] | None = None) -> DataFrame:
    """(id, tid, fp, n, words, keys) of ``docs(id, tid, text)``: fp names the shingle set, n is its size, keys are those of ``cut`` blocks."""
    size, blocks = cut or blocks_for(docs.count())
    length = max(WORDS, -(-size * blocks // 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(2):
                x = shingle_set(t.as_py() or b"", width)
                bits = fingerprint_bits(x, length)
                words = np.packbits(bits[: 64 * WORDS], bitorder="little").view("<i8")
                rows.append((_name(x), len(x), words, block_keys(bits, size, blocks)))
            fp, n, words, keys = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["id", "tid", "fp", "n", "words", "keys"])

    return docs.mapInArrow(run, "id long, tid long, fp long, n long, words array<long>, keys array<long>")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The rows of each unit, which the first three columns name, of rows sorted by unit."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        parts = np.split(rows, np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1, axis=1)
        if held and (held[-1][:3, -1] != rows[:3, 0]).any():
            yield np.concatenate(held, axis=1)
            held = []
        for part in parts[:-1]:
            yield np.concatenate([*held, part], axis=1)
            held = []
        held.append(parts[-1])
    if held:
        yield np.concatenate(held, axis=1)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of all pairs of the columns of ``x`` and ``y``; fewer than 256."""
    out = np.bitwise_count(x[0][:, None] ^ y[0])
    for a, b in zip(x[1:], y[1:], strict=True):
        out += np.bitwise_count(a[:, None] ^ b)
    return out


def _close(apart: int):
    """For rows (key, a, b, fp, words) sorted by unit: edges that connect the fingerprints of each unit within ``apart``, fewer than its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            names, words = unit[3], unit[4:].view(np.uint64)
            met = np.zeros(len(names), bool)  # most have no other near them
            for at in range(0, len(names), ROWS):
                near = _distance(words[:, at : at + ROWS], words[:, at:]) <= apart
                np.fill_diagonal(near, False)
                met[at : at + ROWS] |= near.any(axis=1)
                met[at:] |= near.any(axis=0)
            left = np.flatnonzero(met)
            while left.size:
                front, left = [int(left[0])], left[1:]
                group = [names[front]]
                while front and left.size:
                    near = _distance(words[:, [front.pop()]], words[:, left])[0] <= apart
                    group.append(names[left[near]])
                    front.extend(left[near].tolist())
                    left = left[~near]
                members = np.sort(np.concatenate(group))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(members) - 1, members[0])), pa.array(members[1:])], ["u", "v"])

    return run


def _stars_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest, other) for each node but the smallest of each component of the edges."""
    names, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    root = np.arange(len(names))
    a, b = np.split(ends, 2)
    while (apart := a != b).any():
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
    other = root != np.arange(len(names))
    return names[root[other]], names[other]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) that connect what all edges of the task connect, fewer than their nodes."""
    held = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches if b.num_rows]
    if held:
        u, v = _stars_of(*np.concatenate(held, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def near_links(signed: DataFrame, apart: int = APART, tile: int = BUCKET) -> DataFrame:
    """Edges (u, v) that connect all values of ``signed(fp, words, keys)`` linked by a common block and a distance up to ``apart``.

    A bucket of more than ``tile`` fingerprints is cut into tiles, every pair of
    which is a unit of its own, and a unit yields stars and never its pairs.
    A fingerprint of a large group is in stars of many blocks, on as many others;
    where its edges meet, one for each fingerprint there is left.
    """
    distinct = stored(signed.select("fp", "words", "keys").dropDuplicates(["fp"]), "shingle-distinct")
    filed = distinct.select("fp", *[F.col("words")[i].alias(f"w{i}") for i in range(WORDS)], F.explode("keys").alias("key"))
    full = stored(filed.groupBy("key").count().where("count > 1").select(F.col("key").alias("k"), F.ceil(F.col("count") / tile).alias("tiles")), "shingle-full")
    dealt = filed.join(full, F.col("key") == F.col("k")).withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")))
    units = dealt.select("*", F.explode(F.expr("sequence(0L, tiles - 1)")).alias("o")).where("tiles = 1 or t <> o")
    units = units.select("key", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), "fp", *[f"w{i}" for i in range(WORDS)])
    return units.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(_close(apart), "u long, v long").repartition("v").mapInArrow(_joined, "u long, v long")


def _stars(names: np.ndarray, sets: list[np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(smallest, others) of each component of the sets that are at least so similar."""
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mask, left = np.zeros(len(values), bool), np.ones(len(sets), bool)
    while left.any():
        group = [int(np.argmax(left))]
        left[group[0]] = False
        for i in group:  # grows as it is gone through
            if not left.any():
                break
            mask[flat[starts[i] : ends[i]]] = True
            sums = np.concatenate(([0], np.cumsum(mask[flat])))
            mask[flat[starts[i] : ends[i]]] = False
            both = sums[ends] - sums[starts]
            near = np.flatnonzero(left & (both >= least * (sizes[i] + sizes - both) - 1e-9))
            left[near] = False
            group.extend(near.tolist())
        if len(group) > 1:
            members = np.sort(names[group])
            yield np.full(len(group) - 1, members[0]), members[1:]


def _verified(least: float):
    """For rows (root, a, b, fp, set) sorted by unit: edges that connect the similar sets of each unit, fewer than its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, names, sets = None, [], []

        def edges() -> Iterator[pa.RecordBatch]:
            for u, v in _stars(np.array(names), sets, least):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            for root, a, b, fp, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if unit != (root, a, b):
                    if len(names) > 1:
                        yield from edges()
                    unit, names, sets = (root, a, b), [], []
                names.append(fp)
                sets.append(np.frombuffer(packed, np.uint64))
        if len(names) > 1:
            yield from edges()

    return run


def similar_links(texts: DataFrame, signed: DataFrame, width: int = WIDTH, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that connect the shingle sets linked through similarities of at least ``least``.

    SimHash blocks and distances connect candidates to rough groups. Each set of a rough group is
    compared with all others of it that may still be linked; a group of more
    than ``tile`` sets is cut into tiles, and every pair of tiles is a unit of
    its own, which yields stars and never its pairs.
    """
    rough = stored(components(near_links(signed)), "shingle-rough")
    named = signed.groupBy("fp").agg(F.min(F.struct("id", "tid")).alias("d"), F.max("n").alias("n"))
    named = stored(named.join(rough, F.col("fp") == F.col("node")).select("root", "d.id", "d.tid", "fp", "n"), "shingle-wanted")
    tiles = named.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n") / WEIGHT), F.lit(1)).alias("tiles")).withColumnRenamed("root", "r")
    dealt = named.join(tiles, F.col("root") == F.col("r")).select(F.col("id").alias("i"), F.col("tid").alias("h"), "root", "tiles", F.pmod(F.xxhash64("fp"), F.col("tiles")).alias("t"), "fp")
    dealt = stored(dealt, "shingle-dealt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set(t.as_py() or b"", width).tobytes() for t in batch.column(4)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], sets], ["root", "tiles", "t", "fp", "set"])

    # the texts that aren't wanted stay where they are
    asked = texts.withColumn("b", bitmap(dealt.select(F.xxhash64("i", "h").alias("h"))))
    asked = asked.where(in_bitmap(F.col("b"), F.xxhash64("id", "tid"))).drop("b")
    held = asked.join(dealt, F.col("id").eqNullSafe(F.col("i")) & (F.col("tid") == F.col("h"))).select("root", "tiles", "t", "fp", "text")
    sets = held.mapInArrow(run, "root long, tiles long, t long, fp long, set binary")
    units = sets.select("*", F.explode(F.expr("sequence(0L, tiles - 1)")).alias("o")).where("tiles = 1 or t <> o")
    units = units.select("root", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), "fp", "set")
    return units.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b").mapInArrow(_verified(least), "u long, v long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """(id, tid, fp, root, component_id) of every row of ``docs``; see ``similar``."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_id(F.col(text_col)).alias("tid"), text.alias("text"))
    signed = stored(signatures(texts, width), "shingle-signatures")
    return groups_of(signed.select("id", "tid", "fp"), similar_links(texts, signed, width, least, tile))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """(id, component_id) of every row of ``docs``: component_id is the smallest id of its group.

    Words are ASCII-lower-cased and cut at ASCII white space. Texts without
    words are one group. A null id is never the smallest unless the group has
    no other (then component_id is null).
    """
    return similar_groups(docs, id_col, text_col, width, least, tile).select(F.col("id").alias(id_col), "component_id")
