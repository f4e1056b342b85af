"""SimHash near-duplicate groups by pigeonhole blocks.

Two fingerprints that differ in at most ``distance`` of 64 bits, cut into
``blocks`` blocks, agree on at least ``blocks - distance`` whole blocks. Each
fingerprint is filed under every choice of that many blocks; only fingerprints
with a common key are compared, and the Hamming distance is then verified.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import bitmap, components, in_bitmap, spread_join, stored, text_id

SEED = 42
#: Shingles hashed at a time, so that memory doesn't follow the text.
STEP = 1 << 16


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """The 64-bit hashes of a text's word shingles, or of all its words if they are fewer; nothing for a text without words."""
    words = text.lower().split()  # ASCII white space and letters only, as bytes have no other
    count = max(1, len(words) - width + 1) if words else 0
    for at in range(0, count, STEP):
        part = words[at : min(at + STEP, count) + width - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = max(1, len(part) - width + 1)
        digest = xxhash.xxh64_intdigest
        yield np.array([digest(line[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)], "<u8")


def fingerprint(text: bytes, width: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 for a text without words."""
    ones, count = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width):
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
        count += len(hashes)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, tid, fp): fp is the fingerprint as a signed long, tid names the text. A null text has no words."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_id(F.col(text_col)).alias("tid"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py() or b"", width) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["id", "tid", "fp"])

    return slim.mapInArrow(run, "id long, tid long, fp long")


def _stars(x: np.ndarray, distance: int) -> list[tuple[np.uint64, np.ndarray]]:
    """The components of the fingerprints within ``distance``: (smallest, others) of each that has others."""
    out, left = [], np.arange(len(x))
    while left.size:
        front, left = [int(left[0])], left[1:]
        found = [np.array(front)]
        while front and left.size:
            near = np.bitwise_count(x[left] ^ x[front.pop()]) <= distance
            if near.any():
                found.append(left[near])
                front.extend(found[-1].tolist())
                left = left[~near]
        if len(found) > 1:
            members = np.sort(x[np.concatenate(found)].view(np.int64)).view(np.uint64)
            out.append((members[0], members[1:]))
    return out


def _links(distance: int):
    """For rows sorted by unit: edges that connect what is connected within each unit, fewer than its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            unit, x = rows[:3], rows[3].view(np.uint64)
            cuts = np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(axis=0)) + 1
            u, v = [], []
            sizes = np.diff(np.concatenate(([0], cuts, [len(x)])))
            starts = np.concatenate(([0], cuts))
            two = starts[sizes == 2]  # most units: one comparison for all of them
            near = two[np.bitwise_count(x[two] ^ x[two + 1]) <= distance]
            u.append(x[near])
            v.append(x[near + 1])
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                for smallest, others in _stars(x[s : s + n], distance):
                    u.append(np.full(len(others), smallest, np.uint64))
                    v.append(others)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u).view(np.int64)), pa.array(np.concatenate(v).view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            held.append(rows)
            change = np.flatnonzero((rows[:3] != rows[:3, -1:]).any(axis=0))
            if change.size or len(held) > 1 and (held[-2][:3, -1] != rows[:3, -1]).any():
                cut = change[-1] + 1 if change.size else 0
                done = np.concatenate([*held[:-1], rows[:, :cut]], axis=1)
                held = [rows[:, cut:]]
                yield from edges(done)
        if held:
            yield from edges(np.concatenate(held, axis=1))

    return run


def _keys(fp: Column, blocks: int, distance: int) -> Column:
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    cut = lambda i: F.shiftrightunsigned(fp, bounds[i]).bitwiseAND(F.lit((1 << (bounds[i + 1] - bounds[i])) - 1))
    out = []
    for choice in combinations(range(blocks), blocks - distance):
        key = F.lit(len(out)).cast("long")
        for i in choice:
            key = F.shiftleft(key, bounds[i + 1] - bounds[i]).bitwiseOR(cut(i))
        out.append(key)
    return F.array(*out)


def blocks_for(count: int, distance: int = 4) -> int:
    """The fewest blocks whose keys spread ``count`` fingerprints to about one a bucket.

    More blocks share more bits per key, but file each fingerprint under more
    keys: with 4 bits, 6 blocks have 15 keys of about 21 bits, 7 blocks 35 of
    27, 8 blocks 70 of 32.
    """
    blocks = distance + 2
    while blocks < 2 * distance and (blocks - distance) * 64 / blocks < math.log2(max(count, 1)):
        blocks += 1
    return blocks


def near_links(fps: DataFrame, distance: int = 4, blocks: int | None = None, tile: int = 1024) -> DataFrame:
    """Edges (u, v) that connect all distinct values of ``fps(fp)`` linked through distances up to ``distance``.

    No link between components is lost, and a bucket never emits its pairs: a
    unit of at most about two tiles yields a star on the smallest of each of its
    components, so that paths are short from the outset. A bucket of more
    than ``tile`` fingerprints is cut into tiles, and every pair of tiles is a
    unit of its own, so no task gathers a large bucket. Blocks grow with the
    number of different fingerprints, so buckets stay small.
    """
    distinct = fps.select("fp").distinct()
    if blocks is None:
        distinct = stored(distinct, "simhash-distinct")
        blocks = blocks_for(distinct.count(), distance)
    filed = distinct.select("fp", F.explode(_keys(F.col("fp"), blocks, distance)).alias("key"))
    full = filed.groupBy("key").count().where("count > 1").select(F.col("key").alias("k"), F.ceil(F.col("count") / tile).alias("tiles"))
    dealt = filed.join(full, F.col("key") == F.col("k")).select("fp", "key", "tiles", F.pmod(F.xxhash64("fp"), F.col("tiles")).alias("t"))
    units = dealt.select("fp", "key", "tiles", "t", F.explode(F.expr("sequence(0L, tiles - 1)")).alias("o")).where("tiles = 1 or t <> o")
    units = units.select("key", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), "fp")
    return units.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(_links(distance), "u long, v long").distinct()


def groups_of(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows(id, fp, ...)`` with root, which names the row's group, and component_id, its smallest id.

    ``links(u, v)`` connect values of fp. Values and groups that many rows have
    are counted before any join, and their rows aren't gathered anywhere.
    """
    firsts = stored(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "groups-first")
    linked = components(links)
    rooted = firsts.join(linked, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("k"), "n", "first", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "groups-rooted")
    lows = rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r")
    facts = stored(rooted.join(lows, F.col("root") == F.col("r")).select("k", "n", "root", "component_id"), "groups-facts")
    return spread_join(rows, facts, "fp").drop("k", "n")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """(id, tid, fp, root, component_id) of every row of ``docs``; see ``near_duplicates``."""
    fps = stored(fingerprints(docs, id_col, text_col, width), "simhash")
    return groups_of(fps, near_links(fps, distance, blocks))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (hex) and component_id, the smallest id of its group.

    Words are ASCII-lower-cased and cut at ASCII white space. Null and empty
    texts have fingerprint 0 and are linked like any other. Repeated rows stay
    repeated; a null id is never the smallest unless the group has no other
    (then component_id is null). Extra columns are ignored.
    """
    group = near_groups(docs, id_col, text_col, width, distance, blocks)
    return group.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: Callable[..., DataFrame] = near_groups) -> DataFrame:
    """The rows of ``docs`` but one document per near-duplicate group of ``groups``, that of the smallest id.

    A row is named by its id and its text: rows of one id with texts of
    different groups all stay, and of rows that repeat both, one stays. A null
    id is chosen only where the group has no other. Columns are those of
    ``docs``. What is shuffled is names, and texts only where the names of the
    rows to go are too many to broadcast.
    """
    named = stored(groups(docs, id_col, text_col).select("id", "tid", "root"), "keep-named")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "tid")
    chosen = named.groupBy("root").agg(F.min(order).alias("c"), F.count("*").alias("n")).select(F.col("root").alias("k"), "n", "c")
    marked = spread_join(named, stored(chosen.where("n > 1"), "keep-chosen"), "root")
    same = F.col("id").eqNullSafe(F.col("c.id")) & (F.col("tid") == F.col("c.tid"))
    marks = marked.groupBy(F.col("id").alias("__i"), F.col("tid").alias("__t")).agg(F.max(same).alias("__stays"), F.count("*").alias("__times"))
    marks = stored(marks.where("not __stays or __times > 1"), "keep-marks")
    named = docs.withColumn("__d", docs[id_col].cast("long")).withColumn("__x", text_id(docs[text_col])).withColumn("__b", bitmap(marks.select(F.xxhash64("__i", "__t").alias("h"))))
    may = in_bitmap(F.col("__b"), F.xxhash64("__d", "__x"))
    met = named.where(may).drop("__b").join(marks, F.col("__d").eqNullSafe(F.col("__i")) & (F.col("__x") == F.col("__t")), "left")
    met = stored(met.where("__stays is null or __stays"), "keep-met")
    again = met.where("__stays").dropDuplicates(["__d", "__x"])
    return named.where(~may).select(docs.columns).unionByName(met.where("__stays is null").select(docs.columns)).unionByName(again.select(docs.columns))
