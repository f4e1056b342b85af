"""TIFF as a media column: reads every page of a file, and writes bytes as a gray image.

The reader walks the chain of image directories in either byte order, decodes
strips and tiles that are stored plain, by PackBits, LZW or deflate, and undoes
the horizontal predictor. Samples have 8 or 16 bits, chunky or planar.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: tags, type sizes, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 317, 322, 323, 324, 325
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i"}
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946

#: Image width, rows of a strip and rows of a page that the writer makes.
LINE, STRIP, PAGE = 64, 1024, 16384


class BadTiff(ValueError):
    """The bytes are no TIFF that the reader knows."""


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        same = i + 1
        while same < len(data) and same - i < 128 and data[same] == data[i]:
            same += 1
        if same - i > 1:
            out += bytes((257 - (same - i), data[i]))
            i = same
            continue
        end = i + 1
        while end < len(data) and end - i < 128 and not (end + 1 < len(data) and data[end] == data[end + 1]):
            end += 1
        out += bytes((end - i - 1,)) + data[i:end]
        i = end
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out[:size])


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears, 257 ends; codes widen one early."""
    out = bytearray()
    table: list[bytes] = []
    bits = have = pos = 0
    width, last = 9, b""
    while len(out) < size:
        while have < width:
            if pos >= len(data):
                return bytes(out)
            bits = (bits << 8 | data[pos]) & 0xFFFFFF
            pos += 1
            have += 8
        have -= width
        code = bits >> have & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table = [bytes((i,)) for i in range(256)] + [b"", b""]
            width, last = 9, b""
            continue
        if not table:
            raise BadTiff("LZW data doesn't begin with a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise BadTiff("LZW code out of range")
        out += entry
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        size_now = len(table) + 1
        width = 12 if size_now >= 2048 else 11 if size_now >= 1024 else 10 if size_now >= 512 else 9
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    out, bits, have = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width = 9

    def put(code: int) -> None:
        nonlocal bits, have
        bits = bits << width | code
        have += width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
        bits &= (1 << have) - 1

    put(256)
    table, word = {bytes((i,)): i for i in range(256)}, b""
    nxt = 258
    for b in data:
        more = word + bytes((b,))
        if more in table:
            word = more
            continue
        put(table[word])
        table[more] = nxt
        nxt += 1
        if nxt >= 4094:
            put(256)
            table, nxt, width = {bytes((i,)): i for i in range(256)}, 258, 9
        else:
            width = 12 if nxt >= 2048 else 11 if nxt >= 1024 else 10 if nxt >= 512 else 9
        word = bytes((b,))
    if word:
        put(table[word])
        nxt += 1
        width = 12 if nxt >= 2048 else 11 if nxt >= 1024 else 10 if nxt >= 512 else 9
    put(257)
    if have:
        out.append(bits << 8 - have & 255)
    return bytes(out)


def _packed(raw: bytes, compression: int) -> bytes:
    if compression == DEFLATE:
        return zlib.compress(raw, 1)
    return {PLAIN: bytes, PACKBITS: pack_bits, LZW: lzw_encode}[compression](raw)


#: Bytes that one stored byte stands for at most; it bounds what a damaged size may ask for.
MOST = {PLAIN: 1, PACKBITS: 128, LZW: 4096, DEFLATE: 1100, OLD_DEFLATE: 1100}


def _unpacked(data: bytes, compression: int, size: int) -> bytes:
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if compression == PACKBITS:
        return unpack_bits(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression == PLAIN:
        return data[:size]
    raise BadTiff(f"compression {compression} isn't known")


def write(payload: bytes, compression: int = DEFLATE, predictor: int = 2, line: int = LINE, strip: int = STRIP, page: int = PAGE, order: str = "<", tile: int = 0) -> bytes:
    """``payload`` (a positive multiple of ``line`` bytes) as gray pages of up to ``page`` rows, in strips or square tiles."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for at in range(0, len(payload), line * page):
        part = np.frombuffer(payload, np.uint8)[at : at + line * page].reshape(-1, line)
        if tile:
            high, wide = -(-len(part) // tile), -(-line // tile)
            full = np.zeros((high * tile, wide * tile), np.uint8)
            full[: len(part), :line] = part
            blocks = [full[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile] for y in range(high) for x in range(wide)]
        else:
            blocks = [part[y : y + strip] for y in range(0, len(part), strip)]
        offsets, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.uint8(0))
            data = _packed(block.tobytes(), compression)
            offsets.append(len(out))
            sizes.append(len(data))
            out += data
        shape = [(TILE_WIDTH, [tile]), (TILE_HEIGHT, [tile]), (TILES, offsets), (TILE_BYTES, sizes)] if tile else [(STRIPS, offsets), (ROWS, [strip]), (STRIP_BYTES, sizes)]
        tags = sorted([(WIDTH, [line]), (HEIGHT, [len(part)]), (BITS, [8]), (COMPRESSION, [compression]), (PHOTOMETRIC, [1]), (SAMPLES, [1]), (PREDICTOR, [predictor]), *shape])
        entries = b""
        for tag, values in tags:
            data = struct.pack(f"{order}{len(values)}I", *values)
            if len(data) > 4:
                where = len(out)
                out += data
                data = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, 4, len(values)) + data
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0"
    return bytes(out)


def pages(data: bytes) -> Iterator[np.ndarray]:
    """The pages in order, as arrays (rows, columns, samples)."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise BadTiff("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise BadTiff("the directories don't end")
        seen.add(at)
        count = struct.unpack_from(order + "H", data, at)[0]
        tags: dict[int, tuple[int, ...]] = {}
        for i in range(count):
            entry = at + 2 + 12 * i
            tag, kind, n = struct.unpack_from(order + "HHI", data, entry)
            if kind in TYPES:
                size = struct.calcsize(TYPES[kind]) * n
                where = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
                tags[tag] = struct.unpack_from(f"{order}{n}{TYPES[kind]}", data, where)
        yield _page(data, order, tags)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def _page(data: bytes, order: str, tags: dict[int, tuple[int, ...]]) -> np.ndarray:
    first = lambda tag, other: tags.get(tag, (other,))[0]
    width, height, samples = first(WIDTH, 0), first(HEIGHT, 0), first(SAMPLES, 1)
    bits = first(BITS, 1)
    if bits not in (8, 16):
        raise BadTiff(f"samples of {bits} bits")
    kind = np.dtype(np.uint8 if bits == 8 else order + "u2")
    planar = first(PLANAR, 1) == 2
    tiled = TILES in tags
    high, wide = (first(TILE_HEIGHT, 0), first(TILE_WIDTH, 0)) if tiled else (min(first(ROWS, height), height), width)
    offsets, sizes = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[STRIPS], tags[STRIP_BYTES])
    across, down, deep = -(-width // wide), -(-height // high), 1 if planar else samples
    here = sum(max(0, min(size, len(data) - offset)) for offset, size in zip(offsets, sizes, strict=True))
    if len(offsets) != across * down * (samples if planar else 1) or height * width * samples * kind.itemsize > MOST.get(first(COMPRESSION, 1), 1) * here:
        raise BadTiff("the file is too short for its size")
    image = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, rest = divmod(k, across * down)
        y, x = high * (rest // across), wide * (rest % across)
        rows = high if tiled else min(high, height - y)
        raw = _unpacked(data[offset : offset + size], first(COMPRESSION, 1), rows * wide * deep * kind.itemsize)
        block = np.frombuffer(raw, kind).reshape(rows, wide, deep).astype(kind.newbyteorder("="))
        if first(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        into = image[y : y + rows, x : x + wide, plane : plane + 1] if planar else image[y : y + rows, x : x + wide]
        into[...] = block[: into.shape[0], : into.shape[1]]
    return image


def features(image_pages: list[np.ndarray]) -> str:
    """pages, rows, mean and deviation of the samples, and the share of each eighth of the sample range in ten-thousandths."""
    hist = sum((np.bincount(p.reshape(-1), minlength=256) for p in image_pages), np.zeros(256, np.int64))
    n = int(hist.sum())
    mean = int((hist * np.arange(256)).sum()) / n
    var = max(0.0, int((hist * np.arange(256) ** 2).sum()) / n - mean * mean)
    eighths = ",".join(str(int(x) * 10000 // n) for x in hist.reshape(8, 32).sum(axis=1))
    return f"pages={len(image_pages)};rows={sum(len(p) for p in image_pages)};mean={mean:.3f};std={var**0.5:.3f};hist={eighths}"


def page_rows(files: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """(id, page, width, height, samples, bits, pixels, error) per page of the TIFF bytes in ``data_col``.

    Bytes that can't be read, and null, give one row with page null and the
    reason; pages before the damage are kept.
    """
    schema = f"`{id_col}` long, page int, width int, height int, samples int, bits int, pixels binary, error string"

    def rows(data: bytes | None) -> Iterator[tuple]:
        try:
            if data is None:
                raise BadTiff("null")
            for k, p in enumerate(pages(data)):
                yield k, p.shape[1], p.shape[0], p.shape[2], 8 * p.dtype.itemsize, p.tobytes(), None
        except (BadTiff, struct.error, zlib.error, ValueError, LookupError, ZeroDivisionError, OverflowError, MemoryError) as e:
            yield None, None, None, None, None, None, str(e)[:200]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.string()]
        names = [id_col, "page", "width", "height", "samples", "bits", "pixels", "error"]
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                for row in rows(data.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((key.as_py(), *row), kinds, strict=True)], names)

    return files.select(F.col(id_col).cast("long").alias(id_col), F.col(data_col).cast("binary").alias("__data")).mapInArrow(run, schema)


def padded(text: bytes) -> bytes:
    """``text`` and zeros up to a positive multiple of 64 bytes."""
    return text + b"\0" * (-len(text) % 64 or 64 * (not text))


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text, padded, as a TIFF. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([write(padded(x.as_py() or b"")) for x in part.column(1)], pa.binary())], [id_col, "media"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("binary").alias("__text")).mapInArrow(run, f"`{id_col}` long, media binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: sizes and digests of its payload as read back from the TIFF, and features of the pages.

    A null text is empty and has one line of zeros. Rows are independent, equal
    texts give equal values; null ids and repeated rows stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for value in batch.column(1):
                text = value.as_py() or b""
                media = write(padded(text))
                read = list(pages(media))
                payload = b"".join([p.tobytes() for p in read])
                row = len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(read)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]], [id_col, *NAMES])

    schema = f"`{id_col}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("binary").alias("__text")).mapInArrow(run, schema)


NAMES = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
