"""Media columns, TIFF: write byte payloads as 8-bit images, walk image directories and emit one row per page.

The reader takes classic TIFF of either byte order with any number of linked image directories, 8-bit
samples, strips or tiles, PackBits, LZW, deflate or no compression, and horizontal predictors. Pages are
decoded inside tasks, one file at a time.
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

from .common import small_batches

# Fixed values of the format: tag numbers, field sizes by type, compression codes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 322, 323, 324, 325
FIELD = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i")}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {"none": NONE, "lzw": LZW, "deflate": DEFLATE, "packbits": PACKBITS}


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while i + run < n and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        k = i + run
        while k < n and k - i < 128 and not (k + 2 < n and data[k] == data[k + 1] == data[k + 2]):
            k += 1
        out += bytes((k - i - 1,)) + data[i:k]
        i = k
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + head + 2]
            i += head + 2
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes from the most significant bit, a clear code first and when the table is full, the end code last."""
    bits, width, acc, out = 0, 9, 0, bytearray()
    known = {bytes((i,)): i for i in range(256)}

    def put(code: int) -> None:
        nonlocal bits, acc
        acc, bits = (acc << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((acc >> bits) & 255)
        acc &= (1 << bits) - 1

    put(256)
    free, word = 258, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in known:
            word = longer
            continue
        put(known[word])
        known[longer] = free
        free += 1
        width = max(9, free.bit_length())
        if free == 4094:
            put(256)
            known, free, width = {bytes((k,)): k for k in range(256)}, 258, 9
        word = data[i : i + 1]
    if word:
        put(known[word])
        free += 1
        width = max(9, free.bit_length())
    put(257)
    if bits:
        out.append((acc << (8 - bits)) & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    out, table, width, acc, bits, last = [], [], 9, 0, 0, None
    for byte in data:
        acc, bits = (acc << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, None
            continue
        if code == 257:
            break
        if last is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out.append(word)
        last = word
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def _squeeze(data: bytes, how: int) -> bytes:
    return {NONE: lambda d: d, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: packbits_encode}[how](data)


def _expand(data: bytes, how: int) -> bytes:
    if how not in (NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS):
        raise ValueError(f"compression {how} is not supported")
    return {NONE: lambda d: d, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: packbits_decode}[how](data)


def tiff_write(pages: list[np.ndarray], compression: str = "deflate", predictor: int = 2, rows_per_strip: int = 256, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian file of 8-bit pages, each (height, width) or (height, width, samples)."""
    how, out, link = NAMES[compression], bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        a = page if page.ndim == 3 else page[:, :, None]
        h, w, s = a.shape
        if tile:
            th, tw = tile
            padded = np.zeros((-(-h // th) * th, -(-w // tw) * tw, s), np.uint8)
            padded[:h, :w] = a
            blocks = [padded[y : y + th, x : x + tw] for y in range(0, h, th) for x in range(0, w, tw)]
        else:
            blocks = [a[y : y + rows_per_strip] for y in range(0, h, rows_per_strip)]
        at, sizes = [], []
        for b in blocks:
            if predictor == 2:
                d = b.copy()
                d[:, 1:] = b[:, 1:] - b[:, :-1]
                b = d
            data = _squeeze(b.tobytes(), how)
            at.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        tags = {WIDTH: [w], LENGTH: [h], BITS: [8] * s, COMPRESSION: [how], PHOTOMETRIC: [1], SAMPLES: [s], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [tw], TILE_LENGTH: [th], TILE_OFFSETS: at, TILE_SIZES: sizes} if tile else {STRIP_OFFSETS: at, ROWS_PER_STRIP: [rows_per_strip], STRIP_SIZES: sizes}
        entries = b""
        for tag in sorted(tags):
            short = tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PREDICTOR)
            v = struct.pack(f"<{len(tags[tag])}{'H' if short else 'I'}", *tags[tag])
            if len(v) > 4:
                place = struct.pack("<I", len(out))
                out += v + b"\0" * (len(v) % 2)
            else:
                place = v.ljust(4, b"\0")
            entries += struct.pack("<HHI", tag, 3 if short else 4, len(tags[tag])) + place
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


def tiff_pages(data: bytes) -> Iterator[np.ndarray]:
    """The pages of a file as (height, width, samples) arrays, along the linked directories; a loop of links ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a classic TIFF file")
    (at,), seen = struct.unpack_from(order + "I", data, 4), set()
    while at and at not in seen:
        seen.add(at)
        (n,), tags = struct.unpack_from(order + "H", data, at), {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in FIELD:
                continue
            size, code = FIELD[kind]
            where = at + 10 + 12 * k
            if size * count > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, where)
        if set(tags.get(BITS, (8,))) != {8}:
            raise ValueError("only 8-bit samples are supported")
        w, h, s, how, predictor = tags[WIDTH][0], tags[LENGTH][0], tags.get(SAMPLES, (1,))[0], tags.get(COMPRESSION, (NONE,))[0], tags.get(PREDICTOR, (1,))[0]
        if TILE_OFFSETS in tags:
            bw, bh, offsets, sizes = tags[TILE_WIDTH][0], tags[TILE_LENGTH][0], tags[TILE_OFFSETS], tags[TILE_SIZES]
        else:
            bw, bh, offsets, sizes = w, min(h, tags.get(ROWS_PER_STRIP, (h,))[0]), tags[STRIP_OFFSETS], tags[STRIP_SIZES]
        page, across = np.zeros((h, w, s), np.uint8), -(-w // bw)
        for k, (o, size) in enumerate(zip(offsets, sizes, strict=True)):
            y, x = k // across * bh, k % across * bw
            rows = bh if TILE_OFFSETS in tags else min(bh, h - y)
            block = np.frombuffer(_expand(data[o : o + size], how), np.uint8)[: rows * bw * s].reshape(rows, bw, s)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            page[y : y + rows, x : x + bw] = block[: h - y, : w - x]
        yield page
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def _image(payload: bytes, width: int) -> np.ndarray:
    padded = payload + b"\0" * (-len(payload) % width or (0 if payload else width))
    return np.frombuffer(padded, np.uint8).reshape(-1, width)


def to_tiff(df: DataFrame, payload: str, out: str = "media", width: int = 64, **how) -> DataFrame:
    """Add binary column ``out``: the payload (null: empty), padded with 0 to a positive multiple of ``width``, as a one-page file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [tiff_write([_image(x or b"", width)], **how) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(media, pa.binary())], schema=pa.schema([*list(b.schema)[:-1], pa.field(out, pa.binary())]))

    small_batches(df.sparkSession)
    kept = df.drop(out)
    return kept.select("*", F.col(payload).cast("binary").alias(out)).mapInArrow(run, kept.withColumn(out, F.lit(b"")).schema)


def pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per page of each file: the other columns, then page, width, height, samples int and pixels binary.

    A null file has no page; a malformed file fails the job.
    """
    others = df.drop(media)
    names = others.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, data in enumerate(b.column(b.num_columns - 1).to_pylist()):
                for k, p in enumerate(tiff_pages(data) if data is not None else ()):
                    at.append(i)
                    rows.append((k, p.shape[1], p.shape[0], p.shape[2], p.tobytes()))
            kept = b.take(pa.array(at, pa.int64()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int32()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[*names, "page", "width", "height", "samples", "pixels"])

    ddl = others.select("*", *[F.lit(0).alias(c) for c in ("page", "width", "height", "samples")], F.lit(b"").alias("pixels")).schema
    for f in ddl:
        f.nullable = True
    return df.select(*names, media).mapInArrow(run, ddl)


def digests(pages_df: DataFrame) -> DataFrame:
    """From pages with ``media_bytes`` and ``media_sha256``: sizes, digests and a feature of the pixels read back.

    ``feature`` is the share of each sixteenth of the sample range, in ten-thousandths, and the mean sample,
    in hundredths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column("pixels").to_pylist():
                a = np.frombuffer(x, np.uint8)
                share = np.bincount(a >> 4, minlength=16) * 10_000 // max(1, len(a))
                rows.append((len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:]), ",".join(map(str, share)) + f";{int(a.sum(dtype=np.int64)) * 100 // max(1, len(a))}"))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols[:3], kinds, strict=False)), b.column("media_bytes"), b.column("media_sha256"), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return pages_df.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
