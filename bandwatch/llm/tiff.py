"""TIFF columns: encode samples as TIFF bytes, and walk TIFF bytes into a row per page.

The reader follows the chain of image directories of a classic or big TIFF of either
byte order, decodes uncompressed, PackBits, LZW and deflate strips or tiles, undoes
horizontal and floating-point predictors, and puts the pieces together to a page.
Chunky and planar samples of 8, 16, 32 and 64 bits (integers or floats) are read.

Nulls and odd rows: a null or empty file has no pages; a broken page has the reason in
``error``, and the walk goes on behind it; where the walk breaks there is a row with page
-1; repeated rows are decoded each; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwatch.llm.common import per_row, texts

# Fixed values of the format: tags, field types (struct code), compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: What broken bytes raise, and bytes of pages in a batch.
BROKEN = (ValueError, KeyError, TypeError, OverflowError, IndexError, StopIteration, struct.error, zlib.error, MemoryError)
BATCH_BYTES = 4 << 20
LZW_CLEAR, LZW_END, LZW_BITS = 256, 257, 12


@dataclass
class Page:
    number: int
    width: int
    height: int
    compression: int
    predictor: int
    tiled: bool
    samples: np.ndarray  # (height, width, samples a pixel)


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more become repeats, all else literals."""
    out, at, literal = bytearray(), 0, bytearray()

    def flush() -> None:
        for i in range(0, len(literal), 128):
            part = literal[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 2:
            flush()
            out.extend((257 - run, data[at]))
        else:
            literal += data[at : at + run]
        at += run
    flush()
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; widths grow one code early."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, width, pool, bits, last = list(base), bytearray(), 9, 0, 0, b""
    for byte in data:
        pool, bits = (pool << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = pool >> bits & (1 << width) - 1
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            table, width, last = list(base), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) + 1 >= 1 << width and width < LZW_BITS:
            width += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    codes: list[tuple[int, int]] = [(LZW_CLEAR, 9)]
    table, width, prefix = {bytes([i]): i for i in range(256)}, 9, b""
    following = LZW_END + 1
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        codes.append((table[prefix], width))
        table[longer] = following
        following += 1
        if following >= 1 << width:
            width += 1
        if following == (1 << LZW_BITS) - 2:
            codes.append((LZW_CLEAR, width))
            table, width, following = {bytes([j]): j for j in range(256)}, 9, LZW_END + 1
        prefix = longer[-1:]
    if prefix:
        codes.append((table[prefix], width))
        following += 1
        if following >= 1 << width and width < LZW_BITS:
            width += 1
    codes.append((LZW_END, width))
    bits = "".join(f"{code:0{w}b}" for code, w in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def decompress(data: bytes, compression: int) -> bytes:
    if compression == PLAIN:
        return data
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return lzw_decode(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    raise ValueError(f"compression {compression} is not supported")


def undo_predictor(rows: np.ndarray, predictor: int) -> np.ndarray:
    """``rows``: (rows, pixels, samples), in native byte order but for predictor 3,
    which takes the stored bytes as (rows, bytes of a row, samples a pixel, bytes a sample)."""
    if predictor == 1:
        return rows
    if predictor == 2:
        return np.cumsum(rows, axis=1, dtype=rows.dtype)
    raise ValueError(f"predictor {predictor} is not supported")


def _float_rows(raw: np.ndarray, height: int, width: int, samples: int, size: int) -> np.ndarray:
    """Floating-point predictor: byte planes, most significant first, differenced along the row."""
    planes = np.cumsum(raw.reshape(height, -1, samples), axis=1, dtype=np.uint8).reshape(height, size, width * samples)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").reshape(height, width, samples).astype(f"f{size}")


def _fields(data: bytes, at: int, order: str, big: bool) -> tuple[dict[int, tuple], int]:
    head, entry, word = ("Q", 20, 8) if big else ("H", 12, 4)
    (n,) = struct.unpack_from(order + head, data, at)
    at += struct.calcsize(head)
    fields = {}
    for i in range(n):
        where = at + i * entry
        tag, kind = struct.unpack_from(order + "HH", data, where)
        (count,) = struct.unpack_from(order + ("Q" if big else "I"), data, where + 4)
        if kind not in TYPES:
            continue
        code, value = TYPES[kind], where + 4 + word
        if struct.calcsize(code) * count > word:
            (value,) = struct.unpack_from(order + ("Q" if big else "I"), data, value)
        fields[tag] = struct.unpack_from(f"{order}{count}{code}", data, value)
    return fields, struct.unpack_from(order + ("Q" if big else "I"), data, at + n * entry)[0]


def pages(data: bytes) -> Iterator[Page]:
    """Every page of a TIFF file, in the order of its directories."""
    for number, fields, order in directories(data):
        yield _page(data, fields, order, number)


def directories(data: bytes) -> Iterator[tuple[int, dict[int, tuple], str]]:
    """(number, fields, byte order) of every image directory."""
    if data[:2] not in (b"II", b"MM"):
        raise ValueError("no TIFF byte order mark")
    order = "<" if data[:2] == b"II" else ">"
    (version,) = struct.unpack_from(order + "H", data, 2)
    if version not in (42, 43):
        raise ValueError("no TIFF version")
    (at,) = struct.unpack_from(order + "Q", data, 8) if version == 43 else struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("image directories form a loop")
        seen.add(at)
        fields, following = _fields(data, at, order, version == 43)
        yield len(seen) - 1, fields, order
        at = following


def _page(data: bytes, fields: dict[int, tuple], order: str, number: int) -> Page:
    one = lambda tag, default=None: fields.get(tag, (default,))[0]
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, form, compression, predictor = one(BITS, 1), one(SAMPLE_FORMAT, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    if bits not in (8, 16, 32, 64) or form not in (1, 2, 3):
        raise ValueError(f"{bits} bits of sample format {form} are not supported")
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[form] + str(bits // 8))
    tiled, planar = TILE_OFFSETS in fields, one(PLANAR, 1) == 2 and samples > 1
    across, down = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    offsets, sizes = fields[TILE_OFFSETS if tiled else STRIP_OFFSETS], fields[TILE_BYTES if tiled else STRIP_BYTES]
    planes, depth = (samples, 1) if planar else (1, samples)
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    parts = iter(zip(offsets, sizes, strict=True))
    for plane in range(planes):
        for top in range(0, height, down):
            for left in range(0, width, across):
                offset, size = next(parts)
                rows = down if tiled else min(down, height - top)
                raw = decompress(data[offset : offset + size], compression)[: rows * across * depth * kind.itemsize]
                if predictor == 3:
                    block = _float_rows(np.frombuffer(raw, np.uint8), rows, across, depth, kind.itemsize)
                else:
                    block = np.frombuffer(raw, kind).reshape(rows, across, depth).astype(out.dtype, copy=False)
                    block = undo_predictor(block, predictor)
                high, wide = min(down, height - top), min(across, width - left)
                out[top : top + high, left : left + wide, plane : plane + depth] = block[:high, :wide]
    return Page(number, width, height, compression, predictor, tiled, out)


def encode(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = 256, tile: int = 0) -> bytes:
    """A little-endian TIFF of unsigned-integer images (height, width[, samples]), a page each."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for image in images:
        image = image.reshape(*image.shape[:2], -1)
        height, width, samples = image.shape
        high, wide = (tile, tile) if tile else (min(strip_rows, height), width)
        places = []
        for top in range(0, height, high):
            for left in range(0, width, wide):
                block = image[top : top + high, left : left + wide]
                if tile:
                    block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                raw = block.astype(block.dtype.newbyteorder("<")).tobytes()
                raw = {PLAIN: bytes, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 6)}[compression](raw)
                places.append((len(out), len(raw)))
                out += raw
        offsets, sizes = zip(*places)
        fields = [
            (WIDTH, "I", (width,)), (HEIGHT, "I", (height,)), (BITS, "H", (image.dtype.itemsize * 8,) * samples),
            (COMPRESSION, "H", (compression,)), (PHOTOMETRIC, "H", (1,)), (SAMPLES, "H", (samples,)), (PREDICTOR, "H", (predictor,)),
        ]
        if tile:
            fields += [(TILE_WIDTH, "I", (tile,)), (TILE_HEIGHT, "I", (tile,)), (TILE_OFFSETS, "I", offsets), (TILE_BYTES, "I", sizes)]
        else:
            fields += [(STRIP_OFFSETS, "I", offsets), (STRIP_ROWS, "I", (high,)), (STRIP_BYTES, "I", sizes)]
        body = bytearray()
        for tag, code, values in sorted(fields):
            packed = struct.pack(f"<{len(values)}{code}", *values)
            if len(packed) > 4:
                out += b"\0" * (len(out) % 2)
                place = struct.pack("<I", len(out))
                out += packed
            else:
                place = packed.ljust(4, b"\0")
            body += struct.pack("<HHI", tag, 3 if code == "H" else 4, len(values)) + place
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + body
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


PAGE_SCHEMA = (
    "page int, width int, height int, samples int, compression int, predictor int, tiled boolean, bits int, pixels binary, error string"
)


def read_pages(files: DataFrame, id_col: str, file_col: str) -> DataFrame:
    """(id, page, width, height, samples, compression, predictor, tiled, bits, pixels, error): one row per page.

    pixels: the decoded samples, row by row, little-endian. A page that cannot be decoded has its number and an
    error, and the next ones follow; a file whose directories cannot be walked on has a row with page -1 at that place.
    Rows of a file stand together, in the order of its pages.
    """

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for i, data in enumerate(batch.column(1)):
                for row in decoded(data.as_py() or b""):
                    rows.append((i, *row))
                    size += len(row[8] or b"")
                    if size > BATCH_BYTES:
                        yield made(batch, rows)
                        rows, size = [], 0
            yield made(batch, rows)

    def made(batch, rows):
        columns = list(zip(*rows)) or [()] * 11
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(v, t) for v, t in zip(columns[1:], kinds))], names=names
        )

    def decoded(data: bytes):
        walk = directories(data) if data else iter(())
        while True:
            try:
                number, fields, order = next(walk)
            except StopIteration:
                return
            except BROKEN as e:
                yield -1, *[None] * 8, f"{type(e).__name__}: {e}"
                return
            try:
                p = _page(data, fields, order, number)
                plain = p.samples.astype(p.samples.dtype.newbyteorder("<"), copy=False)
                yield p.number, p.width, p.height, plain.shape[2], p.compression, p.predictor, p.tiled, plain.dtype.itemsize * 8, plain.tobytes(), None
            except BROKEN as e:
                yield number, *[None] * 8, f"{type(e).__name__}: {e}"

    kinds = [*[pa.int32()] * 6, pa.bool_(), pa.int32(), pa.binary(), pa.string()]
    names = [id_col, *(c.split()[0] for c in PAGE_SCHEMA.split(", "))]
    key = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, F.col(file_col).cast("binary")).mapInArrow(run, f"`{id_col}` {key}, {PAGE_SCHEMA}")


#: Samples in a row of a stored text.
ROW = 64


def store_text(text: bytes) -> bytes:
    """A text as the 8-bit samples of a TIFF, padded with zeros to whole rows.

    A digest of the text picks one of up to three pages, strips or tiles, a predictor or
    none, and the compression: of 16 texts one has PackBits, one LZW, one none, the others deflate.
    """
    payload = text + b"\0" * (max(ROW, -(-len(text) // ROW) * ROW) - len(text))
    rows, by = np.frombuffer(payload, np.uint8).reshape(-1, ROW), hashlib.sha256(text).digest()
    images = np.array_split(rows, min(1 + by[0] % 3, len(rows)))
    compression = {0: PACKBITS, 1: LZW, 2: PLAIN}.get(by[1] % 16, DEFLATE)
    return encode(images, compression, 1 + by[2] % 2, 256, ROW * (by[3] % 2))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, file): each text and the TIFF that holds it."""
    return per_row(texts(docs, id_col, text_col), "n_bytes long, file binary", lambda: lambda t: (len(t), store_text(t)))


def feature(samples: np.ndarray) -> str:
    """A 64-bit fingerprint of a page: which of its columns are brighter than the page."""
    columns = np.array_split(np.arange(samples.shape[1]), 64)
    means = np.array([samples[:, c].mean() if len(c) else 0.0 for c in columns])
    return np.packbits(means > samples.mean()).tobytes().hex()
