"""Media columns: lossless TIFF files held in a binary column.

``decode_tiff`` walks the chain of image directories of one file, decodes PackBits, LZW, deflate or
uncompressed strips and tiles, undoes horizontal differencing, and yields one page per directory;
``tiff_pages`` applies it to a column and emits one row per page.  ``encode_tiff`` writes such files.

Defined results: a null text is an empty one; texts and files are read whole, however long; a null file has no pages; a
damaged file, one of a form that isn't read (other sample sizes, predictors, planes apart, bits in reverse), and one whose
pages claim more than its bytes can hold yield, after the pages before the damage, one row with ``error`` set and no
pixels, so that one bad file never ends a job; ``media_digests`` gives such files, and null ones, null digests and a feature
that says so.  Repeated rows are files of their own; an empty table gives no rows; other columns, whatever their names,
are neither read nor returned.
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

from .common import in_arrow

# Fixed values of the TIFF 6.0 format.
TAG_WIDTH, TAG_HEIGHT, TAG_BITS, TAG_COMPRESSION, TAG_PHOTOMETRIC = 256, 257, 258, 259, 262
TAG_STRIP_OFFSETS, TAG_SAMPLES, TAG_ROWS_PER_STRIP, TAG_STRIP_COUNTS = 273, 277, 278, 279
TAG_FILL_ORDER, TAG_PLANES = 266, 284
TAG_PREDICTOR, TAG_TILE_WIDTH, TAG_TILE_HEIGHT, TAG_TILE_OFFSETS, TAG_TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}

#: Samples in a row of a page, and rows in a page.
ROW, PAGE_ROWS, STRIP_ROWS = 576, 4096, 256
#: Bytes that a byte of a file can stand for in any of the compressions, generously.
MOST_RATIO = 4096


def packbits_decode(data: bytes, most: int | None = None) -> bytes:
    """Decoding ends once there are ``most`` bytes."""
    out, i = bytearray(), 0
    while i < len(data) and (most is None or len(out) < most):
        head = data[i]
        i += 1
        if head < 128:
            out += data[i : i + head + 1]
            i += head + 1
        elif head > 128:
            out += data[i : i + 1] * (257 - head)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes become repeats, all else literals of 128 bytes at most."""
    out, literal = bytearray(), bytearray()

    def flush() -> None:
        for at in range(0, len(literal), 128):
            part = literal[at : at + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    values = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.array([], int)
    for start, length in zip(starts.tolist(), np.diff(np.r_[starts, len(values)]).tolist()):
        if length < 3:
            literal.extend(data[start : start + length])
            continue
        flush()
        while length:
            step = min(128, length)
            out += bytes((257 - step, data[start])) if step > 1 else bytes((0, data[start]))
            length -= step
    flush()
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: codes from the high bit down, 256 clears, 257 ends, width grows one code early."""
    codes: list[tuple[int, int]] = []
    book: dict[tuple[int, int], int] = {}
    width, free = 9, 258
    codes.append((256, 9))
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        known = book.get((prefix, byte))
        if known is not None:
            prefix = known
            continue
        codes.append((prefix, width))
        book[prefix, byte] = free
        free += 1
        prefix = byte
        if free == 4094:
            codes.append((256, width))
            book.clear()
            width, free = 9, 258
        elif free == 1 << width:
            width += 1
    if prefix >= 0:
        codes.append((prefix, width))
        free += 1
        if free == 1 << width and width < 12:
            width += 1
    codes.append((257, width))
    value, bits = 0, 0
    out = bytearray()
    for code, size in codes:
        value = value << size | code
        bits += size
        while bits >= 8:
            bits -= 8
            out.append(value >> bits)
            value &= (1 << bits) - 1
    if bits:
        out.append(value << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """Decoding ends once there are ``most`` bytes."""
    out = bytearray()
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    book, width, before = list(first), 9, None
    value, bits = 0, 0
    for byte in data:
        value = value << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = value >> bits
        value &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            book, width, before = list(first), 9, None
            continue
        if before is None:
            entry = book[code]
        else:
            if code > len(book):
                raise ValueError("LZW code out of range")
            entry = book[code] if code < len(book) else before + before[:1]
            book.append(before + entry[:1])
        out += entry
        if most is not None and len(out) >= most:
            break
        before = entry
        if len(book) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def deflate_decode(data: bytes, most: int) -> bytes:
    # one more byte than wanted, so that a stream of the right length is read to its checksum
    return zlib.decompressobj().decompress(data, most + 1)[:most]


ENCODERS = {NONE: bytes, LZW: lzw_encode, DEFLATE: zlib.compress, PACKBITS: packbits_encode}
DECODERS = {NONE: lambda data, most: data, LZW: lzw_decode, DEFLATE: deflate_decode, OLD_DEFLATE: deflate_decode, PACKBITS: packbits_decode}


def _difference(rows: np.ndarray) -> np.ndarray:
    out = rows.copy()
    out[:, 1:] -= rows[:, :-1]
    return out


def encode_tiff(
    payload: bytes,
    row: int = ROW,
    page_rows: int = PAGE_ROWS,
    strip_rows: int = STRIP_ROWS,
    compression: int = DEFLATE,
    predictor: bool = True,
    tile: tuple[int, int] | None = None,
) -> bytes:
    """A little-endian grey-scale file of 8-bit samples, split into pages of at most ``page_rows`` rows.

    The payload's length must be a positive multiple of ``row``.  ``tile`` (width, height, multiples of
    16) stores tiles, padded with zeros, instead of strips.
    """
    samples = np.frombuffer(payload, np.uint8).reshape(-1, row)
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for top in range(0, len(samples), page_rows):
        page = samples[top : top + page_rows]
        height = len(page)
        if tile:
            wide, high = tile
            padded = np.zeros((-(-height // high) * high, -(-row // wide) * wide), np.uint8)
            padded[:height, :row] = page
            parts = [padded[y : y + high, x : x + wide] for y in range(0, len(padded), high) for x in range(0, padded.shape[1], wide)]
        else:
            parts = [page[y : y + strip_rows] for y in range(0, height, strip_rows)]
        offsets, counts = [], []
        for part in parts:
            data = ENCODERS[compression]((_difference(part) if predictor else part).tobytes())
            offsets.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) & 1)
        fields = [(TAG_WIDTH, 4, [row]), (TAG_HEIGHT, 4, [height]), (TAG_BITS, 3, [8]), (TAG_COMPRESSION, 3, [compression]), (TAG_PHOTOMETRIC, 3, [1]), (TAG_SAMPLES, 3, [1]), (TAG_PREDICTOR, 3, [2 if predictor else 1])]
        fields += [(TAG_TILE_WIDTH, 4, [tile[0]]), (TAG_TILE_HEIGHT, 4, [tile[1]]), (TAG_TILE_OFFSETS, 4, offsets), (TAG_TILE_COUNTS, 4, counts)] if tile else [(TAG_STRIP_OFFSETS, 4, offsets), (TAG_ROWS_PER_STRIP, 4, [strip_rows]), (TAG_STRIP_COUNTS, 4, counts)]
        entries = bytearray()
        for tag, kind, values in sorted(fields):
            packed = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(packed) > 4:
                at = len(out)
                out += packed
                packed = struct.pack("<I", at)
            entries += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def decode_tiff(data: bytes) -> Iterator[np.ndarray]:
    """The pages of a file, each as rows of 8-bit samples (samples of a pixel side by side)."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        field: dict[int, tuple[int, ...]] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            letter = {1: "B", 3: "H", 4: "I"}.get(kind)
            if letter is None:
                continue
            where = at + 10 + 12 * k
            if FIELD_BYTES[kind] * count > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            field[tag] = struct.unpack_from(f"{order}{count}{letter}", data, where)
        (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        at = following
        yield _page(data, field)


def _page(data: bytes, field: dict[int, tuple[int, ...]]) -> np.ndarray:
    one = lambda tag, default: field.get(tag, (default,))[0]
    width, height, per_pixel = one(TAG_WIDTH, 0), one(TAG_HEIGHT, 0), one(TAG_SAMPLES, 1)
    if set(field.get(TAG_BITS, (8,))) != {8} or one(TAG_COMPRESSION, NONE) not in DECODERS:
        raise ValueError("only 8-bit samples in the known compressions are read")
    if one(TAG_PREDICTOR, 1) not in (1, 2) or one(TAG_FILL_ORDER, 1) != 1 or one(TAG_PLANES, 1) != 1 and per_pixel > 1:
        raise ValueError("only samples side by side, first bit first, whole or as differences are read")
    wide, high = one(TAG_TILE_WIDTH, width), one(TAG_TILE_HEIGHT, 1)
    if min(width, height, per_pixel, wide, high) < 1 or (width + wide) * (height + high) * per_pixel > MOST_RATIO * (len(data) + 1024):
        raise ValueError("the file can't hold a page of this size")
    decode, differenced = DECODERS[one(TAG_COMPRESSION, NONE)], one(TAG_PREDICTOR, 1) == 2

    def part(offset: int, count: int, rows: int, columns: int) -> np.ndarray:
        size = rows * columns * per_pixel
        raw = np.frombuffer(decode(data[offset : offset + count], size), np.uint8)[:size]
        pixels = raw.reshape(rows, columns, per_pixel)
        return (np.cumsum(pixels, axis=1, dtype=np.uint8) if differenced else pixels).reshape(rows, columns * per_pixel)

    if TAG_TILE_OFFSETS in field:
        across = -(-width // wide)
        page = np.zeros((-(-height // high) * high, across * wide * per_pixel), np.uint8)
        for k, (offset, count) in enumerate(zip(field[TAG_TILE_OFFSETS], field[TAG_TILE_COUNTS], strict=True)):
            y, x = k // across * high, k % across * wide * per_pixel
            page[y : y + high, x : x + wide * per_pixel] = part(offset, count, high, wide)
        return page[:height, : width * per_pixel]
    tall = min(one(TAG_ROWS_PER_STRIP, height), height) or height
    strips = zip(field[TAG_STRIP_OFFSETS], field[TAG_STRIP_COUNTS], strict=True)
    if len(field[TAG_STRIP_OFFSETS]) != -(-height // tall):
        raise ValueError("strips and rows don't agree")
    return np.concatenate([part(offset, count, min(tall, height - k * tall), width) for k, (offset, count) in enumerate(strips)])


def tiff_pages(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per page: key, page, height, width, pixels (row by row) and error."""

    def run(batches):
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = -1
                try:
                    for page, samples in enumerate(decode_tiff(data) if data is not None else ()):
                        rows.append((k, page, samples.shape[0], samples.shape[1], samples.tobytes(), None))
                except Exception as why:  # whatever a file holds, it must not end the job
                    rows.append((k, page + 1, None, None, None, str(why) or "damaged"))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "page", "height", "width", "pixels", "error"])

    kind = df.schema[key].dataType.simpleString()
    return in_arrow(df.select(F.col(key).alias("key"), F.col(media).alias("media")), run, f"key {kind}, page int, height int, width int, pixels binary, error string")


def payload_of(text: str | None, row: int = ROW) -> tuple[int, bytes]:
    """Bytes of the text before and after padding with 255 to a positive multiple of ``row``."""
    data = (text or "").encode()
    return len(data), data.ljust(max(1, -(-len(data) // row)) * row, b"\xff")


def feature_of(pages: list[np.ndarray]) -> str:
    """Pages, rows, mean, deviation and the commonest sample of what was read back."""
    counts = sum(np.bincount(p.ravel(), minlength=256) for p in pages)
    total, values = int(counts.sum()), np.arange(256)
    mean = int((counts * values).sum()) / total
    deviation = (int((counts * values * values).sum()) / total - mean * mean) ** 0.5
    return f"pages={len(pages)};rows={sum(len(p) for p in pages)};mean={mean:.4f};std={deviation:.4f};mode={int(counts.argmax())}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


FORMS = {0: {"compression": LZW}, 1: {"compression": PACKBITS, "predictor": False}, 2: {"tile": (192, 64)}, 3: {"compression": NONE, "predictor": False}}


def text_media(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as a TIFF file: key, n_bytes and media.  Rows keep their order and number.

    Most files are deflated in strips; by their payload's checksum some are stored in each of the other FORMS, so that
    every form is written and read in earnest.
    """

    def run(batches):
        for batch in batches:
            keys, sizes, media = batch.column(0), [], []
            for value in batch.column(1).to_pylist():
                n, payload = payload_of(value)
                sizes.append(n)
                media.append(encode_tiff(payload, **FORMS.get(zlib.crc32(payload) % 16, {})))
            yield pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return in_arrow(documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, n_bytes long, media binary")


def media_digests(media: DataFrame) -> DataFrame:
    """Read stored files back, page by page, and describe them: one row per file."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, n, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    if data is None:
                        raise ValueError("no file")
                    pages = list(decode_tiff(data))
                except Exception as why:  # whatever a file holds, it must not end the job
                    rows.append((key, n, None, None, None, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), f"error={why}"))
                    continue
                payload = b"".join(p.tobytes() for p in pages)
                rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(pages)))
            columns = list(zip(*rows)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in DIGEST.split(", ")])

    return in_arrow(media.select("doc_id", "n_bytes", "media"), run, DIGEST)
