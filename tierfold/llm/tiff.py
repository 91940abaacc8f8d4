"""Media columns: TIFF files in a binary column, one row per page.

``read_pages`` walks the chain of image directories in either byte order, decodes PackBits, LZW or deflate strips and
tiles, undoes the horizontal (2) and floating-point (3) predictors, and gives each page's samples. ``write_pages`` makes
files with the same means, so that bytes can be stored as 8-bit grey samples and read back unchanged.

Null or empty media: no page. A broken file: the pages before the fault, and a row with page -1 and the error's text; a
count, size or offset that the file's bytes can't bear is a fault, found before memory is taken for it. A null text as payload: empty,
padded to 64 zero bytes. Very long payloads: many pages. Equal payloads: equal files. Empty table: no rows. Further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierfold.llm.common import map_rows, text_rows

# Fixed values of the format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 322, 323, 324, 325, 339
CLEAR, END, FIRST = 256, 257, 258
#: No compression here gives more bytes for one.
MOST_RATIO = 4096

#: Rows of one page of a stored payload, and of its strips; tiles are square.
PAGE_ROWS, STRIP_ROWS, ROW = 512, 128, 64

# Width of the j-th code after a clear code: it grows when entries 511, 1023 and 2047 have been added; at 4094 the table is cleared.
_WIDTHS = np.repeat([9, 10, 11, 12], [254, 512, 1024, 2048]).astype(np.int64)
_AT = np.concatenate([[0], np.cumsum(_WIDTHS)])
_LAST = 4094 - FIRST


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """Stops once it has ``most`` bytes."""
    size = 0
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
    n_bits, at = len(data) * 8, 0
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    out: list[bytes] = []
    while at + 9 <= n_bits:
        # Until the next clear code every code's place is known beforehand.
        n = int(np.searchsorted(_AT, n_bits - at, "right")) - 1
        pos = at + _AT[:n]
        o, w = pos >> 3, _WIDTHS[:n]
        codes = ((raw[o] << 16 | raw[o + 1] << 8 | raw[o + 2]) >> (24 - w - (pos & 7))) & ((1 << w) - 1)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(stops[0]) if len(stops) else n
        table, prev = single.copy(), b""
        add = table.append
        for c in codes[:stop].tolist():
            if not prev:
                prev = table[c]
            else:
                if c > len(table):
                    raise ValueError(f"LZW code {c} of {len(table)}")
                entry = table[c] if c < len(table) else prev + prev[:1]
                add(prev + entry[:1])
                prev = entry
            out.append(prev)
        if most is not None:
            size = sum(map(len, out))
            if size >= most:
                break
        if not len(stops) or codes[stop] == END:
            break
        at = int(pos[stop] + w[stop])
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    segments: list[list[int]] = [[CLEAR]]
    seg: list[int] = []
    table: dict[int, int] = {}
    get, new = table.get, FIRST
    code = -1
    for b in data:
        if code < 0:
            code = b
            continue
        key = code << 8 | b
        found = get(key)
        if found is not None:
            code = found
            continue
        seg.append(code)
        table[key] = new
        new += 1
        code = b
        if new > 4094:
            segments.append([*seg, CLEAR])
            seg, new = [], FIRST
            table.clear()
    segments.append([*seg, code, END] if code >= 0 else [*seg, END])
    codes = np.concatenate([np.array(s, np.uint16) for s in segments])
    widths = np.concatenate([_WIDTHS[: len(s)] for s in segments])
    bits = np.unpackbits(codes.astype(">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= 16 - widths[:, None]]).tobytes()


_RUN = re.compile(rb"(.)\1{2,}", re.S)


def packbits_encode(data: bytes, row: int) -> bytes:
    """Rows are packed one by one."""
    if row <= 128 and len(data) % row == 0 and not _RUN.search(data):
        a = np.frombuffer(data, np.uint8).reshape(-1, row)
        return np.concatenate([np.full((len(a), 1), row - 1, np.uint8), a], axis=1).tobytes()
    out: list[bytes] = []

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            chunk = part[i : i + 128]
            out.extend((bytes([len(chunk) - 1]), chunk))

    for s in range(0, len(data), row):
        line, at = data[s : s + row], 0
        for m in _RUN.finditer(line):
            literal(line[at : m.start()])
            left = m.end() - m.start()
            while left:
                n = min(left, 128)
                if n == 1:
                    literal(m.group(1))
                else:
                    out.append(bytes([257 - n]) + m.group(1))
                left -= n
            at = m.end()
        literal(line[at:])
    return b"".join(out)


def packbits_decode(data: bytes, most: int | None = None) -> bytes:
    out: list[bytes] = []
    i, n, size = 0, len(data), 0
    while i < n and (most is None or size < most):
        h = data[i]
        if h < 128:
            out.append(data[i + 1 : i + 2 + h])
            i += 2 + h
            size += 1 + h
        elif h == 128:
            i += 1
        else:
            out.append(data[i + 1 : i + 2] * (257 - h))
            i += 2
            size += 257 - h
    return b"".join(out)


def decompress(data: bytes, compression: int, most: int) -> bytes:
    """``most``: the bytes that are needed."""
    if compression == NONE:
        return data
    if compression == LZW:
        return lzw_decode(data, most)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    if compression == PACKBITS:
        return packbits_decode(data, most)
    raise ValueError(f"compression {compression}")


def unpredict(block: np.ndarray, predictor: int) -> np.ndarray:
    """``block``: rows x columns x samples."""
    if predictor == 1:
        return block
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor == 3:
        rows, cols, samples = block.shape
        size = block.dtype.itemsize
        planes = np.cumsum(np.ascontiguousarray(block).view(np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        parts = planes.reshape(rows, size, cols * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(parts).view(block.dtype.newbyteorder(">")).reshape(rows, cols, samples).astype(block.dtype)
    raise ValueError(f"predictor {predictor}")


@dataclass
class Page:
    page: int
    width: int
    height: int
    bits: int
    samples: int
    compression: int
    predictor: int
    data: np.ndarray


def _tags(media: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", media, at)
    tags: dict[int, tuple] = {}
    for k in range(n):
        entry = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(order + "HHI", media, entry)
        code = TYPES.get(kind)
        if code is None:
            continue
        form = f"{order}{count * len(code)}{code[0]}"
        size = struct.calcsize(form)
        if size > len(media):
            raise ValueError(f"tag {tag}: {count} values")
        place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", media, entry + 8)[0]
        tags[tag] = struct.unpack_from(form, media, place)
    return tags, struct.unpack_from(order + "I", media, at + 2 + 12 * n)[0]


def read_pages(media: bytes) -> Iterator[Page]:
    order = {b"II": "<", b"MM": ">"}.get(media[:2])
    if order is None or struct.unpack_from(order + "H", media, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", media, 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        tags, after = _tags(media, at, order)
        one = lambda tag, default=None: tags.get(tag, (default,))[0]  # noqa: E731, B023
        width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        bits, compression, predictor = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
        if min(width, height, samples) < 1 or width * height * samples * (bits // 8) > MOST_RATIO * len(media):
            raise ValueError(f"{width} x {height} x {samples} samples in {len(media)} bytes")
        if bits not in (8, 16, 32, 64) or one(PLANAR, 1) != 1:
            raise ValueError(f"{bits} bits a sample, planar configuration {one(PLANAR, 1)}")
        kind = np.dtype(f"{order}{'f' if one(SAMPLE_FORMAT, 1) == 3 else 'u'}{bits // 8}")
        tiled = TILE_OFFSETS in tags
        w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
        if min(w, h) < 1 or w * h * samples * (bits // 8) > MOST_RATIO * len(media):
            raise ValueError(f"blocks of {w} x {h}")
        across = -(-width // w)
        blocks = list(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS], strict=True))
        if len(blocks) != across * -(-height // h):
            raise ValueError(f"{len(blocks)} blocks")
        image = np.zeros((height, width, samples), kind.newbyteorder("="))
        for k, (o, n) in enumerate(blocks):
            y, x = k // across * h, k % across * w
            rows = h if tiled else min(h, height - y)
            raw = decompress(media[o : o + n], compression, rows * w * samples * kind.itemsize)
            flat = np.frombuffer(raw, kind, rows * w * samples).reshape(rows, w, samples)
            block = unpredict(flat if predictor == 3 else flat.astype(kind.newbyteorder("=")), predictor)
            image[y : y + rows, x : x + w] = block[: height - y, : width - x]
        yield Page(len(seen) - 1, width, height, bits, samples, compression, predictor, image)
        at = after


def write_pages(pages: list[tuple[np.ndarray, int, int, bool]]) -> bytes:
    """A little-endian file of grey 8-bit pages: (samples, compression, predictor 1 or 2, tiled)."""
    out = bytearray(b"II" + struct.pack("<HI", 42, 0))
    link = 4
    for image, compression, predictor, tiled in pages:
        height, width = image.shape
        blocks: list[np.ndarray] = []
        if tiled:
            side = 64
            full = np.zeros((-(-height // side) * side, -(-width // side) * side), np.uint8)
            full[:height, :width] = image
            blocks = [full[y : y + side, x : x + side] for y in range(0, full.shape[0], side) for x in range(0, full.shape[1], side)]
        else:
            blocks = [image[y : y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
        offsets, counts = [], []
        for b in blocks:
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=np.zeros((len(b), 1), np.uint8))
            raw = b.tobytes()
            raw = raw if compression == NONE else lzw_encode(raw) if compression == LZW else packbits_encode(raw, b.shape[1]) if compression == PACKBITS else zlib.compress(raw, 1)
            offsets.append(len(out))
            counts.append(len(raw))
            out += raw
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 3, [64]), (TILE_HEIGHT, 3, [64]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tiled else [(ROWS_PER_STRIP, 4, [STRIP_ROWS]), (STRIP_OFFSETS, 4, offsets), (STRIP_COUNTS, 4, counts)]
        entries = []
        for tag, kind, values in sorted(tags):
            form = f"<{len(values)}{'H' if kind == 3 else 'I'}"
            packed = struct.pack(form, *values)
            if len(packed) > 4:
                out += b"\0" * (len(out) % 2)
                entries.append(struct.pack("<HHII", tag, kind, len(values), len(out)))
                out += packed
            else:
                entries.append(struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def pages(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per page of each file."""

    def make():
        def f(rows):
            out = {k: [] for k in ("id", "page", "width", "height", "bits", "samples", "compression", "predictor", "pixels", "error")}

            def put(*values):
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)

            for i, media in zip(rows["id"], rows["media"], strict=True):
                if not media:
                    continue
                try:
                    for p in read_pages(media):
                        put(i, p.page, p.width, p.height, p.bits, p.samples, p.compression, p.predictor, p.data.tobytes(), None)
                except Exception as e:  # whatever a broken file leads to is its own row's matter
                    put(i, -1, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")
            return out

        return f

    ddl = "id long, page int, width int, height int, bits int, samples int, compression int, predictor int, pixels binary, error string"
    return map_rows(df.select(df[id_col].cast("long").alias("id"), F.col(media_col).alias("media")), ddl, make)


def store(payload: bytes) -> bytes:
    """A payload of a multiple of 64 bytes as grey pages 64 samples wide; the means of each page follow from the payload's checksum."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    first = zlib.crc32(payload)
    means = ((DEFLATE, 2, True), (LZW, 1, False), (PACKBITS, 1, False))
    return write_pages([(image[y : y + PAGE_ROWS], *means[(first + k) % 3]) for k, y in enumerate(range(0, len(image), PAGE_ROWS))])


def feature(samples: np.ndarray, n_pages: int) -> str:
    """Pages, mean, deviation, entropy of the histogram, and an 8 x 8 average hash, of rows of 64 samples."""
    counts = np.bincount(samples.ravel(), minlength=256)
    n, values = samples.size, np.arange(256)
    mean = float(counts @ values) / n
    deviation = max(0.0, float(counts @ (values * values)) / n - mean * mean) ** 0.5
    p = counts[counts > 0] / n
    rows = samples.reshape(-1, 8, 8).sum(axis=2, dtype=np.int64)
    height = len(rows)
    sums = np.concatenate([np.zeros((1, 8), np.int64), np.cumsum(rows, axis=0)])
    lo = np.arange(8) * height // 8
    hi = np.maximum(lo + 1, np.arange(1, 9) * height // 8)
    cells = (sums[hi] - sums[lo]) / ((hi - lo)[:, None] * 8)
    bits = np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
    return f"pages={n_pages};mean={mean:.6f};std={deviation:.6f};entropy={-float(p @ np.log2(p)) + 0.0:.6f};ahash={bits}"


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored as TIFF: (doc_id, n_bytes, media binary)."""

    def make():
        def f(rows):
            return {"doc_id": rows["doc_id"], "n_bytes": [len(t) for t in rows["text"]], "media": [store(padded(t)) for t in rows["text"]]}

        return f

    return map_rows(text_rows(df, id_col, text_col, binary=True), "doc_id long, n_bytes long, media binary", make)


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % ROW if text else ROW)


def text_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as TIFF, read back from the stored bytes, and described; a map without shuffle."""

    def make():
        def f(rows):
            out = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for text in rows["text"]:
                media = store(padded(text))
                found = [p.data[:, :, 0] for p in read_pages(media)]
                samples = np.concatenate(found)
                payload = samples.tobytes()
                for k, v in zip(out, (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples, len(found))), strict=True):
                    out[k].append(v)
            return {"doc_id": rows["doc_id"]} | out

        return f

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(text_rows(df, id_col, text_col, binary=True), ddl, make)
