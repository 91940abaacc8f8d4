import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import empty_documents, odd_documents
from tierfold.llm import tiff


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=2000))
def test_codecs_round_trip(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    assert tiff.packbits_decode(tiff.packbits_encode(data, 64)) == data


def test_lzw_fixed_case():
    # The case of the format's description: 7 7 7 8 8 7 7 6 6 gives codes 256 7 258 8 8 258 6 6 257.
    data = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    want = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_encode(data) == want and tiff.lzw_decode(want) == data


def test_lzw_over_many_tables():
    data = np.random.default_rng(5).integers(0, 40, 60_000, np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_packbits_fixed_case():
    packed = bytes.fromhex("fe aa 02 80 00 2a fd aa 03 80 00 2a 22 f7 aa".replace(" ", ""))
    want = bytes.fromhex("aa aa aa 80 00 2a aa aa aa aa 80 00 2a 22 aa aa aa aa aa aa aa aa aa aa".replace(" ", ""))
    assert tiff.packbits_decode(packed) == want
    assert tiff.packbits_decode(tiff.packbits_encode(want, 24)) == want


def test_big_endian_16_bit_strips_with_predictor():
    image = np.arange(12, dtype=np.uint16).reshape(3, 4) * 700
    raw = zlib.compress(np.diff(image, axis=1, prepend=np.zeros((3, 1), np.uint16)).astype(">u2").tobytes())
    tags = [(256, 3, 4), (257, 3, 3), (258, 3, 16), (259, 3, 8), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 3), (279, 4, len(raw)), (317, 3, 2)]
    at = 8 + len(raw) + len(raw) % 2
    ifd = struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags) + struct.pack(">I", 0)
    media = b"MM" + struct.pack(">HI", 42, at) + raw.ljust(at - 8, b"\0") + ifd
    (page,) = tiff.read_pages(media)
    assert (page.data[:, :, 0] == image).all() and page.bits == 16


def test_floating_point_predictor():
    image = np.linspace(-3, 9, 20, dtype=np.float32).reshape(2, 10, 1)
    planes = image.astype(">f4").view(np.uint8).reshape(2, 10, 4).transpose(0, 2, 1).reshape(2, 40)
    coded = np.diff(planes, axis=1, prepend=np.zeros((2, 1), np.uint8)).astype(np.uint8)
    assert (tiff.unpredict(coded.view(np.float32).reshape(2, 10, 1), 3) == image).all()


def test_pages_of_a_column(spark):
    payload = np.random.default_rng(6).integers(0, 255, 64 * 1300, np.uint8).tobytes()
    media = tiff.store(payload)
    looped = bytearray(media)
    df = spark.createDataFrame([(1, media), (2, None), (3, b""), (4, b"II*\0 broken"), (5, bytes(looped[:2000]))], "id long, media binary")
    rows = tiff.pages(df, "id", "media").orderBy("id", "page").collect()
    found = [r for r in rows if r.id == 1]
    assert b"".join(bytes(r.pixels) for r in found) == payload and {r.compression for r in found} == {1 * 5, 8, 32773}
    assert [(r.id, r.page) for r in rows if r.id != 1] == [(4, -1), (5, -1)] and all(r.error for r in rows if r.id != 1)


def test_query_columns_and_odd_rows(spark):
    df = odd_documents(spark)
    texts = {r.doc_id: (r.text or "").encode() for r in df.collect()}
    rows = tiff.text_features(df).collect()
    assert len(rows) == 10
    for r in rows:
        t = texts[r.doc_id]
        p = t + b"\0" * (max(64, -(-len(t) // 64) * 64) - len(t))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (5, 6)}) == 1
    assert tiff.text_features(empty_documents(spark)).count() == 0
    stored = tiff.text_media(df).collect()
    assert all(b"".join(p.data.tobytes() for p in tiff.read_pages(bytes(r.media)))[: r.n_bytes] == texts[r.doc_id] for r in stored)


@pytest.mark.parametrize("kind", [1, 5, 8, 32773])
def test_kinds(kind):
    image = np.random.default_rng(kind).integers(0, 9, (200, 64), np.uint8)
    for predictor, tiled in ((1, False), (2, True), (2, False)):
        (page,) = tiff.read_pages(tiff.write_pages([(image, kind, predictor, tiled)]))
        assert (page.data[:, :, 0] == image).all()


def test_broken_files_are_error_rows(spark):
    """Sizes, counts and offsets that a file can't bear, and bytes changed at random, give an error row or a page, and take no memory."""
    media = tiff.store(np.random.default_rng(7).integers(0, 9, 64 * 600, np.uint8).tobytes())
    (at,) = struct.unpack_from("<I", media, 4)
    (n,) = struct.unpack_from("<H", media, at)
    cases = []
    for k in range(n):
        for count, value in ((1, 0), (1, 2**31), (2**32 - 1, 8), (0, 0)):
            x = bytearray(media)
            struct.pack_into("<II", x, at + 2 + 12 * k + 4, count, value)
            cases.append(bytes(x))
    rng = np.random.default_rng(8)
    for _ in range(150):
        x = bytearray(media)
        for place in rng.integers(0, len(media), 4).tolist() + (at + rng.integers(0, 12 * n, 2)).tolist():
            x[place] = int(rng.integers(0, 256))
        cases.append(bytes(x))
    rows = tiff.pages(spark.createDataFrame(list(enumerate(cases)), "id long, media binary"), "id", "media").collect()
    assert {r.id for r in rows} == set(range(len(cases)))
    assert all((r.page == -1) == (r.error is not None) for r in rows) and any(r.error for r in rows)


def test_a_bomb_is_read_no_further_than_its_page():
    raw = zlib.compress(b"\0" * (1 << 26))
    assert len(tiff.decompress(raw, 8, 4096)) == 4096
    assert len(tiff.packbits_decode(b"\x81\0" * 100_000, 4096)) < 4096 + 128
    with pytest.raises(ValueError):
        tiff.lzw_decode(bytes.fromhex("80 3f ff ff"))
