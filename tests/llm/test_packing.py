import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tests.llm.cases import empty_documents, odd_documents
from tierfold.llm import packing

VOCAB = P.path("byte_bpe_50k.json")


def library_ids(text):
    t = Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids + [2]


def test_ids_as_the_library():
    ids = packing.Ids(VOCAB, P.PATTERN, cache=5)
    for text in ("Hello world's 123 \n\n  x", "<|endoftext|> a", "東京 é ß \U0001f600", "", "a" * 3000):
        assert np.frombuffer(ids(text) + b"\2\0\0\0", "<u4").tolist() == library_ids(text)


def test_pieces_and_sequences(spark):
    df = odd_documents(spark)
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    rows = packing.pack(packing.pieces(df, VOCAB, P.PATTERN, 2), packer=3).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc, found in by_doc.items():
        ids = np.array(library_ids(texts[doc]), "<u4")
        copies = 2 if doc == 5 else 1
        assert sum(r.length for r in found) == copies * len(ids)
        for r in found:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            assert r.length == 1024 or r.piece == 0
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(packing.pieces(empty_documents(spark), VOCAB, P.PATTERN, 2)).count() == 0


def test_bounded_bins_close_the_fullest():
    bins, offsets = packing.best_fit([60, 70, 80, 25], 100, 2)
    assert bins == [0, 1, 2, 0] and offsets == [0, 0, 0, 60]  # 80 found two bins open: that of 70 closed


def naive(lengths, capacity, open_bins):
    """Bounded best fit by looking at every open bin; of equal ones the one that got its room last."""
    free, seen, bins, offsets, closed, n, tick = {}, {}, [], [], 0, 0, 0
    for length in lengths:
        fits = [b for b in free if free[b] >= length]
        if fits:
            b = min(fits, key=lambda b: (free[b], -seen[b]))
        else:
            if len(free) >= open_bins:
                gone = min(free, key=lambda b: (free[b], -seen[b]))
                del free[gone]
                closed += 1
            b, n = n, n + 1
            free[b] = capacity
        bins.append(b)
        offsets.append(capacity - free[b])
        free[b] -= length
        tick += 1
        seen[b] = tick
        if not free[b]:
            del free[b]
    return bins, offsets, closed


def test_as_naive_bounded_best_fit():
    rng = np.random.default_rng(4)
    for open_bins in (1, 2, 7, 40, 1000):
        lengths = rng.integers(1, 101, 1500).tolist()
        bins, offsets, closed = naive(lengths, 100, open_bins)
        assert packing.best_fit(lengths, 100, open_bins) == (bins, offsets)
        assert closed > 0 or open_bins == 1000


def test_the_bound_of_open_bins_is_reached():
    """With the parameters of the query bins do close, and little is lost by it."""
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 1024, 20_000)
    order = packing.in_windows(lengths, packing.AHEAD)
    assert sorted(order.tolist()) == list(range(len(lengths))) and (order // packing.AHEAD == np.arange(len(lengths)) // packing.AHEAD).all()
    bins, _, closed = naive(lengths[order].tolist(), 1024, packing.OPEN_BINS)
    assert closed > 1000
    assert packing.best_fit(lengths[order].tolist(), 1024, packing.OPEN_BINS)[0] == bins
    assert len(set(bins)) <= 1.01 * -(-int(lengths.sum()) // 1024) + 1


def test_copies_of_a_row_are_dealt_out(spark):
    """Packers get rows by their place: thousands of equal rows don't meet in one."""
    rows = spark.range(0, 6000, 1, 6).selectExpr("7L as doc_id", "0 as piece", "0L as start", "400L as length", "1L as ids_crc32")
    found = packing.pack(rows, packer=500).collect()
    per = defaultdict(int)
    for r in found:
        per[r.sequence_id % 12] += 1
    assert len(found) == 6000 and len(per) == 12 and max(per.values()) < 700
