"""Byte-level BPE encoding and decoding with a rank queue over a hierarchical bitmap.

One pre-token is a linked list of byte positions. For each merge rank a bucket holds the positions whose pair has that
rank; a two-level bitmap marks the non-empty buckets, and find-first-set gives the next rank. Entries that a merge has
made stale are skipped when popped. A pre-token of n bytes takes O(n log n) at most, so one of megabytes is no trouble.

Null text: empty. Empty text: no ids. Very long texts and pre-tokens: whole. Repeated rows: a row each, alike. Empty
table: no rows. Further columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Callable
from heapq import heappop, heappush
from itertools import chain
from operator import add
from typing import Any

from pyspark.sql import DataFrame

from tierfold.llm.common import keeps, map_rows, text_rows

#: Bits of one word of the bitmap; 256 words cover 65,536 ranks.
WIDTH = 256
#: Ids moved up by 17 bits, so that a pair is one number.
SHIFTED = [k << 17 for k in range(1 << 17)]
#: Pre-tokens that one generation of the cache holds, and their characters; two generations live at once. Longer ones than LONG aren't kept.
CACHE, CACHE_CHARS, LONG = 700_000, 12_000_000, 256


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Buckets of positions by rank. ``push`` and ``pop`` touch one word and its summary bit."""

    def __init__(self, n_ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(n_ranks)]
        self.words = [0] * (n_ranks // WIDTH + 1)
        self.summary = 0

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            w = rank // WIDTH
            self.words[w] |= 1 << rank % WIDTH
            self.summary |= 1 << w
        heappush(bucket, at)

    def pop(self) -> tuple[int, int]:
        """The least rank, and its leftmost position; the queue must not be empty."""
        w = (self.summary & -self.summary).bit_length() - 1
        bits = self.words[w]
        low = bits & -bits
        rank = w * WIDTH + low.bit_length() - 1
        bucket = self.buckets[rank]
        at = heappop(bucket)
        if not bucket:
            self.words[w] = bits ^ low
            if bits == low:
                self.summary ^= 1 << w
        return rank, at


class Known(dict):
    """What a function gives for a key, kept for the keys of late: two generations of at most ``size`` keys and ``chars`` characters; a value has no more parts than its key has bytes."""

    def __init__(self, make: Callable[[str], Any], size: int, chars: int = CACHE_CHARS):
        super().__init__()
        self.make, self.size, self.chars, self.held, self.old = make, size, chars, 0, {}

    def __missing__(self, key: str):
        if len(key) > LONG:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size or self.held >= self.chars:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[key] = value
        self.held += len(key)
        return value


def rarely_collect() -> None:
    """Large caches needn't be looked through for garbage again and again; nothing in them is cyclic."""
    gc.freeze()
    gc.set_threshold(100_000, 50, 100)


class Encoder:
    """Pre-tokens to ids by ``ranks``; ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        if max(ranks.values(), default=0) >= len(SHIFTED) or WIDTH != 256:
            raise ValueError("ranks of up to 17 bits")
        self.bits_of = [1 << k for k in range(max(WIDTH, len(self.queue.words)))]
        self.id_of_byte = [ranks[bytes([b])] for b in range(256)]
        # Every way to split a token into two gives a pair that has the token's rank.
        self.rank_of_pair = {ranks[t[:k]] << 17 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.text_of = {r: str(r) for r in self.bytes_of}
        self.known = Known(lambda piece: self.merge(piece.encode()), cache)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token. RankQueue's push and pop stand here in line, as they are most of the work."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        ids = [*map(self.id_of_byte.__getitem__, piece)]
        rank_of = self.rank_of_pair.get
        queue = self.queue
        buckets, words, summary, bits_of = queue.buckets, queue.words, 0, self.bits_of
        # pair: the rank of a position and its successor, or None; it tells whether an entry is stale.
        pair = [*map(rank_of, map(add, map(SHIFTED.__getitem__, ids), ids[1:])), None]
        for i, r in enumerate(pair):
            if r is not None:
                bucket = buckets[r]
                if not bucket:
                    w = r >> 8
                    words[w] |= bits_of[r & 255]
                    summary |= bits_of[w]
                bucket.append(i)  # positions ascend, so the bucket is a heap
        nxt, prv = [*range(1, n + 1)], [*range(-1, n - 1)]
        while summary:
            w = (summary & -summary).bit_length() - 1
            bits = words[w]
            low = bits & -bits
            r = (w << 8) + low.bit_length() - 1
            bucket = buckets[r]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket.pop()
                words[w] = bits ^ low
                if bits == low:
                    summary ^= bits_of[w]
            if pair[i] != r:
                continue
            j = nxt[i]
            k = nxt[i] = nxt[j]
            ids[i], ids[j], pair[j] = r, -1, None
            if k < n:
                prv[k] = i
                s = pair[i] = rank_of(r << 17 | ids[k])
                if s is not None:
                    bucket = buckets[s]
                    if not bucket:
                        w = s >> 8
                        words[w] |= bits_of[s & 255]
                        summary |= bits_of[w]
                    heappush(bucket, i)
            else:
                pair[i] = None
            h = prv[i]
            if h >= 0:
                s = pair[h] = rank_of(ids[h] << 17 | r)
                if s is not None:
                    bucket = buckets[s]
                    if not bucket:
                        w = s >> 8
                        words[w] |= bits_of[s & 255]
                        summary |= bits_of[w]
                    heappush(bucket, h)
        return tuple([x for x in ids if x >= 0])

    def encode(self, text: str) -> list[int]:
        return [*chain.from_iterable(map(self.known.__getitem__, self.split(text)))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_made: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary: str, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary; a worker that is used again keeps its cache."""
    key = (vocabulary, pattern)
    if key not in _made:
        _made[key] = Encoder(load_ranks(vocabulary), pattern)
        rarely_collect()
        keeps(__name__, _made.clear)
    return _made[key]


def encode_column(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>), one row per document; a map without shuffle."""

    def make():
        enc = encoder(vocabulary, pattern)
        return lambda rows: {"doc_id": rows["doc_id"], "ids": [enc.encode(t) for t in rows["text"]]}

    return map_rows(text_rows(df, id_col, text_col), "doc_id long, ids array<int>", make)


def decode_column(df: DataFrame, vocabulary: str, pattern: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, bytes binary) of arrays of ids; null ids give null."""

    def make():
        enc = encoder(vocabulary, pattern)
        return lambda rows: {"doc_id": rows["doc_id"], "bytes": [None if x is None else enc.decode(x) for x in rows["ids"]]}

    return map_rows(df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].alias("ids")), "doc_id long, bytes binary", make)


def round_trip(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each document's ids and of the bytes decoded from them."""

    def make():
        enc = encoder(vocabulary, pattern)
        sha = hashlib.sha256

        def f(rows):
            ids = [enc.encode(t) for t in rows["text"]]
            return {
                "doc_id": rows["doc_id"],
                "n_tokens": [len(x) for x in ids],
                "ids_sha256": [sha(",".join(map(enc.text_of.__getitem__, x)).encode()).hexdigest() for x in ids],
                "decoded_sha256": [sha(enc.decode(x)).hexdigest() for x in ids],
            }

        return f

    return map_rows(text_rows(df, id_col, text_col), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
