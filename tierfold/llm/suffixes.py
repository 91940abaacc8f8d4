"""Suffix-array removal of repeated passages by a common-prefix-aware distributed merge sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Sorting all
suffixes would move each byte some fifty times, so the sort is made sparse without losing a match: of the 35 hashed
16-byte grams in a 50-byte window the least is its anchor, which depends on the window's content alone; equal windows
have equal anchors at equal places. Only suffixes at anchors whose gram occurs in two documents are sorted.

1. Documents are dealt to runs of some megabytes by a hash of the id (the text's only shuffle; later steps reuse it).
   Each run sends the sorted, delta-coded hashes of its anchors to buckets; each bucket tells the runs which repeat.
2. Each run sorts the suffixes at those anchors (50 bytes to the right, then 34 to the left, reversed), keeps equal ones
   once with their least id, front-codes them, and sends them to buckets.
3. A bucket merges its sorted runs with a loser tree that carries common-prefix lengths with the last winner, so that
   known prefixes aren't compared again. The prefix lengths of the merged order, and of the left contexts' order, give
   exact classes of equal windows at each of the 35 offsets, and each class its least id.
4. The buckets send each run its suffixes' least ids by offset; the run marks the covered bytes.

A passage in a third of all documents is one suffix in each run, so no bucket gets more than one row of it per run.

Null text: empty. Texts under ``LENGTH`` bytes: kept whole. Very long texts: scanned in overlapping parts. Rows that
share a doc_id are one document to each other and never lose bytes to each other. A null doc_id takes no part: kept
whole. Repeated rows: a row each. Empty table: no rows. Further columns are ignored, or kept by ``remove``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tierfold.llm.common import give_back, quoted, schema_of

LENGTH = 50
GRAM = 16
OFFSETS = LENGTH - GRAM + 1
LEFT = OFFSETS - 1
#: Right context, reversed left context, and the lengths of both.
KEY = LENGTH + LEFT + 2
WORDS = -(-KEY // 8)
RUN_BYTES = 6 << 20
PART = 1 << 18
AHEAD = 64
NO_ID = np.iinfo(np.int64).max

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _C3
    h ^= h >> np.uint64(29)
    h *= _C1
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of the 16 bytes from each place."""
    n = len(data) - 7
    w = np.empty(n, np.uint64)
    for s in range(min(8, n)):
        w[s::8] = np.frombuffer(data, "<u8", (n - s + 7) // 8, s)
    h = w[:-8] * _C1
    h ^= h >> np.uint64(31)
    h += w[8:]
    h *= _C2
    h ^= h >> np.uint64(33)
    h *= _C3
    h ^= h >> np.uint64(32)
    return h


def slide(op, a: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        a = op(a[:-span], a[span:])
        span *= 2
    return op(a[: len(a) - (width - span)], a[width - span :]) if span < width else a


def _anchors_of(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors in documents laid end to end."""
    h = gram_hashes(data)
    n = len(h)
    bad = (ends[:, None] - np.arange(1, GRAM)).ravel()
    h[bad[(bad >= 0) & (bad < n)]] = np.uint64(2**64 - 1)
    least = slide(np.minimum, h, OFFSETS)
    bad = (ends[:, None] - np.arange(1, LENGTH)).ravel()
    least[bad[(bad >= 0) & (bad < len(least))]] = 0
    pad = np.zeros(OFFSETS - 1, np.uint64)
    most = slide(np.maximum, np.concatenate([pad, least, pad]), OFFSETS)
    at = np.flatnonzero(most[:n] == h)
    return at, h[at]


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document's index, place, id of the gram) of all anchors; parts of at most about PART bytes at a time."""
    docs, places, hashes = [], [], []
    batch: list[tuple[int, int, int, int, bytes]] = []  # index, place of the part, first and end of what counts, bytes
    size = 0

    def flush() -> None:
        nonlocal size
        if batch:
            data = b"".join(x[4] for x in batch)
            ends = np.cumsum([len(x[4]) for x in batch])
            at, h = _anchors_of(data, ends)
            k = np.searchsorted(ends, at, "right")
            starts = ends - np.array([len(x[4]) for x in batch])
            place = at - starts[k] + np.array([x[1] for x in batch])[k]
            ok = (place >= np.array([x[2] for x in batch])[k]) & (place < np.array([x[3] for x in batch])[k])
            docs.append(np.array([x[0] for x in batch])[k][ok])
            places.append(place[ok])
            hashes.append(h[ok])
            batch.clear()
        size = 0

    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        for s in range(0, len(t), PART):
            a = max(0, s - 2 * LENGTH)
            part = t[a : s + PART + 2 * LENGTH]
            if len(part) < LENGTH:
                continue
            batch.append((i, a, s, s + PART, part))
            size += len(part)
            if size >= PART:
                flush()
    flush()
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(places), mixed(np.concatenate(hashes))


def coded(ids: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, byte by byte, so that the leading zeros lie together."""
    return np.diff(ids, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def decoded(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return ((ids >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def by_bucket(ids: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of sorted ids."""
    b = bucket_of(ids, buckets)
    edges = np.flatnonzero(np.diff(b)) + 1
    first = np.concatenate([[0], edges]) if len(b) else np.zeros(0, np.int64)
    return [(int(b[s]), int(s), int(e)) for s, e in zip(first, np.concatenate([first[1:], [len(b)]]), strict=True)] if len(b) else []


def _texts(t: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """Texts and ids in an order that any repeat of the step has again; texts without id are left out as empty."""
    ids = np.array([NO_ID if x is None else x for x in t["id"].to_pylist()], np.int64)
    return [b"" if i == NO_ID else x for i, x in zip(ids.tolist(), t["text"].to_pylist(), strict=True)], ids


def send_hashes(t: pa.Table, buckets: int) -> list[dict]:
    """Step 1, run: distinct anchor ids, and whether several documents of the run have them."""
    texts, ids = _texts(t)
    doc, _, h = anchors(texts)
    order = np.lexsort((ids[doc], h))
    h, d = h[order], ids[doc][order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    other = np.zeros(len(h), bool)
    other[1:] = ~new[1:] & (d[1:] != d[:-1])
    group = np.cumsum(new) - 1
    several = np.bincount(group[other], minlength=int(new.sum())) > 0 if len(h) else np.zeros(0, bool)
    h, run = h[new], t["run"][0].as_py() if t.num_rows else 0
    return [{"bucket": b, "run": run, "ids": coded(h[s:e]), "several": np.packbits(several[s:e]).tobytes()} for b, s, e in by_bucket(h, buckets)]


def find_repeats(t: pa.Table) -> list[dict]:
    """Step 1, bucket: for each run, its ids that occur in two documents."""
    runs = t["run"].to_pylist()
    lists = [decoded(x) for x in t["ids"].to_pylist()]
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(y)) for x, y in zip(t["several"].to_pylist(), lists, strict=True)]).astype(bool)
    ids = np.concatenate(lists)
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(len(s), bool)
    hit[1:] |= same
    hit[:-1] |= same
    keep = several.copy()
    keep[order[hit]] = True
    out, at = [], 0
    for run, x in zip(runs, lists, strict=True):
        mine = x[keep[at : at + len(x)]]
        at += len(x)
        if len(mine):
            out.append({"run": run, "ids": coded(mine)})
    return out


class Suffixes:
    """Step 2 and 4: the distinct suffixes of a run at anchors with the given ids, in order of (bucket, key)."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, repeated: np.ndarray, buckets: int):
        doc, place, h = anchors(texts)
        if len(repeated) and len(h):
            k = np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)
            on = repeated[k] == h
        else:
            on = np.zeros(len(h), bool)
        self.doc, self.place, h = doc[on], place[on], h[on]
        lengths = np.array([len(x) for x in texts], np.int64)
        gap = bytes(LENGTH + LEFT)
        self.buffer = np.frombuffer(gap + b"".join(x for t in texts for x in (t, gap)), np.uint8)
        self.start = len(gap) + np.concatenate([[0], np.cumsum(lengths + len(gap))])[:-1].astype(np.int64)
        self.lengths = lengths
        n = len(self.doc)
        keys = np.zeros((n, KEY), np.uint8)
        if n:
            views = np.lib.stride_tricks.sliding_window_view(self.buffer, LEFT + LENGTH)
            around = views[self.start[self.doc] + self.place - LEFT]
            keys[:, :LENGTH] = around[:, LEFT:]
            keys[:, LENGTH : LENGTH + LEFT] = around[:, LEFT - 1 :: -1]
            keys[:, -2] = np.minimum(LEFT, self.place)
            keys[:, -1] = np.minimum(LENGTH, lengths[self.doc] - self.place)  # at least GRAM, so that no key ends in a zero
        flat = keys.view(f"S{KEY}").ravel()
        order = np.lexsort((flat, bucket_of(h, buckets))) if n else np.zeros(0, np.int64)
        keys, h = keys[order], h[order]
        new = np.ones(n, bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        entry = np.zeros(n, np.int64)
        entry[order] = np.cumsum(new) - 1
        self.entry, self.keys = entry, keys[new]
        self.bucket = bucket_of(h[new], buckets)
        m = len(self.keys)
        self.least, most = np.full(m, NO_ID), np.full(m, -NO_ID)
        np.minimum.at(self.least, entry, ids[self.doc])
        np.maximum.at(most, entry, ids[self.doc])
        self.several = most > self.least

    def edges(self) -> list[tuple[int, int, int]]:
        cuts = np.flatnonzero(np.diff(self.bucket)) + 1 if len(self.bucket) else np.zeros(0, np.int64)
        first = [0, *cuts.tolist()] if len(self.bucket) else []
        return [(int(self.bucket[s]), s, e) for s, e in zip(first, [*first[1:], len(self.bucket)], strict=True)]


def front_code(keys: np.ndarray) -> tuple[bytes, bytes]:
    """(common prefix with the row before, remaining bytes packed) of sorted keys."""
    lcp = np.zeros(len(keys), np.uint8)
    lcp[1:] = (keys[1:] != keys[:-1]).argmax(axis=1)
    return lcp.tobytes(), zstandard.compress(keys[np.arange(KEY) >= lcp[:, None]].tobytes(), 3)


def front_decode(lcp: np.ndarray, tail: bytes) -> np.ndarray:
    own = np.arange(KEY) >= lcp[:, None]
    row = np.maximum.accumulate(np.where(own, np.arange(len(lcp), dtype=np.int32)[:, None], 0), axis=0)
    filled = np.zeros(own.shape, np.uint8)
    filled[own] = np.frombuffer(zstandard.decompress(tail), np.uint8)
    return np.take_along_axis(filled, row, axis=0)


def merge(keys: list[np.ndarray], lcps: list[list[int]]) -> list[tuple[int, int]]:
    """(run, row) in order of key, by a loser tree. keys: rows x words; lcps: words in common with the row before.

    Each node keeps the loser of its match with the number of words that it shares with the last winner. The one that
    shares more is the smaller; only if both share as many are their words compared, from there on.
    """
    k = 1
    while k < len(keys):
        k *= 2
    n_rows = [len(x) for x in keys] + [0] * (k - len(keys))
    # A few rows of each run at a time are Python numbers.
    near = [x[:AHEAD].tolist() for x in keys] + [[]] * (k - len(keys))
    head: list[list[int] | None] = [x[0] if x else None for x in near]
    share = [0] * k
    at = [0] * k
    tree = [0] * k

    def match(a: int, b: int) -> tuple[int, int]:
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if share[a] != share[b]:
            return (a, b) if share[a] > share[b] else (b, a)
        h = share[a]
        while h < WORDS and x[h] == y[h]:
            h += 1
        if h == WORDS or x[h] < y[h]:
            share[b] = h
            return a, b
        share[a] = h
        return b, a

    winners = list(range(k))
    width = k
    level: list[int] = winners
    while width > 1:
        up = []
        for j in range(0, width, 2):
            w, lost = match(level[j], level[j + 1])
            tree[(width + j) // 2] = lost
            up.append(w)
        level, width = up, width // 2
    w = level[0]
    out: list[tuple[int, int]] = []
    total = sum(n_rows)
    for _ in range(total):
        i = at[w]
        out.append((w, i))
        i += 1
        at[w] = i
        if i < n_rows[w]:
            if not i % AHEAD:
                near[w] = keys[w][i : i + AHEAD].tolist()
            head[w] = near[w][i % AHEAD]
            share[w] = lcps[w][i]
        else:
            head[w] = None
        x, s, node = head[w], share[w], (k + w) // 2
        while node:
            r = tree[node]
            y = head[r]
            if y is not None:
                t = share[r]
                if x is None or t > s:
                    share[w] = s
                    tree[node], w, x, s = w, r, y, t
                elif t == s:
                    h = s
                    while h < WORDS and x[h] == y[h]:
                        h += 1
                    if h == WORDS or x[h] < y[h]:
                        share[r] = h
                    else:
                        share[w] = h
                        tree[node], w, x = w, r, y
            node //= 2
        share[w] = s
    return out


def prefix_classes(rows: np.ndarray, depths: range) -> np.ndarray:
    """(depth, row): numbers of the classes of sorted rows that share so many bytes."""
    differ = rows[1:] != rows[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    out = np.zeros((len(depths), len(rows)), np.int64)
    for k, d in enumerate(depths):
        out[k, 1:] = np.cumsum(lcp < d)
    return out


def least_by_offset(keys: np.ndarray, least: np.ndarray) -> np.ndarray:
    """(row, offset): the least id among sorted, distinct keys with the same window at the offset; NO_ID outside the document."""
    left_n, right_n = keys[:, -2].astype(np.int64), keys[:, -1].astype(np.int64)
    o = np.arange(OFFSETS)
    inside = (o <= left_n[:, None]) & (LENGTH - o <= right_n[:, None])
    out = np.where(inside, least[:, None], NO_ID)
    grams = prefix_classes(keys[:, :LENGTH], range(GRAM, GRAM + 1))[0]
    many = np.flatnonzero(np.bincount(grams)[grams] > 1)
    if not len(many):
        return out
    keys, ok, mine = keys[many], inside[many], least[many]
    right = prefix_classes(keys[:, :LENGTH], range(GRAM, LENGTH + 1))
    lefts = np.ascontiguousarray(keys[:, LENGTH : LENGTH + LEFT])
    order = np.argsort(lefts.view(f"S{LEFT}").ravel(), kind="stable")
    left = np.zeros((OFFSETS, len(many)), np.int64)
    left[:, order] = prefix_classes(lefts[order], range(OFFSETS))
    for k in range(OFFSETS):
        rows = np.flatnonzero(ok[:, k])
        if not len(rows):
            continue
        window = right[LENGTH - k - GRAM, rows] * (len(many) + 1) + left[k, rows]
        by = np.argsort(window, kind="stable")
        w = window[by]
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        lowest = np.minimum.reduceat(mine[rows][by], first)
        found = np.empty(len(rows), np.int64)
        found[by] = np.repeat(lowest, np.diff(np.concatenate([first, [len(rows)]])))
        out[many[rows], k] = found
    return out


def send_suffixes(docs: pa.Table, repeats: pa.Table, buckets: int) -> list[dict]:
    """Step 2, run: sorted, front-coded suffixes."""
    if not docs.num_rows or not repeats.num_rows:
        return []
    texts, ids = _texts(docs)
    s = Suffixes(texts, ids, np.sort(np.concatenate([decoded(x) for x in repeats["ids"].to_pylist()])), buckets)
    run, out = docs["run"][0].as_py(), []
    for b, i, e in s.edges():
        lcp, tail = front_code(s.keys[i:e])
        out.append({"bucket": b, "run": run, "lcp": lcp, "tail": tail, "least": s.least[i:e].astype("<i8").tobytes(), "several": np.packbits(s.several[i:e]).tobytes()})
    return out


def resolve(t: pa.Table) -> list[dict]:
    """Step 3, bucket: merge the runs; give each run the ids of its grams, and (row, first and last offset, least id) where some document of it may lose bytes."""
    lcps = [np.frombuffer(x, np.uint8) for x in t["lcp"].to_pylist()]
    mats = [front_decode(a, x) for a, x in zip(lcps, t["tail"].to_pylist(), strict=True)]
    least = [np.frombuffer(x, "<i8") for x in t["least"].to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(a)).astype(bool) for x, a in zip(t["several"].to_pylist(), lcps, strict=True)]
    words = []
    for m in mats:
        wide = np.zeros((len(m), WORDS * 8), np.uint8)
        wide[:, :KEY] = m
        words.append(wide.view(">u8"))
    order = np.array(merge(words, [(a // 8).tolist() for a in lcps]), np.int64)
    del words
    base = np.concatenate([[0], np.cumsum([len(m) for m in mats])])[:-1]
    flat = base[order[:, 0]] + order[:, 1]
    keys = np.concatenate(mats)[flat]
    ids = np.concatenate(least)[flat]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    by_class = least_by_offset(keys[first], np.minimum.reduceat(ids, first))
    cls = np.empty(len(keys), np.int64)
    cls[flat] = np.cumsum(new) - 1
    out = []
    for j, run in enumerate(t["run"].to_pylist()):
        table = by_class[cls[base[j] : base[j] + len(mats[j])]]
        useful = (table != NO_ID) & ((table < least[j][:, None]) | several[j][:, None])
        change = np.ones(table.shape, bool)
        change[:, 1:] = (table[:, 1:] != table[:, :-1]) | (useful[:, 1:] != useful[:, :-1])
        row, o = np.nonzero(change)
        last = np.where(np.append(row[1:] != row[:-1], True), OFFSETS - 1, np.append(o[1:], 0) - 1)
        on = useful[row, o]
        row, o, last = row[on], o[on], last[on]
        grams = np.unique(mixed(gram_hashes(mats[j].tobytes())[::KEY]))
        out.append({"run": run, "bucket": t["bucket"][0].as_py(), "ids": coded(grams), "row": row.astype("<i4").tobytes(), "first": o.astype(np.uint8).tobytes(), "last": last.astype(np.uint8).tobytes(), "least": table[row, o].astype("<i8").tobytes()})
    return out


def removed(docs: pa.Table, found: pa.Table, buckets: int) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
    """Step 4, run: each document's text, and the starts and ends of its maximal removed stretches."""
    whole = docs["text"].to_pylist()
    texts, ids = _texts(docs)
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not found.num_rows:
        return whole, [nothing] * len(whole)
    s = Suffixes(texts, ids, np.sort(np.concatenate([decoded(x) for x in found["ids"].to_pylist()])), buckets)
    first_of = {b: i for b, i, _ in s.edges()}
    row = np.concatenate([np.frombuffer(x, "<i4").astype(np.int64) + first_of[b] for x, b in zip(found["row"].to_pylist(), found["bucket"].to_pylist(), strict=True)])
    first, last = (np.concatenate([np.frombuffer(x, np.uint8) for x in found[c].to_pylist()]).astype(np.int64) for c in ("first", "last"))
    least = np.concatenate([np.frombuffer(x, "<i8") for x in found["least"].to_pylist()])
    by = np.argsort(row, kind="stable")
    row, first, last, least = row[by], first[by], last[by], least[by]
    lo, hi = np.searchsorted(row, s.entry, "left"), np.searchsorted(row, s.entry, "right")
    n = hi - lo
    who = np.repeat(np.arange(len(n)), n)
    which = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    on = ids[s.doc[who]] > least[which]
    who, which = who[on], which[on]
    place = s.start[s.doc[who]] + s.place[who]
    size = len(s.buffer) + 1
    depth = np.bincount(place - last[which], minlength=size)
    depth -= np.bincount(place - first[which] + LENGTH, minlength=size)
    gone = np.cumsum(depth, out=depth) > 0
    del depth, place, who, which
    turn = np.diff(gone.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    k = np.searchsorted(s.start, starts, "right") - 1
    cuts = np.searchsorted(k, np.arange(len(whole) + 1))
    return whole, [(starts[a:b] - s.start[i], ends[a:b] - s.start[i]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def kept_bytes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    if not len(starts):
        return text
    edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(text)]
    return b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))


def whole_characters(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches drawn in to characters that go whole."""
    inner = lambda at: (at < len(text)) & ((np.frombuffer(text + b"\0", np.uint8)[at] & 0xC0) == 0x80)
    for _ in range(3):
        starts = starts + inner(starts)
        ends = ends - inner(ends)
    on = starts < ends
    return starts[on], ends[on]


def _found(df: DataFrame, id_col: str, text_col: str, keep: list[str] | None):
    """The runs' documents, and what the buckets found for them."""
    text = F.coalesce(df[text_col].cast("string"), F.lit("")).cast("binary")
    n_bytes = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    n_runs = max(8, -(-n_bytes // RUN_BYTES))
    buckets = max(8, n_runs // 2)
    columns = [df[id_col].cast("long").alias("id"), text.alias("text")]
    if keep is not None:
        columns.append(F.struct(df[text_col].isNull().alias("none"), *[df[quoted(c)].alias(f"c{k}") for k, c in enumerate(keep)]).alias("row"))
    # Rows without id stay apart by their text.
    docs = df.select(*columns).withColumn("run", F.pmod(F.coalesce(F.xxhash64("id"), F.xxhash64("text")), F.lit(n_runs)).cast("int"))

    def arrow(ddl: str) -> tuple[str, pa.Schema]:
        return ddl, to_arrow_schema(schema_of(ddl))

    hashes, hashes_arrow = arrow("bucket int, run int, ids binary, several binary")
    repeats, repeats_arrow = arrow("run int, ids binary")
    suffixes, suffixes_arrow = arrow("bucket int, run int, lcp binary, tail binary, least binary, several binary")
    results, results_arrow = arrow("run int, bucket int, ids binary, row binary, first binary, last binary, least binary")
    def sent(rows: list[dict], schema: pa.Schema) -> pa.Table:
        out = pa.Table.from_pylist(rows, schema)
        give_back()
        return out

    a = docs.groupBy("run").applyInArrow(lambda t: sent(send_hashes(t, buckets), hashes_arrow), hashes)
    b = a.groupBy("bucket").applyInArrow(lambda t: sent(find_repeats(t), repeats_arrow), repeats)
    c = docs.groupBy("run").cogroup(b.groupBy("run")).applyInArrow(lambda x, y: sent(send_suffixes(x, y, buckets), suffixes_arrow), suffixes)
    d = c.groupBy("bucket").applyInArrow(lambda t: sent(resolve(t), results_arrow), results)
    return docs, d, buckets


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: bytes, removed bytes and stretches, the digest of what stays, and the stretches themselves."""
    docs, found, buckets = _found(df, id_col, text_col, None)
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
    arrow = to_arrow_schema(schema_of(ddl))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        texts, stretches = removed(x, y, buckets)
        return pa.Table.from_arrays(
            [
                x["id"].combine_chunks().cast(pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([int((e - s).sum()) for s, e in stretches], pa.int64()),
                pa.array([len(s) for s, _ in stretches], pa.int64()),
                pa.array([hashlib.sha256(kept_bytes(t, s, e)).hexdigest() for t, (s, e) in zip(texts, stretches, strict=True)], pa.string()),
                pa.array([s.tolist() for s, _ in stretches], arrow.field("starts").type),
                pa.array([e.tolist() for _, e in stretches], arrow.field("ends").type),
            ],
            schema=arrow,
        )

    return docs.groupBy("run").cogroup(found.groupBy("run")).applyInArrow(run, ddl)


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without the repeated passages; whole characters go, and a null text stays null."""
    keep = [c for c in df.columns if c != text_col]
    docs, found, buckets = _found(df, id_col, text_col, keep)
    schema = StructType([StructField("row", docs.schema["row"].dataType), StructField("text", schema_of("t string")["t"].dataType), StructField("removed", schema_of("t long")["t"].dataType)])
    arrow = to_arrow_schema(schema)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        texts, stretches = removed(x, y, buckets)
        left, gone = [], []
        for t, (s, e) in zip(texts, stretches, strict=True):
            s, e = whole_characters(t, s, e)
            left.append(kept_bytes(t, s, e).decode("utf-8", "replace"))
            gone.append(int((e - s).sum()))
        return pa.Table.from_arrays([x["row"].cast(arrow.field("row").type), pa.array(left, pa.string()), pa.array(gone, pa.int64())], schema=arrow)

    out = docs.groupBy("run").cogroup(found.groupBy("run")).applyInArrow(run, schema)
    text = F.when(~F.col("row.none"), F.col("text"))
    return out.select(*[(text if c == text_col else F.col(f"row.c{keep.index(c)}")).alias(c) for c in df.columns])
