"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are the majority of the XXH64 (seed 42) of all word shingles. To find those within ``radius``
bits, correlated bits are grouped into m partitions; thresholds t_i >= -1 with sum(t_i) = radius - m + 1 are allotted
to each fingerprint by dynamic programming on estimated candidate counts (from histograms of all fingerprints); it then
probes each partition for values within t_i. If two fingerprints differ in at most ``radius`` bits, one of the probes
must meet; every meeting is verified on all 64 bits.

Exact copies share a fingerprint and count once from the start. A partition value shared by more than ``BUCKET``
fingerprints isn't joined with itself: its fingerprints are linked through midpoints instead (values at most half the
radius away from both), which is exact, linear in their number, and leaves groups of at most 65. Components come from
star contractions over checkpointed tables; nothing of the size of the corpus reaches the driver.

Null text: empty. No words: fingerprint zero, linked like any other. Very long texts: whole. Fewer words than a
shingle: the whole sequence is one. Repeated rows: a row each. A null doc_id: a row whose component is that of its
fingerprint, or null if no other row has it. Empty table: no rows. Further columns are ignored, or kept by ``keep_one``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierfold.llm.common import cut, map_rows, text_rows
from tierfold.llm.components import components

SEED = 42
RADIUS = 2
#: Fingerprints of one partition value that are joined with each other.
BUCKET = 256
#: Above so many fingerprints two long partitions serve better than three.
MANY = 32 << 21


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of all shingles of a text, repeats included. bytes.lower() and bytes.split() know ASCII alone."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[s:e], SEED) for s, e in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint as a signed 64-bit number; bit k is 1 if set in over half of the hashes."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        votes += np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long); a map without shuffle."""

    def make():
        return lambda rows: {"doc_id": rows["doc_id"], "fp": [majority(shingle_hashes(t, shingle)) for t in rows["text"]]}

    return map_rows(text_rows(df, id_col, text_col, binary=True), "doc_id long, fp long", make)


def bits_of(fps: np.ndarray) -> np.ndarray:
    """n x 64 zeros and ones, bit 0 first."""
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def co_occurrence(nodes: DataFrame) -> np.ndarray:
    """64 x 64 numbers of fingerprints with both bits set, over all of them; each task sends one small matrix."""

    def run(batches):
        total = np.zeros((64, 64))
        for b in batches:
            x = bits_of(b.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            total += x.T @ x
        i, j = np.triu_indices(64)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "n"])

    out = np.zeros((64, 64))
    for i, j, n in nodes.select("fp").mapInArrow(run, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n")).collect():  # 2,080 rows
        out[i, j] = out[j, i] = n
    return out


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m partitions of about 64 / m bits each; correlated bits come together, so that the rest differ among partitions."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, parts = list(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        part = [left.pop(int(np.argmax(corr[np.ix_(left, left)].max(axis=1))))]
        while len(part) < size:
            part.append(left.pop(int(np.argmax(corr[np.ix_(left, part)].sum(axis=1)))))
        parts.append(sorted(part))
    return parts


def sub_parts(parts: list[list[int]]) -> list[list[list[int]]]:
    """Each partition in runs of at most 8 bits, whose histograms are small."""
    return [[p[k : k + 8] for k in range(0, len(p), 8)] for p in parts]


def value_of(bits: np.ndarray, part: list[int]) -> np.ndarray:
    return bits[:, part].astype(np.int64) @ (1 << np.arange(len(part), dtype=np.int64))


def histograms(nodes: DataFrame, subs: list[list[list[int]]]) -> list[list[np.ndarray]]:
    """For each run of bits and each of its values, the share of all fingerprints at distance 0, 1, ... from it."""
    flat = [(i, j, s) for i, x in enumerate(subs) for j, s in enumerate(x)]

    def run(batches):
        counts = [np.zeros(1 << len(s), np.int64) for _, _, s in flat]
        for b in batches:
            bits = bits_of(b.column(0).to_numpy(zero_copy_only=False))
            for c, (_, _, s) in zip(counts, flat, strict=True):
                c += np.bincount(value_of(bits, s), minlength=len(c))
        at = np.repeat(np.arange(len(flat)), [len(c) for c in counts])
        v = np.concatenate([np.arange(len(c)) for c in counts])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(v, pa.int32()), pa.array(np.concatenate(counts))], ["at", "v", "n"])

    counts = [np.zeros(1 << len(s)) for _, _, s in flat]
    for at, v, n in nodes.select("fp").mapInArrow(run, "at int, v int, n long").groupBy("at", "v").agg(F.sum("n")).collect():  # at most 256 for each 8 bits
        counts[at][v] = n
    out: list[list[np.ndarray]] = [[] for _ in subs]
    for (i, _, s), c in zip(flat, counts, strict=True):
        v = np.arange(1 << len(s))
        distance = np.bitwise_count(v[:, None] ^ v[None, :]).astype(np.int64)
        out[i].append(np.stack([((distance == d) * c).sum(axis=1) for d in range(len(s) + 1)], axis=1) / max(1.0, c.sum()))
    return out


def allot(bits: np.ndarray, subs: list[list[list[int]]], shares: list[list[np.ndarray]], n: int, radius: int) -> np.ndarray:
    """Thresholds (rows x partitions) of least estimated cost with sum(t + 1) = radius + 1, by dynamic programming."""
    m, rows = len(subs), len(bits)
    cost = np.zeros((m, radius + 2, rows))
    for i in range(m):
        near = np.zeros((rows, radius + 1))
        near[:, 0] = 1
        for s, share in zip(subs[i], shares[i], strict=True):
            mine = share[value_of(bits, s)]
            near = np.stack([sum(near[:, d - k] * mine[:, k] for k in range(min(d, mine.shape[1] - 1) + 1)) for d in range(radius + 1)], axis=1)
        width = sum(map(len, subs[i]))
        probes = 0.0
        for t in range(radius + 1):
            probes += float(np.prod([(width - k) / (k + 1) for k in range(t)]))
            cost[i, t + 1] = n * near[:, : t + 1].sum(axis=1) + probes
    best = np.full((radius + 2, rows), np.inf)
    best[0] = 0
    picks = []
    for i in range(m):
        options = np.full((radius + 2, radius + 2, rows), np.inf)  # sum, own share
        for s in range(radius + 2):
            for x in range(s + 1):
                options[s, x] = best[s - x] + cost[i, x]
        picks.append(options.argmin(axis=1))
        best = options.min(axis=1)
    at = np.full(rows, radius + 1)
    out = np.zeros((rows, m), np.int64)
    for i in reversed(range(m)):
        x = picks[i][at, np.arange(rows)]
        out[:, i] = x - 1
        at = at - x
    return out


def flips(width: int, t: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(width), k)], np.int64)


def keyed(nodes: DataFrame, radius: int, m: int, n: int) -> DataFrame:
    """(part, value, fp, node, held, asks): a row for each value under which a fingerprint is held, or asks."""
    parts = group_bits(co_occurrence(nodes), n, m)
    subs = sub_parts(parts)
    shares = histograms(nodes, subs)
    near = [[flips(len(p), t) for t in range(radius + 1)] for p in parts]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                fp, node = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                bits = bits_of(fp)
                thresholds = allot(bits, subs, shares, n, radius)
                for i, p in enumerate(parts):
                    value = value_of(bits, p)
                    for t in range(-1, radius + 1):
                        rows = np.flatnonzero(thresholds[:, i] == t)
                        if not len(rows):
                            continue
                        masks = near[i][t] if t >= 0 else np.zeros(1, np.int64)
                        k = len(masks)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(rows) * k, i, np.int32)),
                                pa.array((value[rows][:, None] ^ masks).ravel()),
                                pa.array(np.repeat(fp[rows], k)),
                                pa.array(np.repeat(node[rows], k)),
                                pa.array(np.tile(masks == 0, len(rows))),
                                pa.array(np.full(len(rows) * k, t >= 0)),
                            ],
                            ["part", "value", "fp", "node", "held", "asks"],
                        )

    return nodes.select("fp", "node").mapInArrow(run, "part int, value long, fp long, node long, held boolean, asks boolean")


def _midpoints(hot: DataFrame) -> DataFrame:
    """Edges among fingerprints at most two bits apart: both are at most one bit from a shared value, and all who are so are linked to the least of them."""
    near = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    spread = hot.select("node", F.explode(near).alias("flip"), "fp").select(F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"), "node")
    groups = spread.groupBy("mid").agg(F.collect_list("node").alias("nodes")).where(F.size("nodes") > 1)  # at most 65: one for each flip
    return groups.select(F.array_min("nodes").alias("u"), F.explode("nodes").alias("v")).where("u <> v").distinct()


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) edges whose components are those of all pairs of (node, fp) rows within two bits."""
    if radius != 2:
        raise ValueError("links through midpoints are those of two bits")
    n = nodes.count()
    if n < 2:
        return nodes.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
    rows = cut(keyed(nodes, radius, 3 if n < MANY else 2, n))
    sizes = rows.groupBy("part", "value").agg(F.count_if("held").alias("n_held"), F.count_if("asks").alias("n_asks"), (F.min("fp") != F.max("fp")).alias("several")).where("n_held > 0 and n_asks > 0 and several").drop("several")
    sized = rows.join(sizes, ["part", "value"])
    cold = sized.where(F.col("n_held") + F.col("n_asks") <= 2 * BUCKET)
    a, b = cold.where("held").alias("a"), cold.where("asks").alias("b")
    met = (F.col("a.part") == F.col("b.part")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.fp") != F.col("b.fp"))
    pairs = a.join(b, met & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    hot = sized.where(F.col("n_held") + F.col("n_asks") > 2 * BUCKET).select("node", "fp").distinct()
    return pairs.union(_midpoints(hot))


def near_duplicates(df: DataFrame, shingle: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    found = cut(fingerprints(df, shingle, id_col, text_col))
    nodes = cut(found.groupBy("fp").agg(F.min("doc_id").alias("node")))
    edges = links(nodes.where("node is not null"), radius)
    labels = components(edges)
    named = nodes.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return found.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
