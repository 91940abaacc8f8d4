"""Near copies by SimHash and the generalised pigeonhole principle, and by an exact prefix filter, verified on five-word shingles.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more; groups are the
components of all links, none of which is lost. Texts of equal word sequences are one node from the start. Shingles are
compared by 64-bit hashes.

1. Each node's fingerprint is the SimHash of its distinct words. Pairs within ``RADIUS`` bits are found by unequal
   thresholds on groups of correlated bits (see ``simhash``); values and probes travel packed, and a bucket sends a
   spanning forest of its verified pairs, not the pairs. The components are blocks, within which texts are linked. This joins most
   copies; what it joins needn't be met again.
2. The rest come from a prefix filter, which misses no pair: two sets of similarity 0.8 share one of the first
   n - ceil(0.8 n) + 1 shingles of each, in any order that is the same for all. Shingles that are common in a fixed share
   of the texts come last in it. Pairs of different labels that meet stay if they share as many first shingles as their
   sizes ask for, and if the parity bitmaps of their sets differ in no more bits than their sets may differ in
   shingles. A value that over ``CROWD`` nodes of different labels have joins them unverified. The components of all
   these are blocks again, within which texts are linked.

In a block it isn't needed to compare all pairs: the most central text is compared with all, then those outside the
largest component, until each text outside it has been compared with all. A block of over ``BLOCK`` texts is dealt to
tasks which share its most central texts; texts that don't reach the first of these are then compared with every part.

Null text: empty. Texts without words are copies of each other. Fewer words than a shingle: the whole sequence is one.
Very long texts: whole. Rows that share a doc_id are one document and stay or go together; of their texts that of the
least digest stands for it. A null doc_id stays. Ties: the smallest doc_id stays. Empty table: no rows. Further columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tierfold.llm import simhash
from tierfold.llm.common import cut, keeps, lean, map_rows, schema_of, text_rows
from tierfold.llm.components import components, stars
from tierfold.llm.suffixes import coded, decoded

SHINGLE, LEAST = 5, 0.8
RADIUS = 3
#: Above so many fingerprints two partitions serve better than three.
MANY = 50_000_000
#: A partition value held by more fingerprints than this puts them in one block unverified; the shingles decide.
HOT = 16384
#: One in so many texts is looked at for common shingles; those that so many of them have are common. They only settle an order: any gives the same groups.
SAMPLE, COMMON = 8, 3
#: Cells of the table of common shingles, which every task holds: a byte each.
CELLS = 1 << 24
#: First shingles that a task gets, about; one that more texts have puts them in one block unverified.
TOKENS, CROWD = 1 << 18, 256
#: Fingerprints of one group of partition values, and texts of one block, that a task gets, about.
GROUP, BLOCK, HUBS = 16384, 2048, 16
#: Bits of a parity bitmap.
PARITY = 1024
#: Ids of nodes are broadcast up to so many bytes.
BROADCAST = 32 << 20

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """XXH64 of words; forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if not self:
            keeps(__name__, self.clear)
        if len(self) > 100_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word, simhash.SEED)
        if len(word) < 64:
            self[word] = h
        return h


_words = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingle_set(w: np.ndarray) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles of a text, in order, from its words' hashes."""
    if not len(w):
        return w
    size = min(SHINGLE, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = (h ^ (h >> np.uint64(29))) * _C1 + w[k : len(w) - size + 1 + k]
    h ^= h >> np.uint64(32)
    h *= _C2
    h ^= h >> np.uint64(29)
    return np.unique(h)


def parity(shingles: np.ndarray) -> bytes:
    """Of each of PARITY classes of shingles whether their number is odd. Two bitmaps differ in no more bits than the sets in shingles."""
    return np.packbits(np.bincount((shingles >> np.uint64(7)).astype(np.int64) & (PARITY - 1), minlength=PARITY).astype(np.uint8) & 1).tobytes()


def digest(words: list[bytes]) -> tuple[int, int]:
    """Two 64-bit digests of a word sequence."""
    import xxhash

    d = xxhash.xxh3_128_intdigest(b" ".join(words))
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def words_of(text: bytes) -> list[bytes]:
    """bytes.lower() and bytes.split() know ASCII alone."""
    return text.lower().split()


def first_size(n: np.ndarray | int, least: float) -> np.ndarray:
    """The number of first shingles of a set of ``n`` of which any similar set shares one."""
    return np.where(np.asarray(n) > 0, n - np.ceil(least * np.asarray(n) - 1e-9) + 1, 0).astype(np.int64)


def cells_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(24)).astype(np.int64) & (CELLS - 1)


def common_cells(texts: DataFrame) -> np.ndarray:
    """For each cell of shingles how common the commonest of them is in a sample, as a power of two; 0 for most.

    Counts are exact for the sampled texts, by 40 bits of the hash: each batch sends its numbers sorted and
    delta-coded to ranges. What the driver gets is bounded by the table.
    """
    ddl = "bucket int, numbers binary"
    arrow = to_arrow_schema(schema_of(ddl))
    n_buckets = 64

    def send(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                found = [shingle_set(word_hashes(words_of(t))) >> np.uint64(24) for t in b.column("text").slice(at, 512).to_pylist()]
                numbers = np.sort(np.concatenate(found))
                edges = np.searchsorted(numbers, np.arange(n_buckets + 1, dtype=np.uint64) << np.uint64(34)).tolist()
                yield from pa.Table.from_pylist([{"bucket": k, "numbers": zstandard.compress(coded(numbers[s:e]), 1)} for k, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if e > s], arrow).to_batches()

    out_ddl = "cells binary, often binary"
    out_arrow = to_arrow_schema(schema_of(out_ddl))

    def meet(t: pa.Table) -> pa.Table:
        numbers, n = np.unique(np.concatenate([decoded(zstandard.decompress(x)) for x in t["numbers"].to_pylist()]), return_counts=True)
        on = n >= COMMON
        cell, often = numbers[on].astype(np.int64) & (CELLS - 1), np.log2(n[on] / COMMON).astype(np.uint8) + 1
        order = np.lexsort((often, cell))
        last = np.append(cell[order][1:] != cell[order][:-1], True) if on.any() else np.zeros(0, bool)
        return pa.Table.from_arrays([pa.array([cell[order][last].astype("<u4").tobytes()], pa.binary()), pa.array([often[order][last].tobytes()], pa.binary())], schema=out_arrow)

    table = np.zeros(CELLS, np.uint8)
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    for r in sample.mapInArrow(send, ddl).groupBy("bucket").applyInArrow(meet, out_ddl).collect():
        cell = np.frombuffer(r.cells, "<u4")
        table[cell] = np.maximum(table[cell], np.frombuffer(r.often, np.uint8))
    return table


def first_shingles(shingles: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set: rare ones, then by value."""
    return shingles[np.argsort(common[cells_of(shingles)], kind="stable")[: int(first_size(len(shingles), least))]]


def prints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k1, k2, fp, size, parity) of every row; a map."""

    def make():
        def f(rows):
            out = {"doc_id": rows["doc_id"], "k1": [], "k2": [], "fp": [], "size": [], "parity": []}
            for t in rows["text"]:
                words = words_of(t)
                w = word_hashes(words)
                shingles = shingle_set(w)
                for k, v in zip(("k1", "k2", "fp", "size", "parity"), (*digest(words), simhash.majority(np.unique(w)), len(shingles), parity(shingles)), strict=True):
                    out[k].append(v)
            return out

        return f

    return map_rows(text_rows(df, id_col, text_col, binary=True), "doc_id long, k1 long, k2 long, fp long, size int, parity binary", make)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for a broadcast if its rows, of so many bytes each, are few enough."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST else df


def with_texts(texts: DataFrame, nodes: DataFrame, ddl: str, make) -> DataFrame:
    """A map over the texts of ``nodes`` (node, k1, ...): of rows that share a doc_id those with the node's digest, and of equal ones one a task."""
    found = texts.join(small(nodes, 64), texts["doc_id"] == nodes["node"]).drop("doc_id")

    def outer():
        f, met = make(), set()

        def run(rows):
            words, on = [words_of(t) for t in rows["text"]], []
            if len(met) > 100_000:
                met.clear()
            for k, (node, w) in enumerate(zip(rows["node"], words, strict=True)):
                if node not in met and digest(w)[0] == rows["k1"][k]:
                    met.add(node)
                    on.append(k)
            return f({c: [v[k] for k in on] for c, v in rows.items()}, [words[k] for k in on])

        return run

    return map_rows(found, ddl, outer)


def sets_of(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(node, block, n, bundle, shingles) of (node, k1, block, n, bundle) rows; a node may come more than once."""

    def make():
        return lambda rows, words: {c: rows[c] for c in ("node", "block", "n", "bundle")} | {"shingles": [shingle_set(word_hashes(w)).astype("<u8").tobytes() for w in words]}

    return with_texts(texts, members.select("node", "k1", "block", "n", "bundle"), "node long, block long, n long, bundle long, shingles binary", make)


def bucket_links(held: tuple[np.ndarray, np.ndarray, np.ndarray], asks: tuple[np.ndarray, np.ndarray, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the pairs within ``radius`` bits that meet in a value. held, asks: values, fingerprints, nodes."""
    order = np.argsort(held[0], kind="stable")
    value, fp, node = (x[order] for x in held)
    us, vs = [], []
    starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [len(value)]]))
    hot = sizes > HOT
    for s, n in zip(starts[hot], sizes[hot], strict=True):
        us.append(node[s + 1 : s + n])
        vs.append(np.full(n - 1, node[s]))
    lo, hi = np.searchsorted(value, asks[0], "left"), np.searchsorted(value, asks[0], "right")
    n = hi - lo
    big = n > HOT
    us.append(asks[2][big])
    vs.append(node[lo[big]])
    rows = np.flatnonzero((n > 0) & ~big)
    at = 0
    ends = np.cumsum(n[rows])
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
        r = rows[at:stop]
        who = np.repeat(r, n[r])
        which = np.arange(len(who)) - np.repeat(np.cumsum(n[r]) - n[r], n[r]) + np.repeat(lo[r], n[r])
        near = (np.bitwise_count((asks[1][who] ^ fp[which]).view(np.uint64)) <= radius) & (asks[2][who] != node[which])
        if near.any():
            a, b = stars(asks[2][who[near]], node[which[near]])
            us.append(a)
            vs.append(b)
        at = stop
    return stars(np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2


def blocks(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, block) of (node, fp) rows with distinct fingerprints, for those that are within ``radius`` bits of another, directly or by steps."""
    n = nodes.count()
    m = 3 if n < MANY else 2
    if n < 2:
        return components(nodes.select(F.col("node").alias("u"), F.col("node").alias("v"))).withColumnRenamed("component", "block")
    parts = simhash.group_bits(simhash.co_occurrence(nodes), n, m)
    subs = simhash.sub_parts(parts)
    shares = simhash.histograms(nodes, subs)
    near = [[simhash.flips(len(p), t) for t in range(radius + 1)] for p in parts]
    shift = [max(0, len(p) - max(0, int(np.ceil(np.log2(max(1, n / GROUP)))))) for p in parts]
    ddl = "part int, set long, held boolean, value binary, fp binary, node binary"
    arrow = to_arrow_schema(schema_of(ddl))

    def send(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                b = whole.slice(at, 8192)
                fp, node = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                bits = simhash.bits_of(fp)
                thresholds = simhash.allot(bits, subs, shares, n, radius)
                rows = []
                for i, p in enumerate(parts):
                    own = simhash.value_of(bits, p)
                    asked = [(own[r][:, None] ^ near[i][t], np.repeat(r, len(near[i][t]))) for t in range(radius + 1) if len(r := np.flatnonzero(thresholds[:, i] == t))]
                    for held, value, row in ((True, own, np.arange(len(own))), (False, np.concatenate([x.ravel() for x, _ in asked]) if asked else own[:0], np.concatenate([r for _, r in asked]) if asked else np.zeros(0, np.int64))):
                        group = value >> shift[i]
                        order = np.argsort(group, kind="stable")
                        group, value, row = group[order], value[order], row[order]
                        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)] if len(group) else [0]
                        for s, e in zip(edges[:-1], edges[1:], strict=True):
                            rows.append({"part": i, "set": int(group[s]), "held": held, "value": value[s:e].astype("<u4").tobytes(), "fp": fp[row[s:e]].astype("<i8").tobytes(), "node": node[row[s:e]].astype("<i8").tobytes()})
                yield from pa.Table.from_pylist(rows, arrow).to_batches()

    link_arrow = to_arrow_schema(schema_of("u long, v long"))

    def meet(t: pa.Table) -> pa.Table:
        sides = []
        for held in (True, False):
            x = t.filter(pa.array([h == held for h in t["held"].to_pylist()]))
            sides.append(tuple(np.concatenate([np.zeros(0, kind), *(np.frombuffer(y, kind) for y in x[c].to_pylist())]) for c, kind in (("value", "<u4"), ("fp", "<i8"), ("node", "<i8"))))
        u, v = bucket_links(*sides, radius)
        return pa.Table.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], schema=link_arrow)

    edges = nodes.select("fp", "node").mapInArrow(send, ddl).groupBy("part", "set").applyInArrow(meet, "u long, v long")
    return components(edges).withColumnRenamed("component", "block")


class Sets:
    """Sets of numbers, each compared with all."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.words, self.code = np.unique(flat, return_inverse=True)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.mark = np.zeros(len(self.words), bool)
        df = np.bincount(self.code, minlength=len(self.words))
        self.central = np.add.reduceat(df[self.code], self.start[:-1]) / np.maximum(1, self.size) if len(sets) else np.zeros(0)

    def near(self, i: int, least: float) -> np.ndarray:
        return self._near(self.code[self.start[i] : self.start[i + 1]], self.size[i], least)

    def near_other(self, other: np.ndarray, least: float) -> np.ndarray:
        """Those that are similar to a set that isn't among them."""
        at = np.minimum(np.searchsorted(self.words, other), len(self.words) - 1)
        return self._near(at[self.words[at] == other], len(other), least)

    def _near(self, mine: np.ndarray, size: int, least: float) -> np.ndarray:
        self.mark[mine] = True
        common = np.add.reduceat(self.mark[self.code], self.start[:-1], dtype=np.int64)
        self.mark[mine] = False
        return np.flatnonzero(common + 1e-9 >= least * (size + self.size - common))


def link_block(sets: list[np.ndarray], least: float, first: int | None = None) -> np.ndarray:
    """Labels of the components of pairs with a similarity of at least ``least``. With ``first``, texts of its component are enough to know."""
    n = len(sets)
    s = Sets(sets)
    label = np.arange(n)
    done = np.zeros(n, bool)
    order = np.argsort(-s.central, kind="stable")
    while True:
        largest = label[first] if first is not None else np.bincount(label, minlength=n).argmax()
        todo = order[~done[order] & ((label[order] != largest) if done.any() else True)]
        if not len(todo):
            return label
        i = int(first if first is not None and not done[first] else todo[0])
        done[i] = True
        hit = label[s.near(i, least)]
        if len(hit):
            hit = np.unique(np.append(hit, label[i]))
            label[np.isin(label, hit)] = hit[0]


def once(t: pa.Table) -> pa.Table:
    """Rows in order of node, each node once."""
    t = t.sort_by([("node", "ascending")])
    node = t["node"].to_numpy()
    return t.filter(pa.array(np.diff(node, prepend=node[:1] - 1) != 0)) if len(node) else t


def similar(texts: DataFrame, places: DataFrame, least: float = LEAST) -> DataFrame:
    """(u, v) links whose components are those of all similar pairs in a block. places: (node, k1, block)."""
    ddl = "u long, v long, left boolean"
    arrow = to_arrow_schema(schema_of(ddl))

    def inside(t: pa.Table) -> pa.Table:
        # A hub comes with each part of its block; the first hub is the part's measure.
        t = once(t).sort_by([("hub", "descending"), ("node", "ascending")])
        hub, node = t["hub"].to_numpy(), t["node"].to_numpy()
        label = link_block([np.frombuffer(x, "<u8") for x in t["shingles"].to_pylist()], least, 0 if hub[0] > 0 else None)
        first: dict[int, int] = {}
        root = np.array([first.setdefault(int(x), int(k)) for k, x in zip(node, label, strict=True)])
        out = hub[0] > 0
        return pa.Table.from_arrays([pa.array(node), pa.array(root), pa.array((label != label[0]) & (hub <= 0) if out else np.zeros(len(node), bool))], schema=arrow)

    def bundle(t: pa.Table) -> pa.Table:
        t = t.sort_by([("block", "ascending"), ("node", "ascending")])
        block = t["block"].to_numpy()
        edges = np.flatnonzero(np.diff(block, prepend=block[0] - 1, append=block[-1] + 1))
        return pa.concat_tables([inside(t.slice(s, e - s)) for s, e in zip(edges[:-1], edges[1:], strict=True)])

    sizes = cut(places.groupBy("block").agg(F.count("*").alias("n")).where("n > 1"))
    told = lean(sizes).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    bundles = max(1, (told["n"] or 0) // BLOCK)
    sized = cut(places.join(sizes, "block").withColumn("bundle", F.pmod(F.xxhash64("block"), F.lit(bundles))))
    few_rows = sets_of(texts, sized.where(F.col("n") <= BLOCK)).withColumn("hub", F.lit(0))
    small_blocks = few_rows.groupBy("bundle").applyInArrow(bundle, ddl)
    if (told["most"] or 0) <= BLOCK:
        return small_blocks.where("u <> v").select("u", "v")
    large = cut(sets_of(texts, sized.where(F.col("n") > BLOCK)))
    # The most central texts of a large block: those that have most of its commonest shingles, of one in 64. A block's list of these is short, and its texts meet it in a join that can be split.
    few = lambda x: x[x % np.uint64(64) == 0].view(np.int64).tolist()
    each = map_rows(large.select("block", "shingles"), "block long, some array<long>", lambda: lambda r: {"block": r["block"], "some": [few(np.frombuffer(x, "<u8")) for x in r["shingles"]]}).select("block", F.explode("some").alias("shingle"))
    counted = each.groupBy("block", "shingle").agg(F.count("*").alias("df"))
    top = counted.withColumn("k", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("df"), "shingle"))).where(F.col("k") <= 256).groupBy("block").agg(F.collect_list(F.struct("shingle", "df")).alias("top"))

    def central(rows):
        out = []
        for x, top in zip(rows["shingles"], rows["top"], strict=True):
            mine, weight = np.frombuffer(x, "<u8"), {t["shingle"]: t["df"] for t in top or []}
            # A text of many shingles has more of them by its length alone.
            out.append(sum(weight.get(s, 0) for s in few(mine)) / max(1, len(mine)))
        return {"block": rows["block"], "node": rows["node"], "central": out}

    ranked = map_rows(large.select("block", "node", "shingles").join(small(top, 8192), "block", "left"), "block long, node long, central double", lambda: central).groupBy("block", "node").agg(F.max("central").alias("central"))
    hubs = cut(ranked.withColumn("k", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("central"), "node"))).where(F.col("k") <= HUBS).select("block", "node", (F.lit(HUBS + 1) - F.col("k")).alias("hub")))
    pieces = F.ceil(F.col("n") / (BLOCK // 2)).cast("int")
    dealt = large.join(hubs, ["block", "node"], "left_anti").select("block", F.pmod(F.xxhash64("node"), pieces).cast("int").alias("piece"), "node", "shingles", F.lit(0).alias("hub"))
    shared = large.join(hubs, ["block", "node"]).select("block", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), "node", "shingles", "hub")
    found = cut(dealt.union(shared).groupBy("block", "piece").applyInArrow(inside, ddl).union(small_blocks))
    # Who doesn't reach the first hub is compared with every part of the block.
    rest = large.join(found.where("left").select(F.col("u").alias("node")).distinct(), "node", "left_semi")
    asking = rest.select(F.col("block").alias("ask_block"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("ask_piece"), F.col("node").alias("ask_node"), F.col("shingles").alias("ask_shingles"))
    pair_arrow = to_arrow_schema(schema_of("u long, v long"))

    def across(x: pa.Table, y: pa.Table) -> pa.Table:
        us, vs = [], []
        if x.num_rows and y.num_rows:
            y = once(y)
            s, node = Sets([np.frombuffer(b, "<u8") for b in y["shingles"].to_pylist()]), y["node"].to_numpy()
            for b in x.to_batches(max_chunksize=1024):
                for who, other in zip(b["ask_node"].to_pylist(), b["ask_shingles"].to_pylist(), strict=True):
                    hit = node[s.near_other(np.frombuffer(other, "<u8"), least)]
                    us.append(hit)
                    vs.append(np.full(len(hit), who))
                if sum(map(len, us)) > 1 << 18:
                    u, v = stars(np.concatenate(us), np.concatenate(vs))
                    us, vs = [u], [v]
        u, v = stars(np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2
        return pa.Table.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], schema=pair_arrow)

    parts = dealt.select("block", "piece", "node", "shingles").union(shared.select("block", "piece", "node", "shingles"))
    more = asking.groupBy("ask_block", "ask_piece").cogroup(parts.groupBy("block", "piece")).applyInArrow(across, "u long, v long")
    return found.select("u", "v").union(more).where("u <> v")


def first_pairs(value: np.ndarray, node: np.ndarray, label: np.ndarray, size: np.ndarray, least: float, crowd: int = CROWD) -> tuple[np.ndarray, ...]:
    """(u, v, shared, needed) of the pairs of different labels that meet in a value; needed is 0 for those of a crowd, which are spanning stars."""
    order = np.argsort(value, kind="stable")
    value, node, label, size = value[order], node[order], label[order], size[order].astype(np.int64)
    out: list[np.ndarray] = [np.zeros((0, 4), np.int64)]
    if not len(value):
        return tuple(out[0].T)
    starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    ends = np.append(starts[1:], len(value))
    mixed = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
    for s, e in zip(starts[mixed & (ends - starts > crowd)], ends[mixed & (ends - starts > crowd)], strict=True):
        u, v = node[s + 1 : e], np.full(e - s - 1, node[s])
        out.append(np.stack([u, v, np.ones_like(u), np.zeros_like(u)], axis=1))
    small = mixed & (ends - starts <= crowd)
    rows = np.concatenate([np.zeros(0, np.int64), *(np.arange(s, e) for s, e in zip(starts[small], ends[small], strict=True))])
    n = np.repeat(ends[small], (ends - starts)[small]) - rows - 1
    rest = size - first_size(size, least)
    total, at = np.cumsum(n), 0
    held: list[np.ndarray] = [np.zeros((0, 4), np.int64)]
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 16), "right")))
        a = np.repeat(rows[at:stop], n[at:stop])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n[at:stop]) - n[at:stop], n[at:stop])
        on = (label[a] != label[b]) & (np.minimum(size[a], size[b]) + 1e-9 >= least * np.maximum(size[a], size[b]))
        a, b = a[on], b[on]
        # Beyond the first shingles of one of the two, no more than its further ones can be shared.
        need = np.maximum(1, np.ceil(least / (1 + least) * (size[a] + size[b]) - np.maximum(rest[a], rest[b]) - 1e-6)).astype(np.int64)
        held.append(np.stack([np.maximum(node[a], node[b]), np.minimum(node[a], node[b]), np.ones_like(need), need], axis=1))
        if sum(map(len, held)) > 1 << 18 or stop >= len(rows):
            x = np.concatenate(held)
            x = x[np.lexsort((x[:, 1], x[:, 0]))]
            new = np.flatnonzero(np.concatenate([[True], (x[1:, :2] != x[:-1, :2]).any(axis=1)])) if len(x) else np.zeros(0, np.int64)
            shared = np.add.reduceat(x[:, 2], new) if len(x) else x[:, 2]
            x = x[new]
            x[:, 2] = shared
            out.append(x)  # counts of a pair may come in parts; they are summed later
            held = []
        at = stop
    return tuple(np.concatenate(out).T)


def further(nodes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(u, v) links of (node, k1, label, size, parity) rows that join the components of all similar pairs of different labels."""
    shingles = lean(nodes).agg(F.sum("size")).first()[0] or 0
    n_sets, crowd = max(1, int((1 - least) * shingles) // TOKENS), CROWD
    common = texts.sparkSession.sparkContext.broadcast(common_cells(texts))
    ddl = "set long, value binary, at binary, node binary, label binary, size binary"
    arrow = to_arrow_schema(schema_of(ddl))
    plain = nodes.select("node", "k1", "label", "size")

    def make():
        def f(rows, words):
            first = [first_shingles(shingle_set(word_hashes(w)), common.value, least) for w in words]
            value, who = np.concatenate([*first, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(first)), [len(x) for x in first])
            node, label, size = (np.array(rows[c], kind) for c, kind in (("node", "<i8"), ("label", "<i8"), ("size", "<i4")))
            group = (value % np.uint64(n_sets)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            value, who, group = value[order], who[order], group[order]
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)] if len(group) else [0]
            out: dict[str, list] = {c: [] for c in ("set", "value", "at", "node", "label", "size")}
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                mine, at = np.unique(who[s:e], return_inverse=True)
                # Five bytes of a value are enough to meet by; a chance meeting is one more pair to look at.
                packed = np.ascontiguousarray((value[s:e] >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
                for c, x in zip(out, (int(group[s]), packed, at.astype("<u2").tobytes(), node[mine].tobytes(), label[mine].tobytes(), size[mine].tobytes()), strict=True):
                    out[c].append(x)
            return out

        return f

    pair_ddl = "u long, v long, shared long, needed long"
    pair_arrow = to_arrow_schema(schema_of(pair_ddl))

    def meet(t: pa.Table) -> pa.Table:
        cols = [[np.frombuffer(x, kind) for x in t[c].to_pylist()] for c, kind in (("at", "<u2"), ("node", "<i8"), ("label", "<i8"), ("size", "<i4"))]
        five = np.frombuffer(b"".join(t["value"].to_pylist()), np.uint8).reshape(-1, 5)
        value = np.zeros((len(five), 8), np.uint8)
        value[:, :5] = five
        at = np.concatenate([x.astype(np.int64) + o for x, o in zip(cols[0], np.cumsum([0, *map(len, cols[1])]), strict=False)])
        node, label, size = map(np.concatenate, cols[1:])
        return pa.Table.from_arrays([pa.array(x) for x in first_pairs(value.view("<u8").ravel(), node[at], label[at], size[at], least, crowd)], schema=pair_arrow)

    met = cut(with_texts(texts, plain, ddl, make).groupBy("set").applyInArrow(meet, pair_ddl))
    pairs = met.where("needed > 0").groupBy("u", "v").agg(F.sum("shared").alias("shared"), F.max("needed").alias("needed")).where("shared >= needed").select("u", "v")
    told = nodes.select("node", "size", "parity")
    both = pairs.join(told.toDF("u", "size_u", "parity_u"), "u").join(told.toDF("v", "size_v", "parity_v"), "v")

    def near(rows):
        a, b = (np.frombuffer(b"".join(rows[c]), np.uint64).reshape(-1, PARITY // 64) for c in ("parity_u", "parity_v"))
        differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        most = (1 - least) / (1 + least) * (np.array(rows["size_u"], np.int64) + np.array(rows["size_v"], np.int64))
        return {"u": rows["u"], "v": rows["v"], "near": (differ <= most + 1e-6).tolist()}

    edges = map_rows(both, "u long, v long, near boolean", lambda: near).where("near").select("u", "v").union(met.where("needed = 0").select("u", "v"))
    blocks = components(edges).withColumnRenamed("component", "block")
    return similar(texts, blocks.join(nodes.select("node", "k1"), "node"), least)


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """(doc_id, group) of every row: the smallest doc_id of the near copies."""
    found = cut(prints(df, id_col, text_col))
    # One text stands for the rows of a doc_id, and one doc_id for the texts of a word sequence.
    told = ("k1", "k2", "fp", "size", "parity")
    documents = found.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*told)).alias("m")).select("doc_id", "m.*")
    nodes = cut(documents.groupBy(*told).agg(F.min("doc_id").alias("node")))
    heads = nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n"))
    near = blocks(heads.select(F.col("head").alias("node"), "fp"), radius).select(F.col("node").alias("head"), "block")
    put = heads.join(near, "head", "left").where("n > 1 or block is not null").select("fp", F.coalesce("block", "head").alias("block"))
    texts = text_rows(df, id_col, text_col, binary=True)
    labels = components(similar(texts, nodes.join(put, "fp").select("node", "k1", "block"), least))
    labelled = cut(nodes.join(labels, "node", "left").select("node", "k1", F.coalesce("component", "node").alias("label"), "size", "parity"))
    labels = components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(further(labelled, texts, least)))
    by_text = nodes.join(labels, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("group"))
    by_id = documents.select("doc_id", "k1", "k2").join(by_text, ["k1", "k2"]).select(F.col("doc_id").alias("id"), "group")
    return found.select("doc_id").join(by_id, F.col("doc_id") == F.col("id"), "left").select("doc_id", "group")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """The rows of ``df`` without near copies of a smaller doc_id's group; its columns as they are."""
    gone = cut(groups(df, id_col, text_col, least, radius).where("doc_id <> group").select(F.col("doc_id").alias("gone_id")).distinct())
    gone = small(gone, 32)
    return df.join(gone, df[id_col].cast("long") == gone["gone_id"], "left_anti")
