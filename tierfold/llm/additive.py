"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one full-dimensional word from each of ``STAGES`` codebooks. The codebooks are fitted on a
bounded sample: k-means on the residuals stage by stage, then sweeps of
least squares over all books. Every vector is encoded by beam
search and stored as its code bytes and the squared norm of its reconstruction. A query's inner products with all words
make a lookup table, so that the distance to a coded vector is a sum of table entries and the stored norm. The ``DEPTH``
best by that score are ranked again by the exact distance.

Equal vectors are one class with their k + 1 smallest ids, found by a windowed limit before the shuffle; equal queries
are searched once. Queries meet the coded vectors block by block: some thousand queries with some hundred thousand coded
vectors in a task, which goes through them in small steps, so that neither side is sent often. Both sides are packed, and the
vectors' blocks are dealt to salts, so no block pair depends on how many rows an id, vector or block has. Nothing is broadcast but the
codebooks, whose size follows from the parameters.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those whose length isn't
the most frequent one (ties: the longest). Ties go to the smaller id. Repeated rows count once; of several vectors of one
id the least stands for it. Components too large for 32 bits are scaled down for the codes; the exact ranking takes them as they are. Fewer candidates than k:
all of them. Empty table: no rows. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tierfold.llm.common import cut, schema_of

STAGES, WORDS, BEAM, SWEEPS = 32, 256, 4, 2
#: Vectors that the codebooks are fitted on, at most about.
SAMPLE = 16384
#: Candidates of a query that are ranked exactly.
DEPTH = 200
#: Queries of a block, and coded vectors that meet it in one task, on average; queries that are scored at once.
QUERY_BLOCK, ROWS_BLOCK, AT_ONCE = 8192, 262_144, 256
#: Components up to this size can be squared and summed in 32 bits.
LARGEST = 1e15
SEED = 11


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = df[vector_col]
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = df.select(df[id_col].cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    sizes = out.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not sizes:
        return out
    out = out.where(F.size("v") == sizes[0]["size"])
    # Ids with several vectors; only these are looked at again.
    several = cut(out.groupBy("vec_id").agg((F.count("*") > 1).alias("on")).where("on").select("vec_id"))
    if several.isEmpty():
        return out
    least = out.join(several, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    return out.join(several, "vec_id", "left_anti").union(least.select("vec_id", "v"))


def nearest_word(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(axis=1)[None, :] - 2 * x @ words.T).argmin(axis=1)


def fit(x: np.ndarray, stages: int = STAGES, words: int = WORDS, rounds: int = 5) -> np.ndarray:
    """stages x words x dimensions."""
    rng = np.random.default_rng(SEED)
    x = x.astype(np.float32)
    books = np.zeros((stages, words, x.shape[1]), np.float32)
    rest = x.copy()
    for s in range(stages):
        c = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(rounds):
            near = nearest_word(rest, c)
            sums = np.stack([np.bincount(near, rest[:, d], minlength=words) for d in range(x.shape[1])], axis=1)
            n = np.bincount(near, minlength=words)
            c[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(np.float32)
            c[n == 0] = rest[rng.choice(len(rest), int((n == 0).sum()))]
        books[s] = c
        rest -= c[nearest_word(rest, c)]
    # All words again, given the codes: each book becomes the means of what the others leave, for a few sweeps.
    codes = encode(x, books)
    rest = x - decode(codes, books)
    for _ in range(SWEEPS):
        for s in range(stages):
            rest += books[s][codes[:, s]]
            n = np.bincount(codes[:, s], minlength=words)
            sums = np.stack([np.bincount(codes[:, s], rest[:, d], minlength=words) for d in range(x.shape[1])], axis=1)
            books[s][n > 0] = sums[n > 0] / n[n > 0, None]
            rest -= books[s][codes[:, s]]
    return books


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """n x stages words, by beam search on the residual."""
    out = []
    for at in range(0, len(x), 512):
        rest = x[at : at + 512, None, :].astype(np.float32)
        n = len(rest)
        codes = np.zeros((n, 1, 0), np.uint8)
        for c in books:
            # The squared norm of a residual less a word.
            error = (rest**2).sum(axis=2)[:, :, None] + (c**2).sum(axis=1) - 2 * (rest.reshape(-1, rest.shape[2]) @ c.T).reshape(n, rest.shape[1], -1)
            flat = error.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            parent, word = best // len(c), best % len(c)
            rows = np.arange(n)[:, None]
            rest = rest[rows, parent] - c[word]
            codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
        out.append(codes[np.arange(n), (rest**2).sum(axis=2).argmin(axis=1)])
    return np.concatenate(out) if out else np.zeros((0, len(books)), np.uint8)


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[s][codes[:, s]] for s in range(len(books)))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def scores(queries: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances less the queries' norms, from lookup tables."""
    out = np.repeat(norms[None, :], len(queries), axis=0)
    for s, c in enumerate(books):
        out += np.take(-2 * queries @ c.T, codes[:, s], axis=1)
    return out


def best(score: np.ndarray, ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``depth`` least scores of each row, ties to smaller ids. score, ids: queries x candidates."""
    if score.shape[1] > depth:
        limit = np.partition(score, depth - 1, axis=1)[:, depth - 1 : depth]
        width = int((score <= limit).sum(axis=1).max())
        order = np.lexsort((ids, score), axis=1)[:, :depth] if width > depth else np.argpartition(score, depth - 1, axis=1)[:, :depth]
        score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
    return score, ids


def search(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", depth: int = DEPTH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query among all rows but its own."""
    spark = df.sparkSession
    rows = valid(df, id_col, vector_col)
    first = Window.partitionBy("v").orderBy("vec_id")
    classes = cut(rows.withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("cid"), "ids", "v"))
    asked = rows.join(queries.select(queries[id_col].cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi").distinct()
    # Equal queries ask once, under their least id.
    heads = cut(asked.groupBy("v").agg(F.min("vec_id").alias("head")))
    n_classes, n_heads = classes.count(), heads.count()
    if not n_heads:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    largest = classes.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()[0]
    scale = min(1.0, LARGEST / largest)
    sample = classes.where(F.pmod(F.xxhash64("cid"), F.lit(n_classes)) < SAMPLE).select("v").limit(2 * SAMPLE).toArrow()
    books = spark.sparkContext.broadcast(fit(matrix(sample["v"]) * scale))

    n_blocks, n_salts = -(-n_heads // QUERY_BLOCK), max(8, -(-n_classes // ROWS_BLOCK))

    def encoded(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x, ids = matrix(part.column("v")) * scale, part.column("cid").to_numpy(zero_copy_only=False)
                codes = encode(x, books.value)
                norms = (decode(codes, books.value) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids.astype("<i8"), codes, norms.astype("<f4"))], ["ids", "codes", "norms"])

    def packed(t: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int32()), "heads": [t["head"].to_numpy().astype("<i8").tobytes()], "vectors": [(matrix(t["v"]) * scale).astype("<f4").tobytes()]})

    coded = classes.select("cid", "v").mapInArrow(encoded, "ids binary, codes binary, norms binary")
    left = coded.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(n_salts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = heads.withColumn("block", F.pmod(F.xxhash64("head"), F.lit(n_blocks)).cast("int")).groupBy("block").applyInArrow(packed, "block int, heads binary, vectors binary")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1))))
    found_ddl = "head long, ids binary, scores binary"
    found_arrow = to_arrow_schema(schema_of(found_ddl))

    def met(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return found_arrow.empty_table()
        heads = np.frombuffer(y["heads"][0].as_py(), "<i8")
        q = np.frombuffer(y["vectors"][0].as_py(), "<f4").reshape(len(heads), -1)
        parts = [(np.frombuffer(a, "<i8"), np.frombuffer(c, np.uint8), np.frombuffer(n, "<f4")) for a, c, n in zip(x["ids"].to_pylist(), x["codes"].to_pylist(), x["norms"].to_pylist(), strict=True)]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(heads), AT_ONCE):
            some = q[at : at + AT_ONCE]
            top_score, top_ids = np.zeros((len(some), 0), np.float32), np.zeros((len(some), 0), np.int64)
            for ids, codes, norms in parts:
                s = scores(some, codes.reshape(len(ids), -1), norms, books.value)
                top_score, top_ids = best(np.concatenate([top_score, s], axis=1), np.concatenate([top_ids, np.repeat(ids[None, :], len(some), axis=0)], axis=1), depth)
            found.append((top_ids, top_score))
        return pa.Table.from_arrays([pa.array(heads), *(pa.array([r.tobytes() for f in found for r in f[k]], pa.binary()) for k in (0, 1))], schema=found_arrow)

    def merged(t: pa.Table) -> pa.Table:
        by: dict[int, list[int]] = {}
        for i, h in enumerate(t["head"].to_pylist()):
            by.setdefault(h, []).append(i)
        all_ids, all_scores = t["ids"].to_pylist(), t["scores"].to_pylist()
        heads, out = [], []
        for h, at in by.items():
            ids = np.concatenate([np.frombuffer(all_ids[i], np.int64) for i in at])[None, :]
            score = np.concatenate([np.frombuffer(all_scores[i], np.float32) for i in at])[None, :]
            kept = best(score, ids, depth)[1][0]
            heads.append(np.full(len(kept), h))
            out.append(kept)
        return pa.table({"head": np.concatenate(heads), "cid": np.concatenate(out)})

    candidates = left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInArrow(met, found_ddl)
    candidates = candidates.withColumn("merger", F.pmod(F.xxhash64("head"), F.lit(max(16, n_blocks * 4)))).groupBy("merger").applyInArrow(merged, "head long, cid long")
    pairs = candidates.join(classes.withColumnRenamed("v", "x"), "cid").join(heads, "head")
    square = F.aggregate(F.zip_with("x", "v", lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, y: s + y)
    exact = pairs.select("head", F.sqrt(square).alias("score"), F.explode("ids").alias("vec_id"))
    near = Window.partitionBy("head").orderBy("score", "vec_id")
    top = exact.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1)
    of = asked.join(heads, "v").select(F.col("vec_id").alias("query_id"), "head")
    own = of.join(top, "head").where("query_id <> vec_id")
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("n"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
