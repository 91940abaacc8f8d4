"""Connected components of an edge table, by alternating large-star and small-star steps until one task can join what is left."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierfold.llm.common import cut, lean

#: A table of no more edges is joined by one task: rounds over it would cost more files and tasks than work.
FEW = 1 << 18


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of some edges that aren't least themselves."""
    ids, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    on = label != np.arange(len(ids))
    return ids[on], ids[label[on]]


def _named(edges: DataFrame) -> DataFrame:
    """(node, component) of edges that one task can hold."""

    def run(batches):
        none = np.zeros(0, np.int64)
        us, vs = [none], [none]
        for b in batches:
            us.append(b.column(0).to_numpy(zero_copy_only=False))
            vs.append(b.column(1).to_numpy(zero_copy_only=False))
        u, v = stars(np.concatenate(us), np.concatenate(vs))
        least = np.unique(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, least])), pa.array(np.concatenate([v, least]))], ["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least node that it knows. The least is found by a partial aggregate, so a centre of many edges costs no more than others; the join back can be split."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from larger to smaller nodes; a node and its smaller neighbours go to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs in any order to (node, component): the least node that each node reaches, for nodes with an edge; settled.

    Every round is checkpointed to the shared folder; rounds end when ``FEW`` edges are left, which one task joins, or
    when a digest of the edges stays the same.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    digest = lambda d: lean(d).agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = digest(e)
    while before[0] > FEW:
        e = cut(_small_star(_large_star(e)))
        after = digest(e)
        if after == before:
            return cut(e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
        before = after
    return cut(_named(e))
