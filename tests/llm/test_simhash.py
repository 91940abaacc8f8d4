import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tests.llm.cases import empty_documents, odd_documents
from tierfold.llm import components as components_module
from tierfold.llm import simhash
from tierfold.llm.components import components


def brute_fingerprint(text, size=3):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", t)
    sh = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps: dict[int, int], radius=2):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_documents_as_brute_force(spark):
    rng = random.Random(4)
    words = ["the", "Of", "thion", "ER", "é", "ing", "that's", "x y"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for i in range(60)}
    base = " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(400))
    for i in range(60, 90):
        w = base.split(" ")
        w[rng.randrange(400)] = "new"
        texts[i] = "\t\n".join(w) if i % 3 else base.upper()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(fps)
    got = simhash.near_duplicates(df).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in got} == want
    assert max(Counter(want.values()).values()) > 5


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("bucket", [1, 4, 256])
def test_links_by_pigeonhole_and_midpoints(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            x = centre
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << b
            fps.add(x)
    nodes = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(i, signed(f)) for i, f in nodes.items()], "node long, fp long")
    got = {r.node: r.component for r in components(simhash.links(df)).collect()}
    assert {i: got.get(i, i) for i in nodes} == brute_components(nodes)


def test_thresholds_fill_the_radius():
    rng = np.random.default_rng(7)
    fps = rng.integers(-(2**63), 2**63, 500)
    bits = simhash.bits_of(fps)
    both = bits.T.astype(float) @ bits
    for m in (2, 3, 4):
        parts = simhash.group_bits(both, 500, m)
        assert sorted(sum(parts, [])) == list(range(64))
        subs = simhash.sub_parts(parts)
        shares = []
        for sub in subs:
            shares.append([])
            for s in sub:
                c = np.bincount(simhash.value_of(bits, s), minlength=1 << len(s))
                v = np.arange(1 << len(s))
                d = np.bitwise_count(v[:, None] ^ v[None, :]).astype(int)
                shares[-1].append(np.stack([((d == k) * c).sum(axis=1) for k in range(len(s) + 1)], axis=1) / 500)
        t = simhash.allot(bits, subs, shares, 500, 2)
        assert ((t + 1).sum(axis=1) == 3).all() and (t >= -1).all()


def test_chain_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "u long, v long")
    got = {r.node: r.component for r in components(chain).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def edges_brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("few", [None, 50])
def test_components_by_one_task_or_rounds(spark, monkeypatch, few):
    if few:
        monkeypatch.setattr(components_module, "FEW", few)
    rng = random.Random(4)
    edges = [tuple(rng.randrange(-400, 400) * 10**14 for _ in "uv") for _ in range(450)]
    edges += [(i, i + 1) for i in range(1, 90)] + [(10**18, 10**18 + k) for k in range(300)] + [(5, None), (7, 7)] + edges[:50]
    rows = components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.node: r.component for r in rows} == edges_brute(edges)


def test_small_graph_takes_few_tasks(spark):
    """However long its paths: each task of a round leaves files and lines of the log."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    spark.sparkContext.setJobGroup("few tasks", "")
    try:
        assert {r.component for r in components(edges).collect()} == {0}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told = spark.sparkContext.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("few tasks") for s in told.getJobInfo(j).stageIds}
    tasks = sum(i.numTasks for s in stages if (i := told.getStageInfo(s)))
    assert 0 < tasks <= 40


def test_odd_rows(spark):
    rows = simhash.near_duplicates(odd_documents(spark)).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows}
    assert by[0].fingerprint == by[1].fingerprint == by[2].fingerprint == "0" * 16
    assert by[2].component_id == 0 and by[6].component_id == 5
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, "other words here now")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(nulls).collect()) == [(-1, -1), (-1, 4), (4, 4)]


def test_one_holder_and_one_who_asks_meet(spark, monkeypatch):
    """Two fingerprints with one differing bit in each of two partitions, thresholds (2, -1, -1) and (-1, 2, -1)."""
    a, b, rows = 0, (1 << 3) | (1 << 30), []
    for node, fp, asking in ((1, a, 0), (2, b, 1)):
        for part in range(3):
            value = fp >> 22 * part & (1 << 22) - 1
            flips = [0, *(1 << k for k in range(22))] if part == asking else [0]
            rows += [(part, value ^ f, fp, node, f == 0, part == asking) for f in flips]
    keyed = spark.createDataFrame(rows, "part int, value long, fp long, node long, held boolean, asks boolean")
    monkeypatch.setattr(simhash, "keyed", lambda *_: keyed)
    got = simhash.links(spark.createDataFrame([(1, a), (2, b)], "node long, fp long")).collect()
    assert {frozenset((r.u, r.v)) for r in got} == {frozenset((1, 2))}


def test_any_legal_thresholds_miss_no_pair(spark, monkeypatch):
    """Skewed fingerprints, each with thresholds drawn at random from those that sum up to the radius rule."""
    rng = random.Random(12)
    centres = [rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) for _ in range(6)]
    fps = set()
    while len(fps) < 150:
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.randrange(0, 4)):
            x ^= 1 << b
        fps.add(x)
    parts = [list(range(0, 21)), list(range(21, 42)), list(range(42, 64))]
    legal = [(a, b, c) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 0]
    rows = []
    for node, fp in enumerate(sorted(fps)):
        for i, (part, t) in enumerate(zip(parts, rng.choice(legal))):
            value = sum((fp >> b & 1) << k for k, b in enumerate(part))
            for f in simhash.flips(len(part), t).tolist() if t >= 0 else [0]:
                rows.append((i, value ^ f, signed(fp), node, f == 0, t >= 0))
    keyed = spark.createDataFrame(rows, "part int, value long, fp long, node long, held boolean, asks boolean")
    monkeypatch.setattr(simhash, "keyed", lambda *_: keyed)
    nodes = dict(enumerate(sorted(fps)))
    got = {r.node: r.component for r in components(simhash.links(spark.createDataFrame([(i, signed(f)) for i, f in nodes.items()], "node long, fp long"))).collect()}
    assert {i: got.get(i, i) for i in nodes} == brute_components(nodes)
