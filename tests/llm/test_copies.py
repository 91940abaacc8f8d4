import random

import numpy as np
import pytest

from tests.llm.cases import empty_documents, odd_documents
from tests.llm.test_simhash import brute_components
from tierfold.llm import copies


def brute_groups(texts: dict[int, str], least=0.8):
    def shingles(t):
        w = t.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()

    sets = {i: shingles(t or "") for i, t in texts.items()}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            union = len(sets[a] | sets[b])
            if (sets[a] == sets[b]) or union and len(sets[a] & sets[b]) / union >= least:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(seed, n_base=25, copies_each=12, edits=3, length=150):
    rng = random.Random(seed)
    texts = {}
    ids = rng.sample(range(10_000), n_base * copies_each)
    for b in range(n_base):
        base = [f"w{rng.randrange(3000)}" for _ in range(length)]
        for c in range(copies_each):
            w = list(base)
            for _ in range(rng.randrange(0, edits + 1)):
                w[rng.randrange(length)] = f"e{rng.randrange(3000)}"
            texts[ids.pop()] = (" " if c % 2 else "  ").join(w)
    return texts


def run(spark, texts):
    df = spark.createDataFrame([(i, t, f"s{i}") for i, t in texts.items()], "doc_id long, text string, gone_id string")
    got = {r.doc_id: r.group for r in copies.groups(df).collect()}
    kept = copies.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if i == g}
    return got


def test_as_brute_force(spark):
    for seed in range(2):
        texts = corpus(seed)
        assert run(spark, texts) == brute_groups(texts)


@pytest.mark.parametrize("edits", [3, 9])
def test_large_blocks_in_parts(spark, monkeypatch, edits):
    monkeypatch.setattr(copies, "BLOCK", 20)
    monkeypatch.setattr(copies, "HUBS", 3)
    texts = corpus(5, 3, 70, edits)
    assert run(spark, texts) == brute_groups(texts)


def test_bucket_links(monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**62, 8)
    fp = np.concatenate([c ^ np.bitwise_or.reduce(1 << rng.integers(0, 60, (40, 5)), axis=1) for c in centre])
    node, value = np.arange(len(fp)) * 3, np.repeat(np.arange(4), 80)
    for hot in (16384, 10):
        monkeypatch.setattr(copies, "HOT", hot)
        u, v = copies.bucket_links((value, fp, node), (value, fp, node), 8)
        parent = {int(n): int(n) for n in node} | {int(a): int(b) for a, b in zip(u, v)}
        for k in range(4):
            mine = {int(n): int(f) for n, f in zip(node[value == k], fp[value == k])}
            if hot > 80:
                assert {n: parent[n] for n in mine} == brute_components(mine, 8)
            else:
                assert len({parent[n] for n in mine}) == 1


def test_odd_rows(spark):
    got = sorted((r.doc_id, r.group) for r in copies.groups(odd_documents(spark)).collect())
    assert len(got) == 10 and (1, 0) in got and (2, 0) in got and (6, 5) in got
    assert copies.keep_one(odd_documents(spark)).count() == 7  # ids 1, 2 and 6 go; the rows of id 5 stay together
    assert copies.groups(empty_documents(spark)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert copies.keep_one(nulls).count() == 3


def far_copies(seed, n_base=12):
    """Copies cut short, run on and changed in one block, at similarities about 0.8, besides scattered edits."""
    rng = random.Random(seed)
    new = lambda k: [f"w{rng.randrange(5000)}" for _ in range(k)]
    texts, ids = {}, rng.sample(range(10_000), n_base * 9)
    for _ in range(n_base):
        w = new(rng.randrange(80, 260))
        n = len(w)
        texts[ids.pop()] = " ".join(w)
        for share in (0.17, 0.19):
            k, at = int(share * n), rng.randrange(n // 2)
            texts[ids.pop()] = " ".join(w[: n - k])
            texts[ids.pop()] = " ".join(w + new(int(n * share)))
            texts[ids.pop()] = " ".join(w[:at] + new(k // 2) + w[at + k // 2 :])
            texts[ids.pop()] = " ".join(w[k:])
    return texts


@pytest.mark.parametrize("crowd", [256, 2])
def test_copies_beyond_the_radius(spark, monkeypatch, crowd):
    monkeypatch.setattr(copies, "CROWD", crowd)
    monkeypatch.setattr(copies, "TOKENS", 200)
    texts = far_copies(1)
    assert run(spark, texts) == brute_groups(texts)


def test_first_pairs_miss_none():
    rng = random.Random(8)
    base = [np.array(sorted(rng.sample(range(10**6), rng.randrange(1, 60))), np.uint64) << np.uint64(30) for _ in range(20)]
    sets = base + [np.unique(np.concatenate([rng.choice(base)[rng.randrange(3) :], np.array(rng.sample(range(10**6), rng.randrange(4)), np.uint64) << np.uint64(30)])) for _ in range(300)]
    sets = [x for x in sets if len(x)]
    common = np.zeros(copies.CELLS, np.uint8)
    common[copies.cells_of(base[0])] = 3
    first = [copies.first_shingles(x, common, 0.8) for x in sets]
    assert all(len(x) < 3 or not np.isin(x, base[0]).all() or np.isin(s, base[0]).mean() > 0.7 for x, s in zip(first, sets))
    who = np.repeat(np.arange(len(sets)), [len(x) for x in first])
    u, v, shared, needed = copies.first_pairs(np.concatenate(first), who, who, np.array([len(x) for x in sets])[who], 0.8)
    found = {(int(b), int(a)) for a, b, s, k in zip(u, v, shared, needed) if s >= k}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if (k := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - k)}
    assert want and want <= found


def test_shingles_as_word_tuples():
    rng = random.Random(9)
    seen = {}
    for n in (0, 1, 3, 4, 5, 6, 50, 400):
        w = [rng.choice("abcdefgh").encode() for _ in range(n)]
        want = {tuple(w[i : i + 5]) for i in range(n - 4)} if n >= 5 else {tuple(w)} if n else set()
        got = copies.shingle_set(copies.word_hashes(w))
        assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()
        for t in want:
            h = int(copies.shingle_set(copies.word_hashes(list(t)))[0])
            assert h in got and seen.setdefault(h, t) == t


def test_parity_differs_no_more_than_the_sets():
    rng = np.random.default_rng(10)
    for _ in range(100):
        a = np.unique(rng.integers(0, 2**63, rng.integers(0, 900), np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 2**63, rng.integers(0, 200), np.uint64)]))
        x, y = (np.frombuffer(copies.parity(s), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_common_shingles_are_found(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(f"own{i} a{i} b{i} c{i} d{i} e{i} " + (passage if i % 2 else " ".join(f"x{i}y{k}" for k in range(60))),) for i in range(400)]
    table = copies.common_cells(spark.createDataFrame(rows, "text string").selectExpr("cast(text as binary) as text"))
    shared = copies.shingle_set(copies.word_hashes(passage.encode().split()))
    assert (table[copies.cells_of(shared)] >= 2).all() and (table > 0).sum() < 120


def test_repeated_ids_have_a_defined_result(spark):
    """Of the texts of one doc_id that of the least digest stands for it, in whatever order the rows come."""
    texts = [" ".join(f"w{k}x{j}" for k in range(30)) for j in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0]), (3, texts[1]), (4, texts[2]), (4, texts[3]), (5, texts[3]), (4, texts[2]), (None, texts[2]), (9, texts[5])]
    got = []
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got.append({r.doc_id: r.group for r in copies.groups(df).collect()})
    assert got[0] == got[1] == got[2]
    stands = {i: min((copies.digest(t.encode().split()), t) for j, t in rows if j == i)[1] for i in (1, 2, 3, 4, 5, 9)}
    want = {i: min(j for j, u in stands.items() if u == t) for i, t in stands.items()}
    assert got[0] == want | {None: None}
