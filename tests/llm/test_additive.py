import numpy as np

from tierfold.llm import additive


def brute(rows, queries, k):
    ok = {i: np.array(v, np.float64) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries:
        if q in ok:
            d = sorted((float(np.sqrt(((ok[q] - v) ** 2).sum())), i) for i, v in ok.items() if i != q)
            out[q] = d[:k]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(10, 32))
    x = (centres[rng.integers(0, 10, 3000)] + rng.normal(size=(3000, 32))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in additive.search(df, df.where("vec_id % 100 = 0"), 10).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    want = brute(rows, range(0, 3000, 100), 10)
    assert set(got) == set(want)
    hit = sum(len({i for _, i in want[q]} & {i for _, i in got[q].values()}) for q in want)
    assert hit >= 0.95 * 10 * len(want)
    for q, found in got.items():
        assert sorted(found) == list(range(1, 11)) and [found[k] for k in sorted(found)] == sorted(found.values())
        assert all(abs(s - np.sqrt(((x[q].astype(float) - x[i].astype(float)) ** 2).sum())) < 1e-12 for s, i in found.values())


def test_ties_and_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [1.0, 2.0]) for i in range(0, 400)] + [(400, None), (500, [0.0, 0.0]), (600, [nan, 1.0]), (700, [inf, 1.0]), (800, [None, 1.0]), (900, []), (1000, [1.0, 2.5]), (1000, [1.0, 2.5]), (1100, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, head string")
    got = {}
    for r in additive.search(df, df.where("vec_id % 100 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute([x for x in dict(rows).items() if x[0] != 1100], range(0, 1200, 100), 10)
    assert set(got) == {0, 100, 200, 300, 1000} == set(want)
    for q in got:
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, s) for s, i in want[q]]


def test_few_and_none(spark):
    ddl = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0, 1.0]), (7, [1.0, 3.0])], ddl)
    assert [(r.rank, r.vec_id) for r in additive.search(few, few.where("vec_id = 0"), 10).orderBy("rank").collect()] == [(1, 1), (2, 7)]
    empty = spark.createDataFrame([], ddl)
    assert additive.search(empty, empty, 10).count() == 0


def test_beam_beats_greedy_and_tables_match():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    books = additive.fit(x, stages=4, words=32)
    error = [float(((x - additive.decode(additive.encode(x, books, b), books)) ** 2).sum()) for b in (1, 8)]
    assert error[1] < error[0] < float((x**2).sum())
    codes = additive.encode(x[:50], books)
    y = additive.decode(codes, books)
    got = additive.scores(x[50:60], codes, (y**2).sum(axis=1), books)
    want = ((x[50:60, None, :] - y[None]) ** 2).sum(axis=2) - (x[50:60] ** 2).sum(axis=1)[:, None]
    assert np.abs(got - want).max() < 1e-3


def test_repeated_ids_and_large_components(spark):
    """Of several vectors of one id the least stands for it; components beyond 32 bits are ranked exactly too."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 4)) * 10.0 ** rng.integers(30, 100, (300, 1)))]
    rows += [(100, [5.0, 1.0, 1.0, 1.0]), (7, [0.5, 1.0, 2.0, 3.0]), (7, [9e120, 1.0, 2.0, 3.0]), (200, list(rows[200][1]))]
    ids = {}
    for i, v in rows:
        ids[i] = min(ids.get(i, v), v)
    want = brute(list(ids.items()), range(0, 300, 100), 10)
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<double>")
        got = {}
        for r in additive.search(df, df.where("vec_id % 100 = 0"), 10, depth=400).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert set(got) == {0, 100, 200}
        for q in got:
            assert [i for _, i, _ in sorted(got[q])] == [i for _, i in want[q]]


def test_blocks_give_the_same_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 8)).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = lambda: sorted(map(tuple, additive.search(df, df.where("vec_id % 10 = 0"), 5).collect()))
    once = found()
    monkeypatch.setattr(additive, "QUERY_BLOCK", 16)
    monkeypatch.setattr(additive, "ROWS_BLOCK", 100)
    assert found() == once
