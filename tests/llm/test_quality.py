import random

import numpy as np

from tests.llm.cases import empty_documents, odd_documents
from tierfold.llm import quality


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "and", "thion", "erre", "ingly", "stand", "hare", "ouen", "nd"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) + rng.choice(["", "ed", "er", "st"]) for _ in range(rng.randrange(20, 200))]
        good = rng.random() > 0.2
        if not good:
            kind = rng.randrange(3)
            w = [x + "###" for x in w] if kind == 0 else [x.upper() + "!!" for x in w] if kind == 1 else [w[0]] * len(w)
        rows.append((i, " ".join(w) + ".", "en", f"src{i % 7}"))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(1, 600)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    told = spark.createDataFrame(labels[:300], "doc_id long, quality int")
    got = {r.doc_id: r.keep for r in quality.score(df, told).collect()}
    assert sum(got[i] == y for i, y in labels[300:]) >= 0.98 * 300
    kept = quality.keep_good(df, told)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_sites_shrink_sparse_ones(spark):
    rows = [("a", "p", -3.0)] * 50 + [("b", "p", 3.0)] * 50 + [("c", "p", 0.0), ("c", "q", 0.0)] + [(f"h{k}", "p", 2.0) for k in range(20)]
    df = spark.createDataFrame(rows, "host string, path string, evidence double")
    got = {(r.host, r.path): r.posterior for r in quality.posterior(df).collect()}
    p = 1 / (1 + np.exp(-np.array([r[2] for r in rows])))
    assert got["a", "p"] < 0.02 < 0.98 < got["b", "p"]
    assert abs(got["c", "q"] - p.mean()) < 0.2  # no evidence, one neighbour: near the global rate


def direct(rows):
    """The posterior of (host, path, evidence) rows, by loops over all of them."""
    p = [1 / (1 + np.exp(-e)) for _, _, e in rows]
    hosts, paths = {}, {}
    for (h, q, _), x in zip(rows, p):
        hosts.setdefault(h, []).append(x)
        paths.setdefault((h, q), []).append(x)

    def strength(groups):
        n, r = np.array([len(g) for g in groups]), np.array([np.mean(g) for g in groups])
        mean = min(1 - 1e-4, max(1e-4, sum(map(sum, groups)) / n.sum()))
        if len(groups) < 2:
            return mean, 100.0
        spread = max(0.0, (n * r * r).sum() - n.sum() * mean**2 - (len(groups) - 1) * mean * (1 - mean)) / max(1e-9, n.sum() - (n * n).sum() / n.sum())
        return mean, min(1e6, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 1e-9 else 1e6

    rate, of_host = strength(list(hosts.values()))
    _, of_path = strength(list(paths.values()))
    out = []
    for (h, q, e), x in zip(rows, p):
        a = (sum(hosts[h]) - x + of_host * rate) / (len(hosts[h]) - 1 + of_host)
        b = (sum(paths[h, q]) - x + of_path * a) / (len(paths[h, q]) - 1 + of_path)
        b = min(1 - 1e-4, max(1e-4, b))
        out.append(1 / (1 + np.exp(-(e + np.log(b / (1 - b))))))
    return out


def test_posterior_as_brute_force(spark):
    rng = random.Random(5)
    for n, hosts in ((1, 1), (30, 1), (400, 12)):
        rows = [(f"h{min(rng.randrange(hosts), rng.randrange(hosts))}", f"p{rng.randrange(3)}", rng.gauss(rng.randrange(-1, 3), 2)) for _ in range(n)]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, host string, path string, evidence double")
        for bound in (1 << 20, 0):  # sites by broadcast, and by a join with salts
            got = {r.i: r.posterior for r in quality.posterior(df, bound).collect()}
            assert np.allclose([got[i] for i in range(n)], direct(rows), atol=1e-9)


def test_odd_rows(spark):
    df = odd_documents(spark)
    labels = spark.createDataFrame([(3, 1), (7, 0), (99, 1), (None, 1), (4, None)], "doc_id long, quality int")
    assert quality.score(df, labels).count() == 10
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(df, none).count() == 10 and quality.keep_good(df, none).columns == df.columns
    assert quality.score(empty_documents(spark), labels).count() == 0
    assert quality.keep_good(empty_documents(spark), none).count() == 0
