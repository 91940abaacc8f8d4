import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import empty_documents, odd_documents
from tierfold.llm import suffixes


def brute(texts: list[tuple[int, bytes]]):
    """(removed mask) of each text: 50-byte strings that start in a text of a smaller id."""
    least = {}
    for i, t in texts:
        for p in range(len(t) - 49):
            w = t[p : p + 50]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if least[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        out.append(gone)
    return out


def check(spark, texts: dict[int, str]):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in suffixes.repeats(df).collect()}
    pairs = [(i, t.encode()) for i, t in texts.items()]
    for (i, t), gone in zip(pairs, brute(pairs), strict=True):
        r = got[i]
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i
    return got


def corpus(seed, n=60):
    rng = random.Random(seed)
    alphabet = ["the ", "of ", "thion ", "é", "ing ", "a", "\x00", "\n", "東"]
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [word(rng.randrange(20, 60)) for _ in range(8)]
    texts = {}
    for i in rng.sample(range(1000), n):
        parts = [rng.choice(passages)[rng.randrange(5) :] if rng.random() < 0.5 else word(rng.randrange(0, 40)) for _ in range(rng.randrange(0, 6))]
        texts[i] = "".join(parts)
        if rng.random() < 0.1:
            texts[i] = rng.choice("ab") * rng.randrange(40, 300)
        if rng.random() < 0.1 and len(texts) > 2:
            texts[i] = rng.choice(list(texts.values()))
    return texts


def test_as_brute_force(spark):
    for seed in range(4):
        got = check(spark, corpus(seed))
        assert sum(r.n_removed for r in got.values()) > 500


def test_many_runs_and_parts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "RUN_BYTES", 300)
    monkeypatch.setattr(suffixes, "PART", 128)
    check(spark, corpus(9, 120))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=0, max_size=6), max_size=12), min_size=1, max_size=9))
def test_loser_tree_merges(runs):
    rows = []
    for run in runs:
        k = np.zeros((len(run), suffixes.KEY), np.uint8)
        for i, x in enumerate(run):
            k[i, 30 : 30 + len(x)] = list(x)
        k[:, -1] = 20
        k = k[np.argsort(k.view(f"S{suffixes.KEY}").ravel(), kind="stable")] if len(run) else k
        rows.append(np.unique(k, axis=0) if len(run) else k)
    rows = [r for r in rows if len(r)]
    if not rows:
        return
    words, lcps = [], []
    for r in rows:
        lcp, tail = suffixes.front_code(r)
        back = suffixes.front_decode(np.frombuffer(lcp, np.uint8), tail)
        assert (back == r).all()
        wide = np.zeros((len(r), suffixes.WORDS * 8), np.uint8)
        wide[:, : suffixes.KEY] = r
        words.append(wide.view(">u8"))
        lcps.append((np.frombuffer(lcp, np.uint8) // 8).tolist())
    got = [bytes(rows[j][i]) for j, i in suffixes.merge(words, lcps)]
    assert got == sorted(bytes(x) for r in rows for x in r)


def test_remove_keeps_columns_and_characters(spark):
    passage = "é" * 15 + "".join(chr(300 + k) for k in range(60)) + "shared passage of some length, long enough to go"
    texts = [(1, "first " + passage + " one", "en", "p1"), (2, "second ü" + passage + " two", None, "p2"), (3, None, "de", None)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, run string")
    got = {r.doc_id: r for r in suffixes.remove(df).collect()}
    assert got[1].text == texts[0][1] and got[1].run == "p1" and got[3].text is None and got[3].lang == "de"
    assert got[2].text == "second ütwo"  # the space before one and two is shared too


def test_odd_rows(spark):
    rows = suffixes.repeats(odd_documents(spark)).collect()
    assert len(rows) == 10
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[6][0].n_removed == by[6][0].n_bytes and {r.n_removed for r in by[5]} == {0} and by[0][0].n_bytes == 0
    assert suffixes.repeats(empty_documents(spark)).count() == 0
    nulls = spark.createDataFrame([(None, "x" * 80), (1, "x" * 80), (None, "x" * 80)], "doc_id long, text string")
    assert {r.n_removed for r in suffixes.repeats(nulls).collect()} == {0}
    assert suffixes.remove(odd_documents(spark)).count() == 10
