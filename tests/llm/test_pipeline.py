import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tests.llm.test_copies import brute_groups
from tests.llm.test_suffixes import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LABEL_N = 150


def corpus(seed=3, n=260):
    rng = random.Random(seed)
    words = ["the", "of", "thion", "erre", "éa", "ingly", "stand", "hare", "ouen", "東京"]
    word = lambda: rng.choice(words) + rng.choice(["", "ed", "er", str(rng.randrange(40))])
    passage = " ".join(word() for _ in range(60))
    texts, junk = {}, set()
    for i in range(n):
        w = [word() for _ in range(rng.randrange(30, 140))]
        kind = rng.random()
        if kind < 0.15:
            junk.add(i)
            w = [x + "###" for x in w] if i % 2 else [w[0]] * len(w)
        elif kind < 0.3 and i > 20:
            w = texts[rng.choice([k for k in texts if k not in junk])].split(" ")
            w[rng.randrange(len(w))] = "changed"
        elif kind < 0.45:
            w[5:5] = passage.split(" ")
        elif kind < 0.55:
            w[3:3] = ["token", "=", '"' + hashlib.sha1(str(i).encode()).hexdigest() + '"']
        texts[i] = " ".join(w)
    return texts, junk


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    texts, junk = corpus()
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i not in junk), 0) for i in list(texts)[:LABEL_N]], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_as_brute_force(spark, folder):
    texts, junk = corpus()
    docs, steps = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        steps.append(docs)
    assert all(d.columns == COLUMNS for d in steps[:-1])
    now = {r.doc_id: r.text for r in steps[0].collect()}
    assert set(now) == set(texts) - junk  # the kinds are easy to tell
    groups = brute_groups(now)
    now = {i: t for i, t in now.items() if groups[i] == i}
    assert {r.doc_id: r.text for r in steps[1].collect()} == now
    pairs = [(i, t.encode()) for i, t in sorted(now.items())]
    for (i, t), gone in zip(pairs, brute(pairs), strict=True):
        b = np.frombuffer(t, np.uint8)
        # A character goes if all its bytes go.
        starts = [k for k in range(len(b)) if b[k] & 0xC0 != 0x80] + [len(b)]
        now[i] = b"".join(t[s:e] for s, e in zip(starts, starts[1:]) if not gone[s:e].all()).decode()
    got = {r.doc_id: r for r in steps[2].collect()}
    assert {i: r.text for i, r in got.items()} == now and all(r.n_chars == len(r.text) for r in got.values())
    now = {i: re.sub(r'(token = ")[0-9a-f]{40}"', r'\1[REDACTED]"', t) for i, t in now.items()}
    now = {i: re.sub(r"[0-9a-f]{16,}", "[REDACTED]", t) for i, t in now.items()}
    assert {r.doc_id: r.text for r in steps[3].collect()} == now
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = steps[4].collect()
    assert sum(r.length for r in rows) == sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in now.values())
    assert {r.doc_id for r in rows} == set(now)


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 100
    assert "pipeline" in __spark_entry__.queries() and "pipeline" not in __spark_entry__.oracle_sql()
