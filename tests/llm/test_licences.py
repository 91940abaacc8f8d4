import math
import os.path
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from tests.llm.cases import empty_documents, odd_documents
from tierfold.llm import licences

ROWS = [
    (1, "a/LICENSE", licences.TEMPLATES["MIT"][0]),
    (2, "a/b/one.py", "# plain code\nx = 1"),
    (3, "a/b/c/COPYING", "Copyright 2020\n" + licences.TEMPLATES["GPL-3.0"][0].replace(": ", ":\n")),
    (4, "a/b/c/d/two.py", "nothing here"),
    (5, "a/b/c/three.py", "# " + licences.TEMPLATES["Apache-2.0"][0] + "\n\ncode " * 50),
    (6, "z/four.py", "free"),
    (7, "z/five.txt", "Some long text about the permission of things and a copyright, " * 30),
    (8, "z/six.txt", "word " * 100 + "\nLicensed under CC BY-NC 4.0."),
    (9, "z/seven.txt", "word " * 100 + "\nThis work is licensed under the GNU General Public License, version 3.\nmore"),
    (10, "z/eight.c", "// SPDX-License-Identifier: BSD-3-Clause\nint x;"),
    (11, None, "word\nReleased under the MIT License."),
]


def test_own_and_inherited(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, p string, text string")
    got = {r.doc_id: r for r in licences.scan(df, F.col("p")).collect()}
    assert {k: r.own_licence for k, r in got.items()} == {1: "MIT", 2: None, 3: "GPL-3.0", 4: None, 5: "Apache-2.0", 6: None, 7: None, 8: "CC-BY-NC-4.0", 9: "GPL-3.0", 10: "BSD-3-Clause", 11: "MIT"}
    assert (got[2].licence, got[2].inherited_from) == ("MIT", "a")
    assert (got[4].licence, got[4].inherited_from) == ("GPL-3.0", "a/b/c")
    assert got[5].inherited_from is None and got[6].licence == "MIT" and got[6].inherited_from == ""  # the file at the root


def test_odd_rows(spark):
    df = odd_documents(spark)
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    assert licences.scan(df, path).count() == 10
    assert licences.scan(empty_documents(spark), path).count() == 0


def test_passages_without_overlap():
    text = "a\nlicense one\nmore\n\nCopyright\n" + "x\n" * 40 + "\npermission"
    found = licences.passages(text)
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:])) and text[found[0][0] :].startswith("license one")
    assert licences.passages("") == [] and licences.passages("none") == []


def dense(rows):
    """Every window of every document against every template, with dense vectors; then every directory above it."""
    kinds = (licences.TEMPLATES, licences.BODIES)
    templates = [(body, name, t) for body, kind in enumerate(kinds) for name, ts in kind.items() for t in ts]

    def grams(t):
        w = re.findall(r"[a-z]+|\d+(?:\.\d+)*", t.lower())
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    vocabulary = sorted({g for *_, t in templates for g in grams(t)})
    found = [[text[s:e] for s, e in licences.passages(text or "")] for _, _, text in rows]
    total = sum(map(len, found))
    bags = [set(grams(p)) for ps in found for p in ps]
    idf = {g: 1 + math.log((1 + total) / (1 + sum(g in b for b in bags))) for g in vocabulary}
    other = sum(idf.values()) / len(idf)
    every = sorted(set(vocabulary) | {g for b in bags for g in b})
    at = {g: k for k, g in enumerate(every)}

    def vector(t):
        v = np.zeros(len(every))
        g = grams(t)
        for x in set(g):
            v[at[x]] = (1 + math.log(g.count(x))) * idf.get(x, other)
        return v / max(1e-300, np.linalg.norm(v))

    matrix = np.array([vector(t) for *_, t in templates])
    own, share = {}, {}
    for (doc, _, text), ps in zip(rows, found):
        hits, words = [], 0
        for p in ps:
            m = re.search(r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)", p)
            if m and m[1] in licences.TEMPLATES:
                hits.append((0, -1.0, m[1]))
            marks = np.zeros(len(p), bool)
            for a, b in licences.windows(p):
                cosine = matrix @ vector(p[a:b])
                for (body, name, _), c in zip(templates, cosine):
                    if c >= licences.LEAST:
                        hits.append((body, -c, name))
                        marks[a:b] = True
            words += len("".join(c if on else " " for c, on in zip(p, marks)).split())
        own[doc] = min(hits) if hits else None
        share[doc] = words / max(1, len((text or "").split()))
    where = {doc: os.path.dirname(path or "") for doc, path, _ in rows}
    given = {}
    for doc, path, _ in rows:
        if own[doc] and (share[doc] >= licences.FILE_SHARE or re.search(licences.FILE_NAME, path or "")):
            key = (-share[doc], own[doc][1], own[doc][2])
            given[where[doc]] = min(given.get(where[doc], key), key)
    out = {}
    for doc, _, _ in rows:
        above = where[doc]
        while above not in given and above:
            above = os.path.dirname(above)
        out[doc] = (own[doc][2] if own[doc] else given[above][2] if above in given else None, own[doc] and -own[doc][1])
    return out


def test_as_dense_cosine(spark):
    rng = random.Random(3)
    words = [w for ts in licences.TEMPLATES.values() for t in ts for w in t.split()] + ["the", "code", "of", "work", "may", "license"] * 30
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = []
    for i in range(160):
        lines = [say(rng.randrange(3, 15)) for _ in range(rng.randrange(1, 12))]
        if rng.random() < 0.5:
            kind = rng.choice((licences.TEMPLATES, licences.BODIES))
            t = rng.choice(kind[rng.choice(sorted(kind))]).split()
            for _ in range(rng.randrange(0, 8)):
                t[rng.randrange(len(t))] = rng.choice(words)
            lines.insert(rng.randrange(len(lines)), " ".join(t))
        rows.append((i, "/".join(rng.choice("ab") for _ in range(rng.randrange(0, 4))) + rng.choice(("/x.py", "/LICENSE")), rng.choice(("\n", "\n\n", ". ")).join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, p string, text string")
    want = dense(rows)
    assert sum(v[1] is not None for v in want.values()) > 40
    for bound in (1 << 20, 0):
        got = {r.doc_id: (r.licence, r.cosine) for r in licences.scan(df, F.col("p"), bound=bound).collect()}
        for k, (name, cosine) in want.items():
            assert got[k][0] == name and (cosine is None) == (got[k][1] is None) and (cosine is None or abs(cosine - got[k][1]) < 1e-9)


def test_ordinary_sentences_are_no_notices():
    m = licences.Matcher(dict.fromkeys(licences._vocabulary(), 1.0))
    for text in ("You may obtain a copy of the license for the work", "The driver lost his license for a year.", "All copyright of the picture is with the museum in the city.", "He gave permission to use the software in the school without further words."):
        assert m.of(text) == (None, 0.0)


def test_whole_licence_files_and_notices_in_long_lines():
    m = licences.Matcher(dict.fromkeys(licences._vocabulary(), 1.0))
    body = "\n".join(x for t in licences.BODIES["Apache-2.0"] for x in re.findall(r".{1,60}(?:\s|$)", t))
    found, share = m.of("Apache License Version 2.0, January 2004\n" + body)
    assert found[1] == "Apache-2.0" and share > 0.6
    assert m.of(body)[0][1] == "Apache-2.0"
    long = "word and more words of a text. " * 400
    assert m.of(long + "Released under the MIT License. " + long)[0][1] == "MIT"
    start = time.perf_counter()
    m.of("a license of words, " * 20_000)
    m.of("license\n" * 20_000)
    assert time.perf_counter() - start < 20
