"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Lines are cut into sentences. A sentence with a licence word, and what follows it up to a blank line, is a passage. Of a passage
the windows of 1, 2, 3, 6 and 12 sentences from each licence word on, and each 12 in turn to its end, are compared with the templates, so no
length of text keeps a notice from being found, and all of a licence file is weighed. Windows and templates are sparse
vectors of words and word pairs with TF-IDF weights; the weights count, over all passages of all documents, how many hold
a term (the vocabulary is the templates', so the counts are a small table; other words weigh as the vocabulary's do on average, and lower
the cosine). A document has the licence of its best window if the cosine reaches ``LEAST``, notices before paragraphs of licence bodies. A document
that is mostly licence text, or has a licence file's name, is the licence file of its directory; documents without a licence of their own take that of the nearest directory above them.

Directories are resolved once each: their ancestors are exploded (as many as the path is deep) and joined with the
licensed directories. Documents then meet their own directory's answer by broadcast if these are few, else in a join with
hot directories salted.

Null or empty text: no licence of its own. Null path: the root directory. Very long texts: whole. Ties: the better
cosine, then the name's order; among licence files of a directory the larger share, then those. Repeated rows: a row
each. Empty table: no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierfold.llm.common import BROADCAST, cut, map_rows, meet

LEAST = 0.55
#: A document with at least this share of its words in licence passages is a licence file.
FILE_SHARE = 0.5
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|unlicense)[^/]*$"
#: Sentences of a window.
WINDOWS = (1, 2, 3, 6, 12)

# Notices of common licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "licensed under the GNU Affero General Public License, version 3",
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal public domain dedication",),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License."),
    "LGPL-3.0": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "licensed under the GNU Lesser General Public License, version 3",
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE file in the project root for full license information.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, version 2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",),
}

# Paragraphs of licence bodies, which licence files hold after their heads.
BODIES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Redistribution. You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions",
        'Disclaimer of Warranty. Unless required by applicable law or agreed to in writing, Licensor provides the Work (and each Contributor provides its Contributions) on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    ),
    "BSD-3-Clause": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "GPL-3.0": ("The GNU General Public License is a free, copyleft license for software and other kinds of works.", "The licenses for most software and other practical works are designed to take away your freedom to share and change the works."),
    "MIT": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ),
    "Unlicense": ("In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",),
}

SPDX = re.compile(r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)")
TRIGGER = re.compile(r"licen[sc]|copyright|permission|redistribut|spdx|public domain|warrant", re.I)
WORD = re.compile(r"[a-z]+|\d+(?:\.\d+)*")
#: A sentence, or a line that ends before it does.
SENTENCE = re.compile(r"[^\n.;:!?]*(?:[.;:!?](?!\s)[^\n.;:!?]*)*(?:[.;:!?][^\S\n]*\n?|\n|\Z)")
BLANK = re.compile(r"\n[^\S\n]*(?=\n)")


def terms(passage: str) -> Counter[str]:
    words = WORD.findall(passage.lower())
    return Counter(words) + Counter(map(" ".join, zip(words, words[1:])))


def passages(text: str) -> list[tuple[int, int]]:
    """(start, end) of paragraphs from the first line with a licence word on."""
    out: list[tuple[int, int]] = []
    at = 0
    while m := TRIGGER.search(text, at):
        start = max(at, text.rfind("\n", at, m.start()) + 1)
        stop = BLANK.search(text, m.end())
        at = stop.end() if stop else len(text)
        out.append((start, at))
    return out


def windows(passage: str) -> list[tuple[int, int]]:
    """(start, end) in a passage of what is compared with the templates."""
    ends = [m.end() for m in SENTENCE.finditer(passage) if m.end() > m.start()]
    starts = [0, *ends[:-1]]
    n = len(ends)
    found = [(k, min(n, k + w)) for k in range(n) if TRIGGER.search(passage, starts[k], ends[k]) for w in WINDOWS]
    found += [(k, min(n, k + WINDOWS[-1])) for k in range(0, n, WINDOWS[-1])]
    return [(starts[a], ends[b - 1]) for a, b in dict.fromkeys(found)]


def _vocabulary() -> dict[str, int]:
    return {t: k for k, t in enumerate(sorted({t for kind in (TEMPLATES, BODIES) for ts in kind.values() for x in ts for t in terms(x)}))}


class Matcher:
    """Cosine of windows to templates. idf: by term of the vocabulary."""

    def __init__(self, idf: dict[str, float]):
        self.idf = idf
        self.other = sum(idf.values()) / max(1, len(idf))
        self.post: dict[str, list[tuple[int, float]]] = {}
        #: A template's licence, and whether it is of a body.
        self.names: list[tuple[bool, str]] = []
        for body, kind in ((False, TEMPLATES), (True, BODIES)):
            for name in sorted(kind):
                for t in kind[name]:
                    for term, w in self.vector(terms(t)).items():
                        self.post.setdefault(term, []).append((len(self.names), w))
                    self.names.append((body, name))

    def vector(self, counts: Counter[str]) -> dict[str, float]:
        v = {t: (1 + log(n)) * self.idf.get(t, self.other) for t, n in counts.items()}
        norm = sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    def best(self, window: str) -> tuple[bool, float, str] | None:
        """(of a body, cosine, licence) of the best template, notices and bodies each by cosine and then name; the notice if it reaches ``LEAST``."""
        score: dict[int, float] = {}
        for t, w in self.vector(terms(window)).items():
            for k, x in self.post.get(t, ()):
                score[k] = score.get(k, 0.0) + w * x
        found = [(s < LEAST, self.names[k][0], -s, self.names[k][1]) for k, s in score.items()]
        if not found:
            return None
        _, body, s, name = min(found)
        return body, -s, name

    def of(self, text: str) -> tuple[tuple[float, str] | None, float]:
        """A text's licence with its cosine, and the share of its words in windows that are licence text."""
        found: list[tuple[bool, float, str]] = []
        covered = 0
        for s, e in passages(text):
            passage = text[s:e]
            m = SPDX.search(passage)
            name = m.group(1).removesuffix("-only").removesuffix("-or-later") if m else None
            if name in TEMPLATES:
                found.append((False, -1.0, name))
            parts = []
            for a, b in windows(passage):
                best = self.best(passage[a:b])
                if best and best[1] >= LEAST:
                    found.append((best[0], -best[1], best[2]))
                    parts.append((a, b))
            at = 0
            for a, b in sorted(parts):
                if b > at:
                    covered += len(passage[max(a, at) : b].split())
                    at = b
        if not found:
            return None, 0.0
        _, cosine, name = min(found)
        return (-cosine, name), covered / max(1, len(text.split()))


def weights(texts: DataFrame) -> dict[str, float]:
    """Inverse frequencies of the vocabulary's terms among all passages of all documents."""
    vocabulary = _vocabulary()

    def make():
        def f(rows):
            n, counts = 0, Counter()
            for t in rows["text"]:
                for s, e in passages(t):
                    n += 1
                    counts.update(x for x in terms(t[s:e]) if x in vocabulary)
            return {"term": ["", *counts], "n": [n, *counts.values()]}

        return f

    rows = map_rows(texts.select("text"), "term string, n long", make).groupBy("term").agg(F.sum("n").alias("n")).collect()  # no more than the vocabulary
    counts = {r.term: r.n for r in rows}
    total = counts.pop("", 0)
    return {t: 1 + log((1 + total) / (1 + counts.get(t, 0))) for t in vocabulary}


def scan(df: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", bound: int = BROADCAST) -> DataFrame:
    """(doc_id, path, own_licence, cosine, licence, inherited_from) of every row."""
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    idf = weights(rows)

    def make():
        m = Matcher(idf)

        def f(rows):
            out = {"doc_id": rows["doc_id"], "path": rows["path"], "own_licence": [], "cosine": [], "share": []}
            for t in rows["text"]:
                found, share = m.of(t)
                out["own_licence"].append(found[1] if found else None)
                out["cosine"].append(found[0] if found else None)
                out["share"].append(share)
            return out

        return f

    own = cut(map_rows(rows, "doc_id long, path string, own_licence string, cosine double, share double", make).withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)))
    files = own.where(F.col("own_licence").isNotNull() & ((F.col("share") >= FILE_SHARE) | F.col("path").rlike(FILE_NAME)))
    licensed = files.groupBy("dir").agg(F.min(F.struct((-F.col("share")).alias("a"), (-F.col("cosine")).alias("b"), F.col("own_licence").alias("licence"))).alias("m")).select(F.col("dir").alias("above"), F.col("m.licence").alias("given"))
    # 'a/b/c' lies in itself, 'a/b', 'a' and the root ''.
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    dirs = own.select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("above"))
    nearest = cut(dirs.join(licensed, "above").groupBy("dir").agg(F.max_by(F.struct("above", "given"), F.length("above")).alias("m")).select("dir", F.col("m.above").alias("above"), F.col("m.given").alias("given")))
    out = meet(own, nearest, ["dir"], ["dir", "above"], bound)
    return out.select("doc_id", "path", "own_licence", "cosine", F.coalesce("own_licence", "given").alias("licence"), F.when(F.col("own_licence").isNull(), F.col("above")).alias("inherited_from"))
