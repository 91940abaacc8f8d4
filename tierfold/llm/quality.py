"""Quality classifier with hierarchical empirical Bayes.

A document's own evidence is the log-odds of a logistic regression on measures of its whole text. Sites have rates of
good documents at two levels, host and path; each is the mean of its documents' probabilities, shrunk towards the level
above by as many pseudo-documents as the spread among all sites of the level says (method of moments), so that sparse
sites fall back on their host and new hosts on the global rate. The posterior is the evidence with the site's rate, its
own share taken out, as prior.

Only the regression is fitted on a sample: at most ``SAMPLE`` labelled documents, those of the least hash of their ids.
Rates cover all documents; they are sums grouped with map-side combining, and a host with a third of all rows is one row
per task. The site table is joined, not collected (by broadcast if it is small, else with hot sites salted); the numbers
that reach the driver are a dozen.

Null or empty text: no evidence, the site's rate decides. Null host or path: a site of its own, ''. Very long texts:
whole. No labels, or of one kind: evidence zero. Repeated rows: a row each, alike. Empty table: no rows. Further columns are
ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tierfold.llm.common import BROADCAST, cut, map_rows, meet, quoted

SAMPLE = 8192
#: Documents with a lower probability of being good are rejected.
KEEP = 0.5
#: Evidence beyond this many nats counts as this much.
MOST = 12.0

_MARKS = re.compile(r"[^\w\s.,;:'’\"()-]")
_MARK_RUNS = re.compile(r"[^\w\s]{2,}")
_DIGITS = re.compile(r"\d")

N_FEATURES = 12


def features(text: str) -> list[float]:
    """Measures of a whole text, all but the first between 0 and 1."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    chars = len(text)
    return [
        log(1 + n),
        sum(map(str.__eq__, words, words[1:])) / n,
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        len(_MARKS.findall(text)) / chars,
        min(1.0, len(_MARK_RUNS.findall(text)) / n),
        sum(map(str.isupper, words)) / n,
        sum(c for w, c in counts.items() if len(w) == 1 and not w.isalnum()) / n,
        min(1.0, sum(map(len, counts)) / len(counts) / 30),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        len(_DIGITS.findall(text)) / chars,
        min(1.0, (text.count("|") + text.count("{") + text.count("<") + text.count("\\")) / n),
    ]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (constant first), means and deviations of a ridge logistic regression, by Newton steps."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 1e-9, sd, 1.0)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / sd])
    w = np.zeros(z.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, sd


def evidence_of(model) -> Callable[[str], float]:
    """Log-odds of a text, without the labelled sample's share of good documents."""
    if model is None:
        return lambda text: 0.0
    (w, mean, sd), base = model
    scale = w[1:] / sd
    constant = w[0] - float(mean @ scale) - base

    def f(text: str) -> float:
        if not text.strip():
            return 0.0
        return max(-MOST, min(MOST, constant + float(np.dot(features(text), scale))))

    return f


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE):
    """The model, from at most ``sample`` labelled documents, and their share of good ones; None without both kinds."""
    chosen = labels.select(labels[id_col].cast("long").alias("k"), labels[label_col].cast("int").alias("y")).where("k is not null and y in (0, 1)").dropDuplicates(["k"]).orderBy(F.xxhash64("k"), "k").limit(sample)
    docs = df.select(df[id_col].cast("long").alias("k"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    told = docs.join(F.broadcast(chosen), "k")  # at most ``sample`` rows of two numbers

    def make():
        return lambda rows: {"k": rows["k"], "y": rows["y"], "x": [features(t) for t in rows["text"]]}

    rows = map_rows(told, "k long, y int, x array<double>", make).dropDuplicates(["k"]).orderBy("k").collect()
    y = np.array([r.y for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.array([r.x for r in rows]), y), float(np.log(y.mean() / (1 - y.mean())))


def with_evidence(df: DataFrame, model, text_col: str, columns: list[Column], name: str) -> DataFrame:
    """``columns``, and the evidence of each row's text under ``name``."""
    chosen = df.select(*columns, F.coalesce(df[text_col].cast("string"), F.lit("")).alias(f"{name}_text"))
    fields = [f for f in chosen.schema.fields if f.name != f"{name}_text"]

    def make():
        f = evidence_of(model)

        def run(rows):
            return {x.name: rows[x.name] for x in fields} | {name: [f(t) for t in rows[f"{name}_text"]]}

        return run

    return map_rows(chosen, StructType([*(StructField(x.name, x.dataType) for x in fields), StructField(name, DoubleType())]), make)


def _strength(rates: DataFrame, n: str, s: str) -> tuple[float, float]:
    """Mean rate of a level's sites and pseudo-documents of the level above, from their spread: Beta by moments."""
    p = F.col(s) / F.col(n)
    r = rates.agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.count("*").alias("k"), F.sum(F.col(n) * p * p).alias("q"), F.sum(F.col(n) * F.col(n)).alias("nn")).first()
    if not r.n:
        return 0.5, 1.0
    mean = min(1 - 1e-4, max(1e-4, r.s / r.n))
    if r.k < 2:
        return mean, 100.0
    between = r.q - r.n * mean * mean - (r.k - 1) * mean * (1 - mean)
    spread = max(0.0, between) / max(1e-9, r.n - r.nn / r.n)
    return mean, float(min(1e6, max(1.0, mean * (1 - mean) / spread - 1))) if spread > 1e-9 else 1e6


def posterior(scored: DataFrame, bound: int = BROADCAST) -> DataFrame:
    """(host, path, evidence, ...) rows with the posterior; host and path aren't null."""
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n_path"), F.sum(p).alias("s_path")))
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"))
    rate, above_host = _strength(hosts, "n_host", "s_host")
    _, above_path = _strength(paths, "n_path", "s_path")
    sites = paths.join(hosts, "host").select("host", "path", "n_path", "s_path", "n_host", "s_host")
    host_rate = (F.col("s_host") - p + above_host * rate) / (F.col("n_host") - 1 + above_host)
    path_rate = (F.col("s_path") - p + above_path * host_rate) / (F.col("n_path") - 1 + above_path)
    prior = F.least(F.lit(1 - 1e-4), F.greatest(F.lit(1e-4), path_rate))
    return meet(scored, sites, ["host", "path"], ["host", "path"], bound).withColumn("posterior", 1 / (1 + F.exp(-(F.col("evidence") + F.log(prior / (1 - prior))))))


def score(df: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """(doc_id, evidence, posterior, keep) of every row."""
    model = train(df, labels, id_col, text_col)
    site = [F.coalesce(df[host_col].cast("string"), F.lit("")).alias("host"), F.coalesce(df[path_col].cast("string"), F.lit("")).alias("path")]
    scored = cut(with_evidence(df, model, text_col, [df[id_col].cast("long").alias("doc_id"), *site], "evidence"))
    return posterior(scored).select("doc_id", "evidence", "posterior", (F.col("posterior") >= keep).cast("int").alias("keep"))


def keep_good(df: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of ``df`` that aren't rejected, with the columns of ``df``."""
    model = train(df, labels, id_col, text_col)
    site = [F.coalesce(df[host_col].cast("string"), F.lit("")).alias("host"), F.coalesce(df[path_col].cast("string"), F.lit("")).alias("path")]
    rows = F.struct(*[df[quoted(c)].alias(f"c{k}") for k, c in enumerate(df.columns)]).alias("row")
    scored = cut(with_evidence(df, model, text_col, [rows, *site], "evidence"))  # rates and decisions both read it
    good = posterior(scored).where(F.col("posterior") >= keep)
    return good.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(df.columns)])
