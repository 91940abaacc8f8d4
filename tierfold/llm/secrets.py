"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Base kinds are ``assign`` (a credential name, ``:`` or ``=``, and a value of 12 or more characters), ``access``
(``AKIA`` keys of 18 or more) and ``hex`` (16 or more lower-case hex digits). The method adds ``token`` spans: a maximal
run of 16 or more credential characters, a letter among them, whose number of characters per token under a tiktoken
vocabulary is low, as a merge vocabulary learnt on text has no long pieces for random strings. Known digests, UUIDs, times
and identifiers built of short numbers and words that the vocabulary knows are left out, as are runs that overlap a base
span.

Null text: empty, no spans. Empty text: no spans. Very long texts: whole, in linear time. Repeated rows: each gives
its own row. Empty table: no rows. Further columns of the input are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tierfold.llm.common import map_rows, quoted, text_rows

KINDS = ("assign", "access", "hex", "token")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# A maximal run shorter than the least length holds no longer match, so the least length may stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LETTER = re.compile(r"[A-Za-z]")
RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")

UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"(?:(?:md5|sha1|sha256|sha384|sha512)[-=])?(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
INTEGRITY = re.compile(r"(?:sha256|sha384|sha512)-[A-Za-z0-9+/]+={0,2}")
# Pieces are possessive, as a long run of one class would otherwise be cut in exponentially many ways before it fails.
WORDS = re.compile(r"(?:[0-9]++|[A-Z]{2,}+|[A-Z](?=[a-z]{2})|[a-z]{2,}+)++")
TIME = re.compile(r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-]?[0-9]{2}[-.]?[0-9]{2}(?:[-.]?[0-9]{2}(?:\.[0-9]+)?)?Z?")
DEFAULT_RATIO = 2.0
#: Runs and parts shorter than this need a ratio lower by this factor, as few tokens tell less.
SHORT, SHORTER = 20, 0.9

Span = tuple[int, int, str, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind, value start, value end), in code points."""
    out: list[Span] = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 12:
            out.append((m.start(), m.end(), "assign", m.start(2), m.end(2)))
    out += [(m.start(), m.end(), "access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def limit(n: int, ratio: float) -> float:
    """The most characters a token at which a string of ``n`` characters counts as random."""
    return ratio if n >= SHORT else SHORTER * ratio


def is_identifier(run: str, n_tokens: Callable[[str], int], ratio: float) -> bool:
    """A digest, UUID, time, or words and short numbers joined by the usual marks, where the vocabulary knows the words."""
    if UUID.fullmatch(run) or DIGEST.fullmatch(run) or INTEGRITY.fullmatch(run) or TIME.fullmatch(run):
        return True
    parts = [p for p in re.split(r"[_./=+-]+", run) if len(p) > 2]
    if not all(WORDS.fullmatch(p) for p in parts):
        return False
    sizes = [(len(p), n_tokens(p)) for p in parts if not p.isdigit()]
    # Together, as a short word may have two tokens; and a long part by itself, as it may be random beside words.
    if any(n >= 16 and n / k <= limit(n, ratio) for n, k in sizes):
        return False
    chars = sum(n for n, _ in sizes)
    return not chars or chars / sum(k for _, k in sizes) > limit(chars, ratio)


def token_spans(text: str, n_tokens: Callable[[str], int], ratio: float, base: list[Span]) -> list[Span]:
    """Runs that look random and overlap no span of ``base``, which is in order of start; both are walked once."""
    out: list[Span] = []
    k, taken = 0, 0  # the base spans that begin before the run's end, and where the last of them ends
    for m in RUN.finditer(text):
        run, s, e = m.group(), m.start(), m.end()
        while k < len(base) and base[k][0] < e:
            taken = max(taken, base[k][1])
            k += 1
        if taken > s or not LETTER.search(run):
            continue
        if (e - s) / n_tokens(run) <= limit(e - s, ratio) and not is_identifier(run, n_tokens, ratio):
            out.append((s, e, "token", s, e))
    return out


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k, _, _ in spans)


def finder(vocabulary: str, pattern: str, ratio: float) -> Callable[[str], tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of a text. ``vocabulary``: path of a tiktoken rank file present on every executor."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def find(text: str) -> tuple[list[Span], list[Span]]:
        base = in_order(base_spans(text))
        return base, in_order(base + token_spans(text, lambda s: len(enc.encode_ordinary(s)), ratio, base))

    return find


def scan(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ratio: float = DEFAULT_RATIO) -> DataFrame:
    """One row per document: base spans, their counts, and all spans (arrays of kind, start, end). A map without shuffle."""

    def make():
        find = finder(vocabulary, pattern, ratio)

        def f(rows):
            out = {"doc_id": rows["doc_id"], "n_assign": [], "n_access": [], "n_hex": [], "n_token": [], "base_sha256": [], "spans": []}
            for text in rows["text"]:
                base, spans = find(text)
                for k in KINDS:
                    out[f"n_{k}"].append(sum(x[2] == k for x in spans))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
            return out

        return f

    return map_rows(text_rows(df, id_col, text_col), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_token long", make)


def redact_text(text: str, spans: list[Span], mark: str) -> str:
    out, at = [], 0
    for s, e in sorted((x[3], x[4]) for x in spans):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def redact(df: DataFrame, vocabulary: str, pattern: str, ratio: float = DEFAULT_RATIO, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """The rows of ``df`` with every secret's value replaced by ``mark``; other columns and clean texts stay as they are; a null text stays null."""
    columns = [f.name for f in df.schema.fields]
    schema = StructType([StructField(f.name, f.dataType) for f in df.schema.fields])

    def make():
        find = finder(vocabulary, pattern, ratio)

        def f(rows):
            rows[text_col] = [None if t is None else redact_text(t, spans, mark) if (spans := find(t)[1]) else t for t in rows[text_col]]
            return rows

        return f

    return map_rows(df.select([F.col(quoted(c)) for c in columns]), schema, make)
