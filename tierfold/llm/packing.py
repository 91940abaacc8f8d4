"""Best-fit packing of token sequences with a bounded number of open bins.

Documents become pieces of at most ``capacity`` tokens; only longer ones are cut, the first piece taking what is left
over. The lengths alone are then dealt evenly to packers of some ten thousand pieces, each of which streams them, in the
order of a hash, into its open bins: a bitset keyed by free space gives the tightest bin that fits; if none fits and the
number of open bins is at its bound, the fullest is closed. The stream is read ``ahead`` pieces at a time, and of these the longest
come first: so the short ones find the room that the long ones leave. What a packer holds is bounded by its pieces and its open bins; the
number of packers grows with the table. Rows are dealt by their place in the table, not by what they hold, so that copies of a row don't meet in one packer.

Null text: empty, that is the end token alone. Empty text: likewise. Very long texts: whole, in many pieces. Ties:
the order of the stream. Repeated rows: packed each. Empty table: no rows. Further columns are ignored.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tierfold.llm.bpe import Known, rarely_collect
from tierfold.llm.common import cut, keeps, map_rows, schema_of, text_rows

CAPACITY = 1024
#: Bins that are open at a time, and pieces that are read ahead.
OPEN_BINS, AHEAD = 512, 1024
#: Pieces shorter than the capacity that one packer gets, on average.
PACKER = 65536
CACHE = 700_000


class Ids:
    """Ids of a text as little-endian unsigned 32-bit bytes, by a ``tokenizers`` file with a byte-level BPE model.

    The text is split by ``pattern``, as the file's own pre-tokenizer does; each distinct pre-token goes through the
    file's model once while it stays in the cache. Strings of special tokens are ordinary text.
    """

    def __init__(self, vocabulary: str, pattern: str, cache: int = CACHE):
        import regex
        from tokenizers import Tokenizer

        with open(vocabulary) as f:
            pre = json.load(f)["pre_tokenizer"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{vocabulary}: a byte-level pre-tokenizer without prefix space is needed")
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are taken as they lie in memory: little-endian numbers of 4 bytes")
        self.model = Tokenizer.from_file(vocabulary).model
        # Fixed values of the format: bytes that print stand for themselves, the others for code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.split = regex.compile(pattern).findall
        self.known = Known(self.encode, cache)

    def encode(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.split(text)))


_made: dict[tuple[str, str], Ids] = {}


def ids_of(vocabulary: str, pattern: str) -> Ids:
    key = (vocabulary, pattern)
    if key not in _made:
        _made[key] = Ids(vocabulary, pattern)
        rarely_collect()
        keeps(__name__, _made.clear)
    return _made[key]


def pieces(df: DataFrame, vocabulary: str, pattern: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32); a map without shuffle."""

    def make():
        ids, end = ids_of(vocabulary, pattern), end_id.to_bytes(4, "little")

        def f(rows):
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
                data = ids(text) + end
                n = len(data) // 4
                lengths = [n % capacity] * bool(n % capacity) + [capacity] * (n // capacity)
                start = 0
                for k, length in enumerate(lengths):
                    for name, v in zip(out, (doc, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])), strict=True):
                        out[name].append(v)
                    start += length
            return out

        return f

    return map_rows(text_rows(df, id_col, text_col), "doc_id long, piece int, start long, length long, ids_crc32 long", make)


def best_fit(lengths: Iterable[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """The bin and the offset of each length, in order."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = n_open = n_bins = 0
    bins, offsets = [], []
    for length in lengths:
        fit = bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                bits ^= 1 << free
        else:
            if n_open >= open_bins:  # the fullest closes
                least = (bits & -bits).bit_length() - 1
                by_free[least].pop()
                if not by_free[least]:
                    bits ^= 1 << least
                n_open -= 1
            b, free = n_bins, capacity
            n_bins += 1
            n_open += 1
        bins.append(b)
        offsets.append(capacity - free)
        free -= length
        if free:
            by_free[free].append(b)
            bits |= 1 << free
        else:
            n_open -= 1
    return bins, offsets


def in_windows(lengths: np.ndarray, ahead: int) -> np.ndarray:
    """Places of a stream in the order in which it is packed: of each ``ahead`` pieces the longest first."""
    return np.lexsort((np.arange(len(lengths)), -lengths, np.arange(len(lengths)) // ahead))


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, packer: int = PACKER, ahead: int = AHEAD) -> DataFrame:
    """``pieces`` with sequence_id and offset. The pieces are checkpointed: they are counted, then dealt by their place in the checkpoint, which stays the same if a task is run again."""
    pieces = cut(pieces)
    n = pieces.where(F.col("length") < capacity).count()
    packers = max(1, -(-n // packer))
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    arrow = to_arrow_schema(schema_of(ddl))
    # Whole sequences need no packer; their numbers lie below zero.
    whole = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.withColumn("place", F.xxhash64(F.monotonically_increasing_id())).where(F.col("length") < capacity).withColumn("packer", F.pmod("place", F.lit(packers)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        t = t.take(pa.array(in_windows(t["length"].to_numpy(), ahead)))
        bins, offsets = best_fit(t["length"].to_pylist(), capacity, open_bins)
        p = t["packer"][0].as_py()
        return t.drop_columns(["packer", "place"]).append_column("sequence_id", pa.array([b * packers + p for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64())).cast(arrow)

    return rest.groupBy("packer").applyInArrow(run, ddl).unionByName(whole)
