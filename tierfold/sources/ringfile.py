"""Binary ring files: read, dump, scan for corrupt ones, and write.

Layout (big-endian): method uint32, longest retention uint32, coverage factor float32, number of archives uint32; per
archive offset, seconds per point and points, uint32 each; then slots of (interval uint32, value float64). A slot whose
interval is 0 is empty. Files are read by Spark's binaryFile source, so that any store that Spark reaches will do.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tierfold.functions.columns import metric_name
from tierfold.functions.config import METHODS, CorruptFile, Ladder, Level, checked_method, stored_xff

# Fixed values of the format.
HEADER, ARCHIVE, SLOT = struct.Struct("!2LfL"), struct.Struct("!3L"), np.dtype([("interval", ">u4"), ("value", ">f8")])
NAMES = {code: name for name, code in METHODS.items()}


@dataclass(frozen=True)
class Header:
    method: str
    max_retention: int
    xff: float
    archives: tuple[tuple[int, Level], ...]  # offset and level


def read_header(content: bytes, path: str = "") -> Header:
    try:
        code, longest, xff, n = HEADER.unpack_from(content, 0)
        archives = [ARCHIVE.unpack_from(content, HEADER.size + k * ARCHIVE.size) for k in range(n)]
    except struct.error as e:
        raise CorruptFile("too short for its header", path) from e
    if code not in NAMES or not 0 <= xff <= 1:
        raise CorruptFile("no header of a ring file", path)
    return Header(NAMES[code], longest, xff, tuple((o, Level(s, p)) for o, s, p in archives))


def read_slots(content: bytes, header: Header, level: int, path: str = "") -> np.ndarray:
    """The slots of an archive in the file's order."""
    offset, x = header.archives[level]
    if offset + x.points * SLOT.itemsize > len(content):
        raise CorruptFile(f"too short for the slots of level {level}", path)
    return np.frombuffer(content, SLOT, x.points, offset)


def write_file(ladder: Ladder, method: str, xff: float, points: dict[int, list[tuple[int, float]]]) -> bytes:
    """A file with the points of each level; of those that share a slot the newest stays."""
    head = HEADER.pack(METHODS[checked_method(method)], ladder.max_retention, stored_xff(xff), len(ladder))
    offset = HEADER.size + len(ladder) * ARCHIVE.size
    body = []
    for k, x in enumerate(ladder.levels):
        head += ARCHIVE.pack(offset, x.step, x.points)
        ring = np.zeros(x.points, SLOT)
        rows = sorted(points.get(k, []))[-x.points :]
        # The base is what stands in slot 0: the first point goes there.
        for interval, value in rows:
            ring[(interval - rows[0][0]) // x.step % x.points] = (interval, value)
        body.append(ring.tobytes())
        offset += len(body[-1])
    return head + b"".join(body)


def series_name(path: str, root: str = "") -> Column:
    """The series of a file: its dotted path below ``root``."""
    return metric_name(F.regexp_replace(path, "^[a-z]+:/*", "/"), root)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def _decoded(files: DataFrame, schema: StructType, rows: callable) -> DataFrame:
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                table = rows(path, content)
                if table is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(table[f.name], f.type) for f in arrow], schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def read_headers(spark: SparkSession, path: str, pattern: str = "*.wsp", slots: bool = False) -> DataFrame:
    """(path, name, method, xff, max_retention, archives, error): one row a file, corrupt or not; with ``slots`` one that is cut short is corrupt too."""
    schema = StructType.fromDDL("path string, method string, xff float, max_retention long, archives array<struct<level: int, seconds_per_point: long, points: long, offset: long>>, error string")

    def rows(p, content):
        try:
            h = read_header(content, p)
            if slots:
                for k in range(len(h.archives)):
                    read_slots(content, h, k, p)
        except CorruptFile as e:
            return {"path": [p], "method": [None], "xff": [None], "max_retention": [None], "archives": [None], "error": [e.message]}
        archives = [{"level": k, "seconds_per_point": x.step, "points": x.points, "offset": o} for k, (o, x) in enumerate(h.archives)]
        return {"path": [p], "method": [h.method], "xff": [h.xff], "max_retention": [h.max_retention], "archives": [archives], "error": [None]}

    return _decoded(_files(spark, path, pattern), schema, rows).withColumn("name", metric_name("path"))


def corrupt_files(spark: SparkSession, path: str, pattern: str = "*.wsp", slots: bool = False) -> DataFrame:
    return read_headers(spark, path, pattern, slots).where("error is not null").select("path", "error")


def delete_files(paths: DataFrame) -> int:
    """Deletes the files of a column ``path``; how many there were."""
    spark = paths.sparkSession
    n = 0
    for r in paths.select("path").toLocalIterator():  # one by one: what is deleted is few, and the list isn't held
        path = spark._jvm.org.apache.hadoop.fs.Path(r.path)
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    return n


def dump(spark: SparkSession, path: str, pattern: str = "*.wsp", broken: str = "skip") -> DataFrame:
    """(path, level, slot, interval, value) of all slots as they lie in the files, empty ones too (interval 0). ``broken``: files that can't be read are left out (``corrupt_files`` has them), or ``raise``."""
    if broken not in ("skip", "raise"):
        raise ValueError(f"broken: skip or raise, not {broken}")
    schema = StructType.fromDDL("path string, level int, slot int, interval long, value double")

    def rows(p, content):
        try:
            h = read_header(content, p)
            rings = [read_slots(content, h, k, p) for k in range(len(h.archives))]
        except CorruptFile:
            if broken == "raise":
                raise
            return None
        n = [len(r) for r in rings]
        if not sum(n):
            return None
        return {
            "path": [p] * sum(n),
            "level": np.repeat(np.arange(len(n), dtype=np.int32), n),
            "slot": np.concatenate([np.arange(x, dtype=np.int32) for x in n]),
            "interval": np.concatenate([r["interval"].astype(np.int64) for r in rings]),
            "value": np.concatenate([r["value"].astype(np.float64) for r in rings]),
        }

    return _decoded(_files(spark, path, pattern), schema, rows)


def read_points(spark: SparkSession, path: str, root: str = "", pattern: str = "*.wsp", broken: str = "skip") -> DataFrame:
    """(series_id, level, interval, value) of the known slots; the series is the dotted path."""
    return dump(spark, path, pattern, broken).where(F.col("interval") > 0).select(series_name("path", root).alias("series_id"), "level", "interval", "value")


def to_files(state: DataFrame, ladder: Ladder, method: str, xff: float) -> DataFrame:
    """(series_id, content binary): a file for each series; one task holds one series at a time."""
    arrow = to_arrow_schema(StructType.fromDDL("series_id string, content binary"))

    def run(t: pa.Table) -> pa.Table:
        points: dict[int, list[tuple[int, float]]] = {}
        for k, i, v in zip(t["level"].to_pylist(), t["interval"].to_pylist(), t["value"].to_pylist(), strict=True):
            if v is not None:
                points.setdefault(k, []).append((i, v))
        return pa.Table.from_arrays([pa.array([t["series_id"][0].as_py()], pa.string()), pa.array([write_file(ladder, method, xff, points)], pa.binary())], schema=arrow)

    return state.groupBy("series_id").applyInArrow(run, "series_id string, content binary")
