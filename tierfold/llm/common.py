"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tierfold.sources.shared import settle as cut
from tierfold.sources.shared import shared_folder as shared_dir

__all__ = ["cut", "lean", "map_rows", "meet", "modest", "quoted", "schema_of", "shared_dir", "table", "text_rows", "weight"]

#: Rows that a Python function sees at once; with the 64 MB that Spark puts in an Arrow batch at most.
STEP = 1024
#: A table is broadcast up to so many bytes.
BROADCAST = 32 << 20


def modest(spark: SparkSession) -> SparkSession:
    """Arrow batches of whole texts as small as ``map_rows`` takes them, where the session has Spark's default: larger ones only take memory."""
    name, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name) == default:
        spark.conf.set(name, str(STEP))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", binary: bool = False) -> DataFrame:
    """(doc_id long, text) of a table with any further columns; a null text is empty."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    return df.select(df[id_col].cast("long").alias("doc_id"), (text.cast("binary") if binary else text).alias("text"))


def quoted(name: str) -> str:
    """A column's name as ``col`` takes it whole."""
    return "`" + name.replace("`", "``") + "`"


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


#: What a worker process keeps between tasks, by module: how to let go of it.
_kept: dict[str, Callable[[], None]] = {}


def keeps(module: str, clear: Callable[[], None]) -> None:
    """A module's caches live on in a worker until a task of another module begins there; ``clear`` empties them."""
    _kept[module] = clear


def _enter(module: str) -> None:
    for other in [m for m in _kept if m != module]:
        _kept.pop(other)()
    give_back()


def give_back() -> None:
    """Memory that is free in this process goes back to the system, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, ddl: str | StructType, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """mapInArrow over columns as lists: ``make`` is called once a task and gives the function of a batch. Names may hold any characters."""
    schema = schema_of(ddl) if isinstance(ddl, str) else ddl
    names = df.columns
    plain = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(schema.fields)])
    arrow = to_arrow_schema(plain)
    fields = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _enter(make.__module__)
        f = make()
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                out = f({name: c.to_pylist() for name, c in zip(names, whole.slice(at, STEP).columns, strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array(out[name], x.type) for name, x in zip(fields, arrow, strict=True)], schema=arrow)
        give_back()

    return df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(run, plain).toDF(*fields)


def lean(settled: DataFrame) -> DataFrame:
    """A settled table read by few tasks: enough to count it, as each task costs files and lines of the log."""
    return settled.coalesce(max(32, settled.sparkSession.sparkContext.defaultParallelism))


def weight(df: DataFrame, columns: list[str]) -> int:
    """About the bytes of a table whose long columns are these."""
    return df.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(64)))).first()[0] or 0


def meet(rows: DataFrame, model: DataFrame, keys: list[str], weigh: list[str], bound: int = BROADCAST) -> DataFrame:
    """``rows`` with the row of ``model`` that has their keys, if any: by broadcast up to ``bound`` bytes, measured, else by a join in which keys with over a thousandth of all rows are dealt to salts."""
    if weight(model, weigh) <= bound:
        return rows.join(F.broadcast(model), keys, "left")
    counts = cut(rows.groupBy(*keys).agg(F.count("*").alias("key_rows")))
    total = counts.agg(F.sum("key_rows")).first()[0] or 0
    large = F.broadcast(counts.where(F.col("key_rows") * 1024 > total).select(*keys, F.lit(64).alias("salts")))  # at most 1,024 keys
    salts = F.coalesce("salts", F.lit(1))
    dealt = rows.join(large, keys, "left").withColumn("salt", F.pmod(F.xxhash64(*[F.col(quoted(c)) for c in rows.columns if c not in keys]), salts).cast("int")).drop("salts")
    each = model.join(large, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(each, [*keys, "salt"], "left").drop("salt")
