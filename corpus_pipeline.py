"""A corpus pipeline: quality classifier, SimHash near-dedup, suffix-array dedup, secret scans, best-fit packing.

Each stage is (name, function of (spark, docs, sf_dir)) and works on all that the stage before kept; all but the last
return the columns of ``documents``. ``run`` applies them to a table, writing and rereading Parquet between stages in
the folder that driver and executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierfold.llm import copies, packing, quality, secrets, suffixes
from tierfold.llm.common import modest, shared_dir, table
from tierfold.llm.queries import END_ID, vocabulary
from tierfold.sources.shared import findable


def _columns(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text now has."""
    return df.select([F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in df.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return copies.keep_one(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document with a smaller id has go from the others."""
    return _columns(suffixes.remove(docs))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are struck out."""
    return _columns(secrets.redact(docs, *vocabulary("byte_bpe_50k.tiktoken")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1,024."""
    return packing.pack(packing.pieces(docs, *vocabulary("byte_bpe_50k.json"), END_ID))


def _stage(f):
    return lambda spark, docs, sf_dir: f(modest(findable(spark)), docs, sf_dir)


STAGES = [
    ("quality classifier", _stage(quality_stage)),
    ("SimHash near-dedup", _stage(near_dedup_stage)),
    ("suffix-array dedup", _stage(substring_dedup_stage)),
    ("secret scans", _stage(secrets_stage)),
    ("best-fit packing", _stage(packing_stage)),
]

#: Stages run tokenizers, suffix sorts and a fitted classifier, which SQL doesn't express; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage has read is deleted once its own rows are written."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
