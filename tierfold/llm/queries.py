"""One query per operator of the subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierfold.llm import additive, bpe, licences, packing, quality, secrets, simhash, suffixes, tiff, wrappers
from tierfold.llm.common import table

END_ID = 2


def vocabulary(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), *vocabulary("byte_bpe_50k.tiktoken"))


def op2_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return additive.search(rows, rows.where("vec_id % 100 = 0"), 10)


def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_features(table(spark, sf_dir, "documents"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents")).drop("starts", "ends")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path: source, language and id stand for one."""
    rows = table(spark, sf_dir, "documents")
    return licences.scan(rows, F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))


def op7_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *vocabulary("byte_bpe_multi_50k.tiktoken"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), *vocabulary("byte_bpe_50k.json"), END_ID))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_additive_ann, op3_tiff, op4_suffix_array, op5_simhash, op6_licence_scan, op7_wrapper_induction, op8_bpe, op9_quality, op10_best_fit_packing)}


def oracle_sql() -> dict[str, str]:
    return {}
