"""Parquet tables as raw points. A range of time is also given to the scan in the column's own type, which can be pushed down; a filter on the epoch can't."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_raw(rows: DataFrame, series: str | Column, time: str, value: str, arrival: str | Column, start: int | None = None, end: int | None = None) -> DataFrame:
    """(series_id, ts, value, arrival) of a table with a timestamp_ntz column, from ``start`` (inclusive) to ``end`` (exclusive)."""
    at = lambda t: F.lit(datetime.fromtimestamp(t, UTC).replace(tzinfo=None)).cast("timestamp_ntz")
    if start is not None:
        rows = rows.where(F.col(time) >= at(start))
    if end is not None:
        rows = rows.where(F.col(time) < at(end))
    s = F.col(series) if isinstance(series, str) else series
    a = F.col(arrival) if isinstance(arrival, str) else arrival
    return rows.select(s.cast("string").alias("series_id"), F.unix_timestamp(time).alias("ts"), F.col(value).alias("value"), a.cast("long").alias("arrival"))


def events(spark: SparkSession, folder: str, series: str = "event_type", start: int | None = None, end: int | None = None) -> DataFrame:
    return as_raw(table(spark, folder, "events"), series, "ts", "value", "event_id", start, end)


def lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return as_raw(table(spark, folder, "lineitem"), "l_returnflag", "l_shipdate", "l_quantity", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return as_raw(table(spark, folder, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")
