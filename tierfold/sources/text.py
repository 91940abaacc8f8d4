"""Text forms of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_points(lines: DataFrame, now: int, series: str, column: str = "value", strict: bool = False) -> DataFrame:
    """'time:value' words of lines, 'N' for now, as raw points of one series; what can't be read is left out, or with ``strict`` an error."""
    words = lines.select(F.posexplode(F.split(F.trim(column), r"\s+")).alias("pos", "word")).withColumn("line", F.monotonically_increasing_id())
    at, value = F.substring_index("word", ":", 1), F.regexp_extract("word", "^[^:]*:(.*)$", 1)
    ts = F.when(at == "N", F.lit(now).cast("long")).otherwise(at.try_cast("double").cast("long"))
    out = words.select("word", F.lit(series).alias("series_id"), ts.alias("ts"), value.try_cast("double").alias("value"), F.col("line").alias("arrival"))
    known = F.col("ts").isNotNull() & F.col("value").isNotNull()
    if strict:
        known |= (F.col("word") != "") & F.raise_error(F.concat(F.lit("not of the form time:value: "), "word")).cast("boolean")
    return out.where(known).drop("word")
