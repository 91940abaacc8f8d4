"""Configuration of many series at once: rules by name, drift, estimates, bulk validity and transforms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tierfold.functions.columns import byte_format


@dataclass(frozen=True)
class Rule:
    """A pattern, found anywhere in a name, and what it gives. The first that matches wins."""

    pattern: str
    retentions: str | None = None
    xff: float | None = None
    method: str | None = None


def first_match(name: str | Column, rules: list[Rule], default: int | None = None) -> Column:
    """The number of the first rule that matches, as one expression; no join, however many series."""
    n = F.col(name) if isinstance(name, str) else name
    out = F.lit(default).cast("int")
    for k in reversed(range(len(rules))):
        out = F.when(n.rlike(rules[k].pattern), F.lit(k)).otherwise(out)
    return out


def _given(number: Column, rules: list[Rule], field: str, kind: str, default) -> Column:
    values = F.array(*[F.lit(getattr(r, field)).cast(kind) for r in rules]) if rules else F.array(F.lit(None).cast(kind))
    return F.coalesce(F.try_element_at(values, number + 1), F.lit(default).cast(kind))


def apply_rules(series: DataFrame, storage: list[Rule], aggregation: list[Rule], name: str = "name", default_retentions: str = "1m:7d", default_xff: float = 0.5, default_method: str = "average") -> DataFrame:
    """``series`` with rule, retentions, xff and method."""
    s, a = first_match(name, storage), first_match(name, aggregation)
    return (
        series.withColumn("rule", s)
        .withColumn("retentions", _given(s, storage, "retentions", "string", default_retentions))
        .withColumn("xff", _given(a, aggregation, "xff", "double", default_xff))
        .withColumn("method", _given(a, aggregation, "method", "string", default_method))
    )


def drift(current: DataFrame, wanted: DataFrame, key: str = "series_id") -> DataFrame:
    """Series whose retentions, coverage factor at two decimals, or method aren't as wanted, with both."""
    c = current.select(key, *[F.col(x).alias(f"current_{x}") for x in ("retentions", "xff", "method")])
    two = lambda x: F.format_string("%.2f", F.col(x).cast("double"))
    return c.join(wanted.select(key, "retentions", "xff", "method"), key).where((F.col("current_retentions") != F.col("retentions")) | (two("current_xff") != two("xff")) | (F.col("current_method") != F.col("method")))


def estimate(archives: DataFrame, key: str = "schema_id", counts: tuple[int, ...] = (1, 5, 10, 50, 100, 500)) -> DataFrame:
    """(key, metrics, bytes, disk_bytes, size) of ring files, for some thousands of metrics each."""
    n = F.lit(16) + 12 * F.count("*") + 12 * F.sum("points")
    one = archives.groupBy(key).agg(n.cast("long").alias("bytes")).withColumn("disk", F.ceil(F.col("bytes") / 4096) * 4096)
    out = one.withColumn("metrics", F.explode(F.array(F.lit(1).cast("long"), *[F.lit(1000 * c).cast("long") for c in counts])))
    total = F.col("disk") * F.col("metrics")
    return out.select(key, "metrics", (F.col("bytes") * F.col("metrics")).alias("bytes"), total.alias("disk_bytes"), byte_format(total).alias("size"))


def check_archives(archives: DataFrame, key: str = "schema_id") -> DataFrame:
    """(key, problem) of archive lists that aren't ladders; one row per list, its first problem by level."""
    by = W.partitionBy(key).orderBy("seconds_per_point", "points")
    spp, pts = F.col("seconds_per_point"), F.col("points")
    nxt, nxt_pts = F.lead(spp).over(by), F.lead(pts).over(by)
    problem = (
        F.when(nxt == spp, "same precision")
        .when(nxt % spp != 0, "uneven division")
        .when(nxt * nxt_pts <= spp * pts, "no longer retention")
        .when(pts < F.floor(nxt / spp), "too few points to consolidate")
    )
    rows = archives.select(key, F.row_number().over(by).alias("k"), problem.alias("problem"))
    return rows.where("problem is not null").groupBy(key).agg(F.min_by("problem", "k").alias("problem"))


def info(series: DataFrame, archives: DataFrame) -> DataFrame:
    """One row a series: its settings and the list of its archives with derived sizes."""
    a = archives.withColumn("retention", F.col("seconds_per_point") * F.col("points")).withColumn("size", 12 * F.col("points"))
    by = W.partitionBy("series_id").orderBy("level")
    n = F.count("*").over(W.partitionBy("series_id"))
    offset = 16 + 12 * n + F.coalesce(F.sum("size").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lists = a.withColumn("offset", offset).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("level", "seconds_per_point", "points", "retention", "size", "offset"))).alias("archives"), (16 + 12 * F.count("*") + F.sum("size")).alias("file_size"))
    return series.join(lists, "series_id", "left")


def transform(points: DataFrame, value: Callable[[Column, Column], Column]) -> DataFrame:
    """``points`` with values from a function of (interval, value); nulls stay null."""
    return points.withColumn("value", F.when(F.col("value").isNotNull(), value(F.col("interval"), F.col("value"))))
