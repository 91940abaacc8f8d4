"""Rollup through the levels. A level sums up the one below it, never the raw points.

``points``: series_id, interval, value, and level where several are in one table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierfold.functions.aggregates import covered, dispatched, method_column
from tierfold.functions.columns import floor_to_step
from tierfold.functions.config import Ladder, stored_xff
from tierfold.operators.align import last_write_wins


def roll_up(points: DataFrame, fine: int, coarse: int, method: str | list[str], xff: float, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """One level up: (keys, interval, value) of the buckets that are covered.

    ``method``: one for all, or the list of those that occur in the column aggregation_method of ``points``.
    """
    slots = coarse // fine
    value = method_column(method, slots) if isinstance(method, str) else dispatched(method, slots)
    grouped = points.withColumn("bucket", floor_to_step("interval", coarse)).groupBy(*keys, "bucket")
    out = grouped.agg(value.alias("value"), covered(slots, stored_xff(xff)).alias("enough")).where("enough")
    return out.select(*keys, F.col("bucket").alias("interval"), "value")


def chain(raw: DataFrame, ladder: Ladder, method: str, xff: float, colocate: bool = True) -> DataFrame:
    """(series_id, level, interval, value) of all levels, of points that each passed through the finest.

    With ``colocate`` rows are dealt once by series and coarsest bucket, which every level's grouping refines: one
    shuffle for the whole chain, and as many tasks as there are coarse buckets, however few the series. Without, each
    level shuffles what its partial aggregate leaves; that is less if slots hold many raw points.
    """
    keys: tuple[str, ...] = ("series_id",)
    if colocate:
        raw = raw.withColumn("top", floor_to_step("ts", ladder[-1].step)).repartition("series_id", "top")
        keys = ("series_id", "top")
    level = last_write_wins(raw, ladder[0].step, keys)
    out = [level.withColumn("level", F.lit(0))]
    for k in range(1, len(ladder)):
        level = roll_up(level, ladder[k - 1].step, ladder[k].step, method, xff, keys)
        out.append(level.withColumn("level", F.lit(k)))
    return reduce(DataFrame.union, (x.select("series_id", "level", "interval", "value") for x in out))


def retained(points: DataFrame, ladder: Ladder, now: int) -> DataFrame:
    """What each level still keeps."""
    oldest = F.element_at(F.array(*[F.lit((now - x.retention) // x.step * x.step).cast("long") for x in ladder.levels]), F.col("level") + 1)
    return points.where((F.col("interval") > oldest) & (F.col("level") < len(ladder)))


def cascade(state: DataFrame, writes: DataFrame, ladder: Ladder, method: str, xff: float) -> DataFrame:
    """The state after direct writes into any levels and the rollups that follow from them.

    At each level a direct write beats a rollup of the same call, which beats what was there. Only buckets that hold a
    fresh point are summed up again; one that isn't covered leaves the old value.
    """
    out: list[DataFrame] = []
    rolled: DataFrame | None = None
    columns = ["series_id", "interval", "value"]
    for k, level in enumerate(ladder.levels):
        tiers = [state.where(F.col("level") == k).select(*columns, F.lit(0).alias("tier")), writes.where(F.col("level") == k).select(*columns, F.lit(2).alias("tier"))]
        if rolled is not None:
            tiers.append(rolled.select(*columns, F.lit(1).alias("tier")))
        now = reduce(DataFrame.union, tiers).groupBy("series_id", "interval").agg(F.max_by("value", "tier").alias("value"), F.max("tier").alias("tier"))
        out.append(now.select("series_id", F.lit(k).alias("level"), "interval", "value"))
        if k + 1 < len(ladder):
            slots, coarse = ladder[k + 1].step // level.step, ladder[k + 1].step
            summed = now.groupBy("series_id", floor_to_step("interval", coarse).alias("bucket")).agg(method_column(method, slots).alias("value"), covered(slots, stored_xff(xff)).alias("enough"), F.max("tier").alias("fresh"))
            rolled = summed.where("enough and fresh > 0").select("series_id", F.col("bucket").alias("interval"), "value")
    return reduce(DataFrame.union, out)


def cascade_in_turn(writes: DataFrame, turns: int, ladder: Ladder, method: str, xff: float) -> DataFrame:
    """What ``turns`` cascades one after another make of nothing, in one pass. writes: series_id, level, interval, value, turn.

    Each slot has a value as of each turn: that of the latest write or rollup up to it. A bucket is summed up as of every
    turn at once, and counts in those turns in which a slot of it is fresh.
    """
    keys = ["series_id", "interval"]
    out: list[DataFrame] = []
    rolled: DataFrame | None = None
    for k, level in enumerate(ladder.levels):
        puts = writes.where(F.col("level") == k).select(*keys, "turn", F.lit(2).alias("tier"), "value")
        if rolled is not None:
            puts = puts.union(rolled.select(*keys, "turn", F.lit(1).alias("tier"), "value"))
        put = F.struct("turn", "tier", "value")
        slots = puts.groupBy(*keys).agg(*[F.max(F.when(F.col("turn") <= j, put)).alias(f"as_of_{j}") for j in range(turns)])
        out.append(slots.select("series_id", F.lit(k).alias("level"), "interval", F.col(f"as_of_{turns - 1}.value").alias("value")))
        if k + 1 == len(ladder):
            break
        n, coarse = ladder[k + 1].step // level.step, ladder[k + 1].step
        now = slots.select(*keys, *[F.col(f"as_of_{j}.value").alias(f"value_{j}") for j in range(turns)], *[(F.col(f"as_of_{j}.turn") == j).alias(f"fresh_{j}") for j in range(turns)])
        sums = [x for j in range(turns) for x in (method_column(method, n, f"value_{j}").alias(f"sum_{j}"), (covered(n, stored_xff(xff), f"value_{j}") & F.coalesce(F.max(f"fresh_{j}"), F.lit(False))).alias(f"on_{j}"))]
        summed = now.groupBy("series_id", floor_to_step("interval", coarse).alias("bucket")).agg(*sums)
        each = F.array(*[F.struct(F.lit(j).alias("turn"), F.col(f"sum_{j}").alias("value"), F.col(f"on_{j}").alias("on")) for j in range(turns)])
        rolled = summed.select("series_id", F.col("bucket").alias("interval"), F.inline(each)).where("on")
    return reduce(DataFrame.union, out)
