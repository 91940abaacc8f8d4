"""New levels for old series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierfold.functions.aggregates import method_column
from tierfold.functions.columns import floor_to_step
from tierfold.functions.config import Ladder
from tierfold.operators.align import last_write_wins, routed
from tierfold.operators.read import Window, on_grid, select_window
from tierfold.operators.rollup import cascade_in_turn
from tierfold.sources.shared import settle


def _old_windows(old: Ladder, now: int) -> list[Window]:
    """What is read of each level: from a point after its oldest up to now, by the finest level that reaches as far."""
    return [select_window(old, now - x.retention + x.step, now, now) for x in old.levels]


def _writes(raw: DataFrame, new: Ladder, now: int, future: str) -> DataFrame:
    """Direct writes of raw points (with a turn) into the new levels; settled, as every level reads them."""
    step = F.element_at(F.array(*[F.lit(x.step).cast("long") for x in new.levels]), F.col("level") + 1)
    return settle(last_write_wins(routed(raw, new, now, future), step, ("series_id", "level", "turn")))


def resize(state: DataFrame, old: Ladder, new: Ladder, now: int, method: str, xff: float) -> DataFrame:
    """Old levels written into the new ones in bulk, coarsest first, each rolling up as it goes; the state is read once."""
    windows = list(reversed(_old_windows(old, now)))
    turn = F.lit(None).cast("int")
    for j, w in enumerate(windows):
        turn = F.when((F.col("level") == w.level) & (F.col("interval") >= w.lo) & (F.col("interval") < w.hi), F.lit(j)).otherwise(turn)
    known = state.withColumn("turn", turn).where("turn is not null and value is not null")
    raw = known.select("series_id", F.col("interval").alias("ts"), "value", F.lit(0).cast("long").alias("arrival"), "turn")
    return cascade_in_turn(_writes(raw, new, now, "reject"), len(windows), new, method, xff)


def resize_aggregate(state: DataFrame, old: Ladder, new: Ladder, now: int, method: str, xff: float, aligned: bool = False) -> DataFrame:
    """New points summed up from the old ones in their bucket, the finest data of each age.

    A bucket counts if the known share of the old slots in it reaches ``xff``, unrounded. Buckets begin at
    now - retention + now % step, or on the grid with ``aligned``.
    """
    names = state.select("series_id").distinct()
    parts: list[DataFrame] = []
    oldest: int | None = None
    for w in _old_windows(old, now):
        hi = w.hi if oldest is None else min(w.hi, -(-(oldest - w.lo) // w.step) * w.step + w.lo)
        cut = Window(w.level, w.lo, hi, w.step)
        if cut.slots:
            parts.append(on_grid(state, names, cut))
            oldest = cut.lo
    spliced = reduce(DataFrame.union, parts)
    # A slot belongs to a bucket of each new level that reaches as far back; all levels' buckets are summed up at once.
    buckets = []
    for k, x in enumerate(new.levels):
        first = now - x.retention + now % x.step
        start: Column = floor_to_step("interval", x.step) if aligned else F.lit(first).cast("long") + F.floor((F.col("interval") - first) / x.step).cast("long") * x.step
        buckets.append(F.when((F.col("interval") >= first) & (F.col("interval") < first + x.points * x.step), F.struct(F.lit(k).alias("turn"), start.alias("ts"))))
    rows = spliced.select("series_id", "interval", "value", F.explode(F.array_compact(F.array(*buckets))).alias("b")).select("series_id", "interval", "value", "b.turn", "b.ts")
    # The value of avg_zero divides by the slots that are there.
    value = F.sum("value") / F.count("*") if method == "avg_zero" else method_column(method, 1)
    summed = rows.groupBy("series_id", "turn", "ts").agg(value.alias("value"), F.count("value").alias("known"), F.count("*").alias("slots"))
    raw = summed.where((F.col("known") > 0) & (F.col("known") / F.col("slots") >= F.lit(float(xff)))).select("series_id", "ts", "value", F.lit(0).cast("long").alias("arrival"), "turn")
    return cascade_in_turn(_writes(raw, new, now, "accept"), len(new), new, method, xff)
