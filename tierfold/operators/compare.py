"""Two tables of series: overlay, difference, gaps and filling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tierfold.functions.columns import ceil_to_step, differs
from tierfold.functions.config import Ladder, UnlikeLadders
from tierfold.operators.align import direct_writes
from tierfold.operators.read import Window, grid_window, on_grid
from tierfold.operators.rollup import cascade, retained
from tierfold.sources.shared import settle


def check_alike(a: Ladder, b: Ladder) -> None:
    if a.pairs() != b.pairs():
        raise UnlikeLadders(f"levels {a.pairs()} and {b.pairs()} differ; resize one of the two")


def _inside(windows: list[Window]) -> Column:
    """Rows of the windows of their levels."""
    parts = [(F.col("level") == w.level) & (F.col("interval") >= w.lo) & (F.col("interval") < w.hi) for w in windows if w.slots]
    return reduce(Column.__or__, parts, F.lit(False))


def merge(source: DataFrame, target: DataFrame, ladder: Ladder, now: int, method: str, xff: float, start: int = 0, end: int | None = None) -> DataFrame:
    """The target with the source's known points written over it level by level, and their rollups."""
    end = now if end is None else end
    if end < start:
        raise ValueError(f"the range ends at {end}, before {start}")
    windows = [grid_window(k, x.step, max(start, now - x.retention), end) for k, x in enumerate(ladder.levels) if end >= now - x.retention]
    writes = source.where(_inside(windows) & F.col("value").isNotNull())
    return cascade(target, writes, ladder, method, xff)


def diff_windows(ladder: Ladder, now: int, until: int | None = None) -> list[Window]:
    """Each coarser level only over what is older than the finer one keeps."""
    end, out = until or now, []
    for k, x in enumerate(ladder.levels):
        start = now - x.retention
        out.append(grid_window(k, x.step, start, end))
        end = min(start, end)
    return out


def compared(a: DataFrame, b: DataFrame, ladder: Ladder, now: int, until: int | None = None, ignore_empty: bool = False) -> DataFrame:
    """(series_id, level, interval, a, b) of the slots that either side knows, or both with ``ignore_empty``."""
    inside = _inside(diff_windows(ladder, now, until))
    keys = ["series_id", "level", "interval"]
    x = a.where(inside & F.col("value").isNotNull()).select(*keys, F.col("value").alias("a"))
    y = b.where(inside & F.col("value").isNotNull()).select(*keys, F.col("value").alias("b"))
    return x.join(y, keys, "inner" if ignore_empty else "full_outer")


def diff(a: DataFrame, b: DataFrame, ladder: Ladder, now: int, until: int | None = None, ignore_empty: bool = False) -> DataFrame:
    """The slots whose values differ; NaN differs from NaN, null from any value."""
    return compared(a, b, ladder, now, until, ignore_empty).where(differs("a", "b"))


def diff_summary(a: DataFrame, b: DataFrame, ladder: Ladder, now: int, until: int | None = None, ignore_empty: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, level, total, differing)."""
    return compared(a, b, ladder, now, until, ignore_empty).groupBy(*by, "level").agg(F.count("*").alias("total"), F.count_if(differs("a", "b")).alias("differing"))


def gaps(grid: DataFrame, step: int, zero_is_gap: bool = False) -> DataFrame:
    """(series_id, gap_start, gap_end, slots, closed_by): the maximal runs of unknown slots of a dense grid.

    closed_by: the known slot after the run, or null at the end of the grid. Runs are islands: slots of a run have the
    same distance between time and rank.
    """
    empty = F.col("value").isNull() | ((F.col("value") == 0) if zero_is_gap else F.lit(False))
    last = grid.groupBy("series_id").agg(F.max("interval").alias("last"))
    by = W.partitionBy("series_id").orderBy("interval")
    runs = grid.where(empty).withColumn("island", F.col("interval") - F.row_number().over(by) * F.lit(step).cast("long"))
    out = runs.groupBy("series_id", "island").agg(F.min("interval").alias("gap_start"), F.max("interval").alias("gap_end"), F.count("*").alias("slots"))
    closed = F.when(F.col("gap_end") < F.col("last"), F.col("gap_end") + F.lit(step).cast("long"))
    return out.join(last, "series_id").select("series_id", "gap_start", "gap_end", "slots", closed.alias("closed_by"))


def fill(source: DataFrame, target: DataFrame, ladder: Ladder, source_ladder: Ladder, now: int, method: str, xff: float, start_from: int | None = None, mode: str = "compat") -> DataFrame:
    """The target with its gaps filled from the source.

    compat: zeros are gaps too, runs of one slot stay, the known slot that closes a run is written over, and the
    source's finest data of any age goes in by bulk write. strict: unknown slots take the source's value of the same
    level and slot, and nothing else changes.
    """
    end = now if start_from is None else start_from
    state = settle(retained(target, ladder, now))
    if mode == "strict":
        keys = ["series_id", "level", "interval"]
        windows = []
        for k, x in enumerate(ladder.levels):
            windows.append(grid_window(k, x.step, now - x.retention, end))
            end = min(end, now - x.retention)
        missing = source.where(_inside(windows) & F.col("value").isNotNull()).join(state.where(F.col("value").isNotNull()), keys, "left_anti").join(state.select("series_id").distinct(), "series_id", "left_semi")
        return state.where(F.col("value").isNotNull()).select(*keys, "value").union(missing.select(*keys, "value"))
    if mode != "compat":
        raise ValueError(f"mode: compat or strict, not {mode}")
    names = target.select("series_id").distinct()
    for k, x in enumerate(ladder.levels):
        if now - x.retention >= end:
            continue
        window = grid_window(k, x.step, now - x.retention, end)
        runs = gaps(on_grid(state, names, window), x.step, zero_is_gap=True).where("slots > 1")
        # Every source point after the slot before the gap, up to the closing slot, lies at one of these slots or less than a step before.
        slots = runs.select("series_id", F.explode(F.sequence("gap_start", F.coalesce("closed_by", "gap_end"), F.lit(x.step).cast("long"))).alias("slot")).distinct()
        newer, pieces = None, []
        for j, y in enumerate(source_ladder.levels):
            kept = (F.col("level") == j) & (F.col("interval") > now - y.retention)
            pieces.append(kept if newer is None else kept & (F.col("interval") <= newer))
            newer = now - y.retention
        points = source.where(F.col("value").isNotNull() & reduce(Column.__or__, pieces)).withColumn("slot", ceil_to_step("interval", x.step))
        raw = points.join(slots, ["series_id", "slot"], "left_semi").select("series_id", F.col("interval").alias("ts"), "value", F.lit(0).cast("long").alias("arrival"))
        writes = settle(direct_writes(raw, ladder, now))  # each level of the cascade reads them
        state = settle(cascade(state, writes, ladder, method, xff))
        end = now - x.retention
    return state
