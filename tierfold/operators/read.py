"""Reads on the dense grid of a level, gaps as nulls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierfold.functions.columns import drop_condition
from tierfold.functions.config import InvalidInterval, Ladder

#: Grid rows of one series beyond which a read is refused.
MOST_SLOTS = 100_000_000
#: Grid rows that are made at a time.
GRID_BLOCK = 65_536


@dataclass(frozen=True)
class Window:
    """Grid points lo, lo + step, ..., below hi, of a level."""

    level: int
    lo: int
    hi: int
    step: int

    @property
    def slots(self) -> int:
        return max(0, (self.hi - self.lo) // self.step)


def grid_window(level: int, step: int, start: int, end: int) -> Window:
    """Exclusive of start's slot, inclusive of end's; a range within one slot is that of the next point."""
    lo, hi = start // step * step + step, end // step * step + step
    return Window(level, lo, hi + step if lo == hi else hi, step)


def select_window(ladder: Ladder, start: int, end: int | None, now: int, step: int | None = None) -> Window | None:
    """The clamped grid and the level that a read uses; None if nothing in the range can be kept."""
    end = now if end is None else end
    if start > end:
        raise InvalidInterval(f"the range ends at {end}, before {start}")
    oldest = now - ladder.max_retention
    if start > now or end < oldest:
        return None
    start, end = max(start, oldest), min(end, now)
    if step is not None:
        level = next((k for k, x in enumerate(ladder.levels) if x.step == step), None)
        if level is None:
            raise ValueError(f"no level has a step of {step} s")
    else:
        level = ladder.level_for(now - start)
    return grid_window(level, ladder[level].step, start, end)


def on_grid(points: DataFrame, series: DataFrame, window: Window) -> DataFrame:
    """(series_id, interval, value) of every grid point of every series; the range reaches the scan as a filter."""
    if window.slots > MOST_SLOTS:
        raise ValueError(f"{window.slots} slots a series")
    names = series.select("series_id").distinct()
    if window.slots == 0:
        return names.select("series_id", F.lit(0).cast("long").alias("interval"), F.lit(None).cast("double").alias("value")).limit(0)
    # In two steps, so that no array holds a whole long grid.
    last, stride = F.lit(window.hi - window.step).cast("long"), F.lit(window.step).cast("long")
    blocks = names.select("series_id", F.explode(F.sequence(F.lit(window.lo).cast("long"), last, stride * GRID_BLOCK)).alias("first"))
    grid = blocks.select("series_id", F.explode(F.sequence("first", F.least(F.col("first") + stride * (GRID_BLOCK - 1), last), stride)).alias("interval"))
    there = points.where((F.col("level") == window.level) & (F.col("interval") >= window.lo) & (F.col("interval") < window.hi))
    return grid.join(there.select("series_id", "interval", "value"), ["series_id", "interval"], "left")


def fetch(points: DataFrame, ladder: Ladder, start: int, end: int | None, now: int, step: int | None = None, series: DataFrame | None = None, drop: str | None = None) -> DataFrame | None:
    """A read of all series (or those in ``series``); None if the range lies outside what is kept.

    The finest level that reaches back to ``start`` is read, or the one of ``step``. Slots that a level no longer keeps
    are null, however long the range.
    """
    window = select_window(ladder, start, end, now, step)
    if window is None:
        return None
    names = points if series is None else series
    oldest = now - ladder[window.level].retention
    there = points.where(F.col("interval") > oldest // window.step * window.step)
    return on_grid(there, names, window).where(drop_condition("value", drop))


def as_arrays(grid: DataFrame, step: int) -> DataFrame:
    """One row a series: start, end (exclusive), step and the values in order, nulls kept."""
    points = F.array_sort(F.collect_list(F.struct("interval", "value")))
    return grid.groupBy("series_id").agg(F.min("interval").alias("start"), (F.max("interval") + step).alias("end"), F.lit(step).cast("long").alias("step"), F.transform(points, lambda p: p["value"]).alias("values"))


def as_json(grid: DataFrame, step: int) -> DataFrame:
    """One JSON text a series, with nulls."""
    a = as_arrays(grid, step)
    return a.select("series_id", F.to_json(F.struct("start", "end", "step", "values"), {"ignoreNullFields": "false"}).alias("json"))
