"""From raw points to slots: alignment, last write wins, and routing by age.

``raw``: series_id string, ts long, value double, arrival long (the order of supply; ties on ts go to the first supplied).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierfold.functions.columns import floor_to_step
from tierfold.functions.config import Ladder, NotCovered


def last_write_wins(raw: DataFrame, step: int | Column, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(keys, interval, value): of the points of a slot, the last in time."""
    known = raw.where(F.col("value").isNotNull() & F.col("ts").isNotNull())
    order = F.struct("ts", -F.col("arrival")) if "arrival" in raw.columns else F.col("ts")
    return known.withColumn("interval", floor_to_step("ts", step)).groupBy(*keys, "interval").agg(F.max_by("value", order).alias("value"))


def _at(now: int | Column) -> Column:
    return (F.lit(now) if isinstance(now, int) else now).cast("long")


def level_by_age(ladder: Ladder, now: int | Column) -> Column:
    """The finest level that keeps a point; null if none does. Points of the future belong to the finest. ``now`` may be each point's own time of writing."""
    age = _at(now) - F.col("ts")
    out = F.lit(None).cast("int")
    for k in reversed(range(len(ladder))):
        out = F.when(age <= ladder[k].retention, F.lit(k)).otherwise(out)
    return out


def routed(raw: DataFrame, ladder: Ladder, now: int | Column, future: str = "reject") -> DataFrame:
    """Raw points with their level in a bulk write; too old ones are gone, and those of the future unless accepted."""
    if future not in ("reject", "accept"):
        raise ValueError(f"future: reject or accept, not {future}")
    out = raw.withColumn("level", level_by_age(ladder, now)).where("level is not null")
    return out if future == "accept" else out.where(F.col("ts") <= _at(now))


def dropped(raw: DataFrame, ladder: Ladder, now: int) -> DataFrame:
    """Raw points that a bulk write leaves out, with the reason."""
    reason = F.when(F.col("ts") > now, "future").when(level_by_age(ladder, now).isNull(), "too old")
    return raw.withColumn("reason", reason).where("reason is not null")


def check_single(ts: int, ladder: Ladder, now: int) -> int:
    """The level of a single write; stricter than a bulk write, it raises for the future and at the exact age limit."""
    if not 0 <= now - ts < ladder.max_retention:
        raise NotCovered(f"no level keeps {ts} at {now}")
    return ladder.level_for(now - ts)


def direct_writes(raw: DataFrame, ladder: Ladder, now: int | Column, future: str = "reject") -> DataFrame:
    """(series_id, level, interval, value) that a bulk write puts straight into each level."""
    step = F.element_at(F.array(*[F.lit(x.step).cast("long") for x in ladder.levels]), F.col("level") + 1)
    return last_write_wins(routed(raw, ladder, now, future), step, ("series_id", "level"))
