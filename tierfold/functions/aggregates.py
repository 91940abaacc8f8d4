"""The eight ways of summing up a bucket, and the coverage gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierfold.functions.config import checked_method


def method_column(method: str, slots: int, value: str = "value", interval: str = "interval") -> Column:
    """The aggregate of a bucket of ``slots`` finer slots over its known values. NaN counts as largest, as Spark orders it."""
    v, i = F.col(value), F.col(interval)
    return {
        "average": lambda: F.avg(v),
        "sum": lambda: F.sum(v),
        "last": lambda: F.max_by(v, i),
        "max": lambda: F.max(v),
        "min": lambda: F.min(v),
        "avg_zero": lambda: F.sum(v) / F.lit(float(slots)),
        "absmax": lambda: F.max_by(v, F.struct(F.abs(v), -i)),
        "absmin": lambda: F.min_by(v, F.struct(F.abs(v), i)),
    }[checked_method(method)]()


def dispatched(methods: list[str], slots: int, method: str = "aggregation_method") -> Column:
    """By each series' own method, over those that occur; every other group's input is null and costs nothing."""
    out = F.lit(None).cast("double")
    for m in sorted(set(methods)):
        out = F.when(F.first(method) == m, method_column(m, slots)).otherwise(out)
    return out


def covered(slots: int, xff: float | Column, value: str = "value") -> Column:
    """Whether enough of the slots are known. ``xff`` as it is stored (see ``config.stored_xff``)."""
    share = F.count(F.col(value)) / F.lit(float(slots))
    return (F.count(F.col(value)) > 0) & (share >= (F.lit(xff) if isinstance(xff, float) else xff))
