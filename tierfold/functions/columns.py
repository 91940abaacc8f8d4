"""Column functions: alignment, formats and drop filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def floor_to_step(t: str | Column, step: int | Column) -> Column:
    s = F.lit(step).cast("long") if isinstance(step, int) else step
    return _c(t) - F.pmod(_c(t), s)


def ceil_to_step(t: str | Column, step: int | Column) -> Column:
    return -floor_to_step(-_c(t), step)


def next_on_grid(t: str | Column, step: int) -> Column:
    return floor_to_step(t, step) + F.lit(step).cast("long")


def ring_slot(interval: str | Column, step: int, points: int, base: int | Column = 0) -> Column:
    """The place of an interval in a ring of ``points`` slots whose slot 0 holds ``base``."""
    b = F.lit(base).cast("long") if isinstance(base, int) else base
    return F.pmod(F.floor((_c(interval) - b) / F.lit(step)).cast("long"), F.lit(points).cast("long"))


def byte_format(n: str | Column) -> Column:
    x = _c(n)
    out = F.format_string("%d bytes", x.cast("long"))
    for size, unit in ((1024, "KB"), (1024**2, "MB"), (1024**3, "GB")):
        out = F.when(x >= size, F.format_string(f"%.3f {unit}", F.bround(x / size, 3))).otherwise(out)
    return out


def metric_name(path: str | Column, root: str = "") -> Column:
    """'root/a/b.wsp' to 'a.b'."""
    p = F.regexp_replace(_c(path), "^" + root.rstrip("/").replace(".", r"\."), "") if root else _c(path)
    return F.translate(F.regexp_replace(F.regexp_replace(p, "^/+", ""), r"\.[^./]+$", ""), "/", ".")


def drop_condition(value: str | Column, drop: str | None) -> Column:
    """What stays under a drop option: nulls, zeroes (which keeps nulls), empty (both), or none."""
    v = _c(value)
    if drop in (None, ""):
        return F.lit(True)
    if drop == "nulls":
        return v.isNotNull()
    if drop == "zeroes":
        return v.isNull() | (v != 0)
    if drop == "empty":
        return v.isNotNull() & (v != 0)
    raise ValueError(f"drop: nulls, zeroes or empty, not {drop}")


def differs(a: str | Column, b: str | Column) -> Column:
    """Not equal, null being a value, NaN unequal to itself."""
    x, y = _c(a), _c(b)
    nan = F.coalesce(F.isnan(x) & F.isnan(y), F.lit(False))
    return ~x.eqNullSafe(y) | nan


def tsv_line(interval: str | Column, value: str | Column, pretty: str | None = None) -> Column:
    """'time TAB value', None for null; ``pretty``: a pattern for the time, in the session's zone."""
    t = F.date_format(F.timestamp_seconds(_c(interval)), pretty) if pretty else _c(interval).cast("string")
    return F.concat_ws("\t", t, F.when(_c(value).isNotNull(), F.format_string("%f", _c(value))).otherwise("None"))


def raw_line(interval: str | Column, value: str | Column) -> Column:
    """'time:value', which the text source reads back."""
    return F.concat_ws(":", _c(interval).cast("string"), _c(value).cast("string"))
