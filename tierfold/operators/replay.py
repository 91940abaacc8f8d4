"""Faithful replay: single writes one by one into rings, for late data that outruns a fine level.

Batch rollups equal this as long as every fine point of a bucket is written while the fine ring still holds the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tierfold.functions.config import Ladder, checked_method, stored_xff


def reduce_known(method: str, known: list[float], slots: int) -> float:
    """The aggregate of known values in order of time."""
    checked_method(method)
    if method == "average":
        return sum(known) / len(known)
    if method == "avg_zero":
        return sum(known) / slots
    if method == "last":
        return known[-1]
    if method in ("absmax", "absmin"):
        return (max if method == "absmax" else min)(known, key=abs)
    return {"sum": sum, "max": max, "min": min}[method](known)


class Rings:
    """The levels of one series; a slot holds the interval that was written last."""

    def __init__(self, ladder: Ladder, method: str, xff: float):
        self.ladder, self.method, self.xff = ladder, method, stored_xff(xff)
        self.slots: list[dict[int, tuple[int, float]]] = [{} for _ in ladder.levels]

    def put(self, k: int, interval: int, value: float) -> None:
        x = self.ladder[k]
        self.slots[k][interval // x.step % x.points] = (interval, value)

    def get(self, k: int, interval: int) -> float | None:
        x = self.ladder[k]
        at, value = self.slots[k].get(interval // x.step % x.points, (None, None))
        return value if at == interval else None

    def write(self, ts: int, value: float, now: int) -> bool:
        """False if no level covers the point."""
        if not 0 <= now - ts < self.ladder.max_retention:
            return False
        k = self.ladder.level_for(now - ts)
        self.put(k, ts - ts % self.ladder[k].step, value)
        while k + 1 < len(self.ladder):
            fine, coarse = self.ladder[k], self.ladder[k + 1]
            bucket = ts - ts % coarse.step
            found = [self.get(k, t) for t in range(bucket, bucket + coarse.step, fine.step)]
            known = [v for v in found if v is not None]
            if not known or len(known) / len(found) < self.xff:
                break
            k += 1
            self.put(k, bucket, reduce_known(self.method, known, len(found)))
        return True

    def rows(self) -> Iterator[tuple[int, int, float]]:
        for k, ring in enumerate(self.slots):
            for interval, value in sorted(ring.values()):
                yield k, interval, value


def replay(raw: DataFrame, ladder: Ladder, method: str, xff: float) -> DataFrame:
    """(series_id, level, interval, value) after writing each series' rows (ts, value, now, arrival) in order of arrival.

    A series is one task's work, and what it holds is its rings; use it for series of bounded rate.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = Rings(ladder, method, xff)
        for r in pdf.sort_values("arrival", kind="stable").itertuples():
            if r.value is not None and not pd.isna(r.ts):
                rings.write(int(r.ts), float(r.value), int(r.now))
        rows = list(rings.rows())
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "level": [x[0] for x in rows], "interval": [x[1] for x in rows], "value": [x[2] for x in rows]})

    return raw.where("value is not null").groupBy("series_id").applyInPandas(run, "series_id string, level int, interval long, value double")
