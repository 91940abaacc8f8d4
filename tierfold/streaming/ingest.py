"""Continuous ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tierfold.functions.config import Ladder
from tierfold.operators.replay import Rings
from tierfold.sources.store import Store


def into_store(stream: DataFrame, store: Store, checkpoint: str, clock: str = "ts", **trigger) -> StreamingQuery:
    """Micro-batches of raw points written to a store. ``clock``: the column with each point's time of writing, by which
    it is routed: a late point goes to the level that kept its age when it was written. Its own time by default, that is
    to the finest level.

    A batch that is tried again writes the same points into the same slots, so the store is as if it had run once.
    """

    def write(batch: DataFrame, _: int) -> None:
        now = batch.agg(F.max(clock)).first()[0]
        if now is not None:
            store.update_many(batch, int(now), clock=clock)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(stream: DataFrame, step: int, late: int) -> DataFrame:
    """Level 0 as a stream: the last point in time of each slot, final once the watermark has passed it."""
    timed = stream.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", f"{late} seconds")
    out = timed.groupBy("series_id", F.window("at", f"{step} seconds").alias("slot")).agg(F.max_by("value", F.struct("ts", -F.col("arrival"))).alias("value"))
    return out.select("series_id", F.unix_timestamp("slot.start").alias("interval"), "value")


class RingProcessor(StatefulProcessor):
    """The rings of a series as state: a bounded map of (level, slot) to (interval, value). Emits the slots that a batch changed."""

    def __init__(self, ladder: Ladder, method: str, xff: float):
        self.ladder, self.method, self.xff = ladder, method, xff

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getMapState("ring", "level int, slot long", "interval long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rings = Rings(self.ladder, self.method, self.xff)
        before: dict[tuple[int, int], tuple[int, float]] = {}
        for (level, slot), (interval, value) in self.ring.iterator():
            rings.slots[level][slot] = (interval, value)
            before[level, slot] = (interval, value)
        points = pd.concat(list(rows)).sort_values(["now", "arrival"], kind="stable")
        for r in points.itertuples():
            rings.write(int(r.ts), float(r.value), int(r.now))
        changed = [(k, s, i, v) for k, ring in enumerate(rings.slots) for s, (i, v) in ring.items() if before.get((k, s)) != (i, v)]
        for k, s, i, v in changed:
            self.ring.updateValue((k, s), (i, v))
        yield pd.DataFrame({"series_id": key[0], "level": [c[0] for c in changed], "interval": [c[2] for c in changed], "value": [c[3] for c in changed]})

    def close(self) -> None:
        pass


def ring_stream(stream: DataFrame, ladder: Ladder, method: str, xff: float) -> DataFrame:
    """(series_id, level, interval, value) updates of a stream of (series_id, ts, value, now, arrival); needs the RocksDB state store."""
    return stream.groupBy("series_id").transformWithStateInPandas(RingProcessor(ladder, method, xff), "series_id string, level int, interval long, value double", "Update", "None")
