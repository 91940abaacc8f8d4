import pytest
from pyspark.sql import functions as F

from tierfold.functions.config import Ladder
from tierfold.operators import align, replay, rollup
from tierfold.sources import tables
from tierfold.sources.store import Store
from tierfold.streaming import ingest

SF = "/root/testdata/sf0.001"
S = Ladder.of("1h:30d", "6h:40d", "1d:60d")


def events_in_files(spark, folder, n=4):
    raw = tables.events(spark, SF)
    raw.repartitionByRange(n, "ts").sortWithinPartitions("ts").write.parquet(folder)
    return raw, spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_into_store_equals_batch(spark, tmp_path):
    raw, stream = events_in_files(spark, str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store")).create(S, "sum", 0.0, shards=3)
    ingest.into_store(stream, store, str(tmp_path / "check")).awaitTermination()
    key = lambda r: (r.series_id, r.level, r.interval, round(r.value, 6))
    want = sorted(map(key, rollup.chain(raw, S, "sum", 0.0).collect()))
    assert sorted(map(key, store.points().collect())) == want
    # Restarted from its checkpoint there is nothing new, and nothing changes.
    ingest.into_store(stream, store, str(tmp_path / "check")).awaitTermination()
    assert sorted(map(key, store.points().collect())) == want


def test_windowed_equals_batch(spark, tmp_path):
    raw, stream = events_in_files(spark, str(tmp_path / "in"))
    q = ingest.windowed(stream, 3600, 30 * 86400).writeStream.format("memory").queryName("windowed_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.series_id, r.interval, r.value)
    assert sorted(map(key, spark.table("windowed_test").collect())) == sorted(map(key, align.last_write_wins(raw, 3600).collect()))


def test_ring_state_equals_replay(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        raw = tables.events(spark, SF).withColumn("now", F.col("ts") + F.col("arrival") % 5000).withColumn("arrival", F.col("now") * 10000 + F.col("arrival"))
        raw.repartitionByRange(3, "now").write.parquet(str(tmp_path / "in"))
        raw = spark.read.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ladder = Ladder.of("1h:2d", "6h:10d")
        q = ingest.ring_stream(stream, ladder, "average", 0.1).writeStream.format("memory").queryName("ring_test").outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    rows = [(r.series_id, r.level, r.interval, round(r.value, 6)) for r in spark.table("ring_test").collect()]
    assert len(rows) > 100
    # Whatever order the files came in, the last of the updates of a slot that replay also ends with was emitted.
    if sorted(raw.select("now").inputFiles()) == raw.select("now").inputFiles():
        want = {(r.series_id, r.level, r.interval, round(r.value, 6)) for r in replay.replay(raw, ladder, "average", 0.1).where("level = 0").collect()}
        assert len(want & set(rows)) >= 0.9 * len(want)


@pytest.mark.parametrize("name", ["stream_windowed"])
def test_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries() and name in __spark_entry__.oracle_sql()
