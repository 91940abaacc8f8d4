import struct

import pytest
from pyspark.sql import functions as F

from tierfold.functions.config import ConcurrentWrite, CorruptFile, InvalidConfiguration, InvalidMethod, Ladder, UnlikeLadders
from tierfold.operators import align, rollup
from tierfold.sources import ringfile, tables, text
from tierfold.sources.store import Store

LADDER = Ladder.of((1, 60), (10, 60))
RAW = "series_id string, ts long, value double, arrival long"


def fixed_file():
    """A file written by hand: one archive of three slots, the last lap partly over the first."""
    return struct.pack("!2LfL", 1, 3, 0.5, 1) + struct.pack("!3L", 28, 1, 3) + b"".join(struct.pack("!Ld", t, v) for t, v in ((103, 4.0), (101, 2.0), (0, 0.0)))


def test_ring_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.wsp").write_bytes(fixed_file())
    (tmp_path / "two.wsp").write_bytes(b"junk")
    (tmp_path / "three.wsp").write_bytes(struct.pack("!2LfL", 99, 3, 0.5, 0))
    (tmp_path / "other.txt").write_bytes(b"")
    path = str(tmp_path)
    heads = {r.path.rsplit("/", 1)[1]: r for r in ringfile.read_headers(spark, path).collect()}
    assert set(heads) == {"one.wsp", "two.wsp", "three.wsp"}
    assert heads["one.wsp"].method == "average" and heads["one.wsp"].archives[0].points == 3 and heads["one.wsp"].error is None
    assert sorted(r.path.rsplit("/", 1)[1] for r in ringfile.corrupt_files(spark, path).collect()) == ["three.wsp", "two.wsp"]
    assert [(r.slot, r.interval, r.value) for r in ringfile.dump(spark, path).orderBy("slot").collect()] == [(0, 103, 4.0), (1, 101, 2.0), (2, 0, 0.0)]
    points = ringfile.read_points(spark, path, path).orderBy("interval").collect()
    assert [(r.series_id, r.interval, r.value) for r in points] == [("a.one", 101, 2.0), ("a.one", 103, 4.0)]


def test_ring_file_round_trip(spark, tmp_path):
    state = [(0, 1000 + i, float(i)) for i in range(60)] + [(1, 900, 1.5)]
    df = spark.createDataFrame([("s", *x) for x in state], "series_id string, level int, interval long, value double")
    (row,) = ringfile.to_files(df, LADDER, "max", 0.42).collect()
    (tmp_path / "s.wsp").write_bytes(row.content)
    head = ringfile.read_header(bytes(row.content))
    assert (head.method, round(head.xff, 6), head.max_retention) == ("max", 0.42, 600)
    assert sorted((r.level, r.interval, r.value) for r in ringfile.read_points(spark, str(tmp_path)).collect()) == sorted(state)
    with pytest.raises(CorruptFile) as e:
        ringfile.read_slots(bytes(row.content)[:100], head, 0, "x")
    assert e.value.path == "x"


def test_text_points(spark):
    lines = spark.createDataFrame([("1000:1.5 1001:2",), ("N:3",), ("bad",), ("x:1 5:y",)], "value string").coalesce(1)
    got = sorted((r.ts, r.value) for r in text.parse_points(lines, 2000, "s").collect())
    assert got == [(1000, 1.5), (1001, 2.0), (2000, 3.0)]


def test_time_range_is_pushed_down(spark):
    df = tables.events(spark, "/root/testdata/sf0.001", start=1704500000, end=1704600000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan and "props" not in plan
    assert df.count() == df.where((F.col("ts") >= 1704500000) & (F.col("ts") < 1704600000)).count() > 0


def raw_rows(spark, rows):
    return spark.createDataFrame([(s, t, float(v), k) for k, (s, t, v) in enumerate(rows)], RAW)


def test_store(spark, tmp_path):
    now = 10_000
    store = Store(spark, str(tmp_path / "st")).create(LADDER, "average", 0.0, shards=4)
    with pytest.raises(InvalidConfiguration, match="already exists"):
        store.create(LADDER)
    store.update_many(raw_rows(spark, [("a", now - 5, 1), ("a", now - 4, 3), ("b", now - 100, 7), ("b", now - 5000, 1)]), now)
    store.update("c", 2.0, now, now)
    got = sorted((r.series_id, r.level, r.interval, r.value) for r in store.points().collect())
    assert got == [("a", 0, 9995, 1.0), ("a", 0, 9996, 3.0), ("a", 1, 9990, 2.0), ("b", 1, 9900, 7.0), ("c", 0, 10000, 2.0), ("c", 1, 10000, 2.0)]
    store.update("a", 5.0, now - 5, now)
    assert {(r.level, r.value) for r in store.points().where("series_id = 'a'").collect()} == {(0, 5.0), (0, 3.0), (1, 4.0)}
    assert sorted(r.value for r in store.fetch(now - 10, now, now, drop="nulls").collect()) == [2.0, 3.0, 5.0]
    assert store.set_method("sum", 0.25) == "average" and store.set_xff(0.5) == 0.25 and store.settings()[:2] == ("sum", 0.5)
    with pytest.raises(InvalidMethod):
        store.set_method("median")
    info = store.info().orderBy("series_id").first()
    assert info.file_size == 16 + 24 + 12 * 120 and [x.offset for x in info.archives] == [40, 760]


def test_stores_together(spark, tmp_path):
    now = 10_000
    a, b = (Store(spark, str(tmp_path / n)).create(LADDER, "sum", 0.0, shards=2) for n in "ab")
    a.update_many(raw_rows(spark, [("s", now - 3, 1), ("s", now - 2, 1)]), now)
    b.update_many(raw_rows(spark, [("s", now - 2, 9), ("s", now - 1, 9)]), now)
    assert b.diff(a, now).where("level = 0").count() == 3
    assert {r.level: (r.total, r.differing) for r in b.diff_summary(a, now, ignore_empty=True).collect()} == {0: (1, 1)}
    b.merge(a, now)
    assert sorted((r.interval, r.value) for r in b.points().where("level = 0").collect()) == [(9997, 1.0), (9998, 1.0), (9999, 9.0)]
    assert b.points().where("level = 1").first().value == 2.0  # the source's own coarse point comes last
    b.transform(lambda i, v: v * 2, now, now - 30)
    assert sorted(r.value for r in b.points().where("level = 0").collect()) == [2.0, 2.0, 18.0]
    a.fill(b, now, "strict")
    assert sorted((r.interval, r.value) for r in a.points().where("level = 0").collect()) == [(9997, 1.0), (9998, 1.0), (9999, 18.0)]
    other = Ladder.of((2, 60), (20, 60))
    b.resize(other, now)
    assert b.settings()[2] == other and sorted(r.interval for r in b.points().where("level = 0").collect()) == [9990, 9996, 9998]  # the coarse point of 9990 is young enough for the fine level
    with pytest.raises(UnlikeLadders):
        a.merge(b, now)
    with pytest.raises(NotImplementedError):
        a.diff(b, now)


def test_bulk_equals_one_call_of_all(spark, tmp_path):
    now = 10_000
    rows = [("s", now - 590 + 7 * k, k) for k in range(80)]
    store = Store(spark, str(tmp_path / "x")).create(LADDER, "max", 0.1, shards=2)
    store.update_many(raw_rows(spark, rows), now)
    empty = spark.createDataFrame([], "series_id string, level int, interval long, value double")
    want = rollup.cascade(empty, align.direct_writes(raw_rows(spark, rows), LADDER, now), LADDER, "max", 0.1)
    key = lambda r: (r.level, r.interval, r.value)
    assert sorted(map(key, store.points().collect())) == sorted(map(key, want.collect()))


def rows_of(store):
    return sorted((r.series_id, r.level, r.interval, r.value) for r in store.points().collect())


def test_series_have_their_own_settings(spark, tmp_path):
    now = 10_000
    own, names = Ladder.of((2, 30), (20, 30)), lambda *x: spark.createDataFrame([(n,) for n in x], "series_id string")
    store = Store(spark, str(tmp_path / "st")).create(LADDER, "average", 0.0, shards=3)
    store.add(names("x", "y"), own, "sum", 0.0)
    rows = [(s, now - k, k) for s in ("a", "x", "y") for k in (0, 1, 2, 3, 70, 71)]
    store.update_many(raw_rows(spark, rows), now)
    empty = spark.createDataFrame([], "series_id string, level int, interval long, value double")
    want = []
    for s, ladder, method in (("a", LADDER, "average"), ("x", own, "sum"), ("y", own, "sum")):
        got = rollup.cascade(empty, align.direct_writes(raw_rows(spark, [r for r in rows if r[0] == s]), ladder, now), ladder, method, 0.0)
        want += [(r.series_id, r.level, r.interval, r.value) for r in got.collect()]
    assert rows_of(store) == sorted(want)
    assert {(r.series_id, r.aggregation_method, r.max_retention) for r in store.info().collect()} == {("a", "average", 600), ("x", "sum", 600), ("y", "sum", 600)}
    assert {r.series_id for r in store.fetch(now - 10, now, now, step=2).collect()} == {"x", "y"}
    assert store.set_method("max", series=names("y")) == "sum" and store.settings()[0] == "average"
    assert {r.series_id: r.aggregation_method for r in store.info().collect()} == {"a": "average", "x": "sum", "y": "max"}
    store.resize(Ladder.of((4, 15), (20, 30)), now, series=names("y"))
    assert {r.series_id: r.archives[0].seconds_per_point for r in store.info().collect()} == {"a": 1, "x": 2, "y": 4}
    assert {r[2] % 4 for r in rows_of(store) if r[0] == "y" and r[1] == 0} == {0}
    other = Store(spark, str(tmp_path / "other")).create(own, "sum", 0.0, shards=2)
    other.update_many(raw_rows(spark, [("x", now, 50), ("z", now, 60)]), now)
    store.merge(other, now)
    assert {r[3] for r in rows_of(store) if r[1] == 0 and r[2] == now and r[0] in "xz"} == {50.0, 60.0}
    assert {r.series_id: r.aggregation_method for r in store.info().collect()}["z"] == "sum"
    assert store.diff(other, now).where("series_id in ('x', 'z') and level = 0").where(f"interval = {now}").count() == 0


def test_what_is_too_old_goes_with_the_next_write(spark, tmp_path):
    store = Store(spark, str(tmp_path / "st")).create(LADDER, "sum", 0.0, shards=1)
    store.update_many(raw_rows(spark, [("s", 10_000, 1)]), 10_000)
    store.update_many(raw_rows(spark, [("s", 10_100, 2)]), 10_100)
    assert rows_of(store) == [("s", 0, 10100, 2.0), ("s", 1, 10000, 1.0), ("s", 1, 10100, 2.0)]
    store.update_many(raw_rows(spark, [("t", 20_000, 3)]), 20_000)
    assert rows_of(store) == [("t", 0, 20000, 3.0), ("t", 1, 20000, 3.0)]


def test_a_write_takes_effect_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    now, root = 10_000, tmp_path / "st"
    store = Store(spark, str(root)).create(LADDER, "sum", 0.0, shards=2)
    store.update_many(raw_rows(spark, [("s", now, 1), ("t", now, 1)]), now)
    before, versions = rows_of(store), lambda: {p.name for t in ("points", "series") for p in (root / t).glob("version=*")}
    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.update_many(raw_rows(spark, [("s", now, 9)]), now)
    assert rows_of(store) == before
    there = versions()
    assert store.vacuum() == 0 and store.vacuum(-1) == 1 and len(versions()) == len(there) - 1 and rows_of(store) == before
    # A second writer that read the same state is refused.
    old = store._manifest()
    store.update_many(raw_rows(spark, [("s", now, 5)]), now)
    with pytest.raises(ConcurrentWrite):
        store._commit(old, old)
    for k in range(4):
        store.update_many(raw_rows(spark, [("s", now, k)]), now)
    assert len(list((root / "points").glob("version=*"))) <= 3 and len(list((root / "manifests").glob("*.json"))) == 2
    store.restore()
    assert ("s", 0, now, 2.0) in rows_of(store)


def test_late_points_are_routed_by_their_time_of_writing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "st")).create(LADDER, "sum", 0.0, shards=1)
    raw = spark.createDataFrame([("s", 9_000, 1.0, 0, 9_000), ("s", 9_500, 2.0, 1, 9_600), ("s", 9_700, 4.0, 2, 9_710), ("s", 8_000, 8.0, 3, 9_710)], RAW + ", written long")
    store.update_many(raw, 9_710, clock="written")
    got = [r for r in rows_of(store)]
    assert ("s", 1, 9500, 2.0) in got and ("s", 0, 9700, 4.0) in got and not [r for r in got if r[1] == 0 and r[2] == 9500]
    assert not [r for r in got if r[2] < 9_110]  # 8000 was too late, 9000 is too old by now


def test_ring_files_into_a_store(spark, tmp_path):
    (tmp_path / "f" / "a").mkdir(parents=True)
    (tmp_path / "f" / "a" / "one.wsp").write_bytes(ringfile.write_file(LADDER, "sum", 0.25, {0: [(9990, 1.0)], 1: [(9990, 2.0)]}))
    (tmp_path / "f" / "two.wsp").write_bytes(ringfile.write_file(Ladder.of((5, 10)), "max", 0.5, {0: [(9995, 3.0)]}))
    (tmp_path / "f" / "bad.wsp").write_bytes(b"bad")
    store = Store(spark, str(tmp_path / "st")).create(LADDER, shards=2)
    broken = store.load_files(str(tmp_path / "f"), str(tmp_path / "f")).collect()
    assert [r.path.rsplit("/", 1)[1] for r in broken] == ["bad.wsp"]
    assert rows_of(store) == [("a.one", 0, 9990, 1.0), ("a.one", 1, 9990, 2.0), ("two", 0, 9995, 3.0)]
    assert {(r.series_id, r.aggregation_method, len(r.archives)) for r in store.info().collect()} == {("a.one", "sum", 2), ("two", "max", 1)}
