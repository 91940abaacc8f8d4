import re
import math
import random

import pytest
from pyspark.sql import functions as F

from tierfold.functions import columns
from tierfold.functions.config import METHODS, InvalidInterval, InvalidMethod, Ladder, NotCovered, UnlikeLadders
from tierfold.operators import align, compare, read, regrid, replay, rollup, rules

POINTS = "series_id string, level int, interval long, value double"
RAW = "series_id string, ts long, value double, arrival long"
LADDER = Ladder.of((1, 60), (10, 60), (60, 60))


def frame(spark, rows, ddl=POINTS):
    return spark.createDataFrame(rows, ddl)


def rows_of(df):
    return sorted((r.series_id, r.level, r.interval, round(r.value, 9)) for r in df.collect())


@pytest.mark.parametrize(
    ("method", "values", "want"),
    [("min", [1, 2, 3, 4], 1), ("max", [1, 2, 3, 4], 4), ("last", [3, 2, 5, 4], 4), ("sum", [10, 2, 3, 4], 19), ("average", [1, 2, 3, 4], 2.5), ("absmax", [-3, -2, 1, 2], -3), ("absmax", [-2, -1, 2, 3], 3), ("absmin", [-3, -2, 1, 2], 1), ("absmin", [-2, -1, 2, 3], -1), ("absmax", [-3, 3, 1], -3)],
)
def test_methods(spark, method, values, want):
    df = frame(spark, [("a", 0, i, float(v)) for i, v in enumerate(values)])
    assert rollup.roll_up(df, 1, 10, method, 0.0).first().value == want == replay.reduce_known(method, values, len(values))


def test_avg_zero_and_unknown(spark):
    df = frame(spark, [("a", 0, i, float(v)) for i, v in enumerate([1, 2, 3, 4])])
    assert rollup.roll_up(df, 1, 8, "avg_zero", 0.5).first().value == 1.25
    with pytest.raises(InvalidMethod):
        rollup.roll_up(df, 1, 8, "median", 0.5)


def test_gate_is_float32(spark):
    df = frame(spark, [("a", 0, i, 1.0) for i in range(2)])
    # One fifth as a 32-bit float is above one fifth; 0.7 is below.
    assert rollup.roll_up(df, 1, 10, "sum", 0.2).count() == 0
    df = frame(spark, [("a", 0, i, 1.0) for i in range(7)])
    assert rollup.roll_up(df, 1, 10, "sum", 0.7).count() == 1


def test_last_write_and_ties(spark):
    raw = frame(spark, [("a", 11, 1.0, 0), ("a", 19, 2.0, 1), ("a", 19, 3.0, 2), ("a", 15, 4.0, 3), ("a", 20, None, 4), ("b", -3, 5.0, 5)], RAW)
    got = {(r.series_id, r.interval): r.value for r in align.last_write_wins(raw, 10).collect()}
    assert got == {("a", 10): 2.0, ("b", -10): 5.0}


def test_routing(spark):
    now = 1000
    raw = frame(spark, [("a", now - age, float(age), age) for age in (-5, 0, 60, 61, 600, 601, 3600, 3601)], RAW)
    got = {r.arrival: r.level for r in align.routed(raw, LADDER, now).collect()}
    assert got == {0: 0, 60: 0, 61: 1, 600: 1, 601: 2, 3600: 2}
    assert -5 in {r.arrival for r in align.routed(raw, LADDER, now, "accept").collect()}
    assert {r.arrival: r.reason for r in align.dropped(raw, LADDER, now).collect()} == {-5: "future", 3601: "too old"}
    assert align.check_single(now, LADDER, now) == 0
    for ts in (now + 1, now - 3600):
        with pytest.raises(NotCovered):
            align.check_single(ts, LADDER, now)


@pytest.mark.parametrize("method", sorted(METHODS))
@pytest.mark.parametrize("colocate", [True, False])
def test_chain_as_replay(spark, method, colocate):
    """Points written in time one by one give what the batch gives, within what each level keeps."""
    rng = random.Random(method)
    now = 100_000
    points = sorted({(rng.choice("ab"), rng.randrange(now - 900, now)) for _ in range(500)}, key=lambda x: x[1])
    rows = [(s, t, rng.uniform(-9, 9), k, t) for k, (s, t) in enumerate(points)]
    raw = spark.createDataFrame(rows, RAW + ", now long")
    for xff in (0.0, 0.3):
        one = replay.replay(raw, LADDER, method, xff)
        batch = rollup.chain(raw.drop("now"), LADDER, method, xff, colocate)
        keep = F.col("interval") > now - F.element_at(F.array(F.lit(50), F.lit(590), F.lit(3500)), F.col("level") + 1)
        assert rows_of(one.where(keep)) == rows_of(batch.where(keep))


def test_chain_shuffles_once(spark):
    raw = frame(spark, [("a", t, 1.0, t) for t in range(100)], RAW)

    def ran(colocate):
        df = rollup.chain(raw, LADDER, "average", 0.5, colocate)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "isFinalPlan=true" in plan
        # An exchange that is reused is printed again below each ReusedExchange, without its stage.
        return len(re.findall(r"ShuffleQueryStage", plan)) - len(re.findall(r"ReusedExchange", plan))

    assert ran(True) == 1 < ran(False)


def test_mixed_methods(spark):
    df = frame(spark, [(s, 0, i, float(i)) for s in "ab" for i in range(4)]).withColumn("aggregation_method", F.when(F.col("series_id") == "a", "sum").otherwise("max"))
    assert {r.series_id: r.value for r in rollup.roll_up(df, 1, 4, ["sum", "max"], 0.5).collect()} == {"a": 6.0, "b": 3.0}


def test_cascade_precedence(spark):
    state = frame(spark, [("a", 1, 0, 5.0), ("a", 1, 10, 6.0), ("a", 0, 10, 1.0)])
    writes = frame(spark, [("a", 0, 11, 3.0), ("a", 0, 20, 9.0), ("a", 1, 20, 4.0)])
    got = rows_of(rollup.cascade(state, writes, LADDER, "sum", 0.1))
    assert [x for x in got if x[1] == 1] == [("a", 1, 0, 5.0), ("a", 1, 10, 4.0), ("a", 1, 20, 4.0)]


def test_read_windows():
    now = 1_000_000
    one = Ladder.of((1, 60))
    assert read.select_window(one, now, now, now) == read.Window(0, now + 1, now + 2, 1)
    assert read.select_window(one, now + 1, now + 2, now) is None
    assert read.select_window(one, 0, now - 61, now) is None
    with pytest.raises(InvalidInterval):
        read.select_window(one, now, now - 1, now)
    four = Ladder.of((1, 60), (60, 60), (3600, 24), (86400, 365))
    w = read.select_window(four, 0, None, 1_700_000_000)
    assert (w.step, w.slots) == (86400, 365)
    assert [read.select_window(four, now - 30, now, now, s).step for s in (1, 60, 3600, 86400)] == [1, 60, 3600, 86400]
    with pytest.raises(ValueError, match="step of 2 s"):
        read.select_window(four, now - 30, now, now, 2)
    assert read.select_window(four, now - 60, now, now).step == 1 and read.select_window(four, now - 61, now, now).step == 60


def test_fetch_and_drops(spark):
    now = 1000
    df = frame(spark, [("a", 0, 998, 1.0), ("a", 0, 999, 0.0), ("a", 0, 930, 7.0), ("b", 1, 990, 2.0)])
    got = {(r.series_id, r.interval): r.value for r in read.fetch(df, LADDER, 996, 1000, now).collect()}
    assert got == {(s, t): {("a", 998): 1.0, ("a", 999): 0.0}.get((s, t)) for s in "ab" for t in (997, 998, 999, 1000)}
    counts = [read.fetch(df, LADDER, 996, 1000, now, drop=d).count() for d in (None, "nulls", "zeroes", "empty")]
    assert counts == [8, 2, 7, 1]
    # An old slot of the ring isn't what the level keeps.
    assert read.fetch(df, LADDER, 900, 1000, now, step=1).where("value = 7").count() == 0
    assert read.as_json(read.fetch(df, LADDER, 997, 999, now).where("series_id = 'a'"), 1).first().json == '{"start":998,"end":1000,"step":1,"values":[1.0,0.0]}'
    assert read.fetch(df, LADDER, 2000, 2001, now) is None


def test_diff(spark):
    now, nan = 1000, float("nan")
    two = Ladder.of((1, 60), (60, 60))
    a, b = frame(spark, [("s", 0, now, 1.0)]), frame(spark, [("s", 0, now, 2.0)])
    assert [tuple(r) for r in compare.diff(a, b, two, now).collect()] == [("s", 0, now, 1.0, 2.0)]
    assert {r.level: (r.total, r.differing) for r in compare.diff_summary(a, b, two, now).collect()} == {0: (1, 1)}
    a = frame(spark, [("s", 0, now, 1.0), ("s", 0, now - 1, nan), ("s", 0, now - 2, 3.0), ("s", 0, now - 3, nan)])
    b = frame(spark, [("s", 0, now, 2.0), ("s", 0, now - 2, 3.0), ("s", 0, now - 3, nan)])
    assert sorted(r.interval for r in compare.diff(a, b, two, now).collect()) == [now - 3, now - 1, now]
    assert sorted(r.interval for r in compare.diff(a, b, two, now, ignore_empty=True).collect()) == [now - 3, now]
    # What the fine level still keeps isn't compared in the coarse one.
    a, b = frame(spark, [("s", 1, 960, 1.0), ("s", 1, 900, 1.0)]), frame(spark, [("s", 1, 960, 2.0)])
    assert [r.interval for r in compare.diff(a, b, two, now).collect()] == [900]
    with pytest.raises(UnlikeLadders):
        compare.check_alike(two, LADDER)


def test_merge(spark):
    now = 1000
    source = frame(spark, [("a", 0, 995, 9.0), ("a", 1, 900, 8.0), ("b", 0, 996, 1.0)])
    target = frame(spark, [("a", 0, 995, 1.0), ("a", 0, 994, 2.0), ("a", 1, 900, 3.0), ("a", 1, 890, 4.0)])
    got = rows_of(compare.merge(source, target, LADDER, now, "sum", 0.0))
    assert {("a", 0, 994, 2.0), ("a", 0, 995, 9.0), ("a", 1, 990, 11.0), ("a", 1, 900, 8.0), ("a", 1, 890, 4.0), ("b", 0, 996, 1.0), ("b", 1, 990, 1.0)} <= set(got)
    with pytest.raises(ValueError):
        compare.merge(source, target, LADDER, now, "sum", 0.0, 10, 5)


def model_fill(source, target, ladder, now, method, xff):
    """Gap by gap over rings held in memory; source and target: {(level, interval): value} of one series."""
    rings = replay.Rings(ladder, method, xff)
    for (k, i), v in target.items():
        rings.put(k, i, v)
    end = now
    for k, x in enumerate(ladder.levels):
        start = now - x.retention
        if start >= end:
            continue
        w = read.grid_window(k, x.step, start, end)
        values = [(t, rings.get(k, t) if t > start else None) for t in range(w.lo, w.hi, x.step)]
        writes, gap = [], None
        for t, v in values:
            if not v and gap is None:
                gap = t
            elif v and gap is not None:
                if t - gap > x.step:
                    writes.append((gap - x.step, t))
                gap = None
            elif gap is not None and t == w.hi - x.step:
                writes.append((gap - x.step, t))
        points = {}
        for lo, hi in writes:
            for j, y in enumerate(ladder.levels):
                old = now - y.retention
                if hi <= old:
                    continue
                a = max(old, lo)
                points.update({i: v for (kk, i), v in source.items() if kk == j and a < i <= hi})
                hi = a
                if lo == hi:
                    break
        by_level = {}
        for i, v in sorted(points.items()):
            kk = ladder.level_for(now - i)
            by_level.setdefault(kk, {})[i - i % ladder[kk].step] = v
        fresh = set()
        for kk in range(len(ladder)):
            up = {}
            for b in fresh:
                fine, coarse = ladder[kk - 1], ladder[kk]
                found = [rings.get(kk - 1, t) for t in range(b, b + coarse.step, fine.step)]
                known = [v for v in found if v is not None]
                if known and len(known) / len(found) >= rings.xff:
                    up[b] = replay.reduce_known(method, known, len(found))
            for i, v in (up | by_level.get(kk, {})).items():
                rings.put(kk, i, v)
            if kk + 1 < len(ladder):
                fresh = {i - i % ladder[kk + 1].step for i in (up | by_level.get(kk, {}))}
        end = start
    return {(k, i): v for k, i, v in rings.rows()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fill_as_model(spark, seed):
    rng = random.Random(seed)
    now = 60_000
    ladder = Ladder.of((1, 60), (10, 30), (60, 20))
    source = {(k, i): rng.uniform(1, 9) for k, x in enumerate(ladder.levels) for i in range((now - x.retention) // x.step * x.step + x.step, now + 1, x.step) if rng.random() < 0.8}
    target = {q: v for q, v in source.items() if rng.random() < 0.5}
    target = {q: (0.0 if rng.random() < 0.1 else v + 1) for q, v in target.items()}
    as_rows = lambda m: [("s", k, i, v) for (k, i), v in m.items()]
    got = compare.fill(frame(spark, as_rows(source)), frame(spark, as_rows(target)), ladder, ladder, now, "average", 0.2)
    want = model_fill(source, target, ladder, now, "average", 0.2)
    # In the model's rings a point as old as the level keeps takes the slot of the newest.
    keep = lambda k, i: now - ladder[k].retention + ladder[k].step < i < now // ladder[k].step * ladder[k].step
    assert {(r.level, r.interval): round(r.value, 9) for r in got.collect() if keep(r.level, r.interval)} == {q: round(v, 9) for q, v in want.items() if keep(*q)}
    strict = compare.fill(frame(spark, as_rows(source)), frame(spark, as_rows(target)), ladder, ladder, now, "average", 0.2, mode="strict")
    inside = {q: v for q, v in target.items() if q[1] > now - ladder[q[0]].retention}
    assert inside.items() <= {(r.level, r.interval): r.value for r in strict.collect()}.items()


def test_resize(spark):
    """Two days of minutes to a day of minutes and two of five minutes, and back."""
    now = 1_700_000_000
    old, mid = Ladder.of("60:2880"), Ladder.of("60s:1d", "300s:2d")
    state = frame(spark, [("s", 0, now // 60 * 60 - 60 * i, float(i)) for i in range(2880)])
    down = regrid.resize(state, old, mid, now, "average", 0.5)
    at = now - 25 * 3600
    grid = read.fetch(down, mid, at, at + 600, now).collect()
    assert len(grid) == 2 and all(r.value is not None for r in grid)
    back = regrid.resize(down, mid, old, now, "average", 0.5)
    grid = read.fetch(back, old, at, at + 600, now).collect()
    assert len(grid) == 10 and sum(r.value is not None for r in grid) == 2


@pytest.mark.parametrize("aligned", [False, True])
def test_resize_aggregate(spark, aligned):
    now, xff, method = 100_003, 0.4, "sum"
    old, new = Ladder.of((10, 30), (60, 20)), Ladder.of((20, 12), (120, 12))
    rng = random.Random(4)
    state = {(k, i): float(rng.randrange(100)) for k, x in enumerate(old.levels) for i in range((now - x.retention) // x.step * x.step + x.step, now + 1, x.step) if rng.random() < 0.6}
    points = {}
    for k, x in enumerate(old.levels):
        w = read.select_window(old, now - x.retention + x.step, now, now)
        first = min(points, default=None)
        for t in range(w.lo, w.hi, w.step):
            if first is None or t < first:
                points[t] = state.get((w.level, t))
    raw = []
    for x in new.levels:
        start = now - x.retention + now % x.step
        if aligned:
            buckets = sorted({t - t % x.step for t in points if start <= t < start + x.points * x.step})
        else:
            buckets = [start + j * x.step for j in range(x.points)]
        for b in buckets:
            inside = [v for t, v in sorted(points.items()) if b <= t < b + x.step and start <= t < start + x.points * x.step]
            known = [v for v in inside if v is not None]
            if known and len(known) / len(inside) >= xff:
                raw.append((x, b, sum(known)))
    want = frame(spark, [])
    for x in new.levels:
        rows = frame(spark, [("s", b, v, 0) for y, b, v in raw if y == x], RAW)
        want = rollup.cascade(want, align.direct_writes(rows, new, now, "accept"), new, method, xff)
    got = regrid.resize_aggregate(frame(spark, [("s", k, i, v) for (k, i), v in state.items()]), old, new, now, method, xff, aligned)
    assert rows_of(got) == rows_of(want) and len(rows_of(got)) > 10


def test_gaps(spark):
    grid = frame(spark, [("a", 0, 10 * i, v) for i, v in enumerate([None, 1.0, None, None, 2.0, 0.0, None])]).drop("level")
    got = sorted((r.gap_start, r.gap_end, r.slots, r.closed_by) for r in compare.gaps(grid, 10).collect())
    assert got == [(0, 0, 1, 10), (20, 30, 2, 40), (60, 60, 1, None)]
    assert (50, 60, 2, None) in [(r.gap_start, r.gap_end, r.slots, r.closed_by) for r in compare.gaps(grid, 10, True).collect()]


def test_columns(spark):
    r = spark.range(1).select(
        columns.floor_to_step(F.lit(-7), 3).alias("a"), columns.ceil_to_step(F.lit(7), 3).alias("b"), columns.ring_slot(F.lit(-20), 10, 3).alias("c"), columns.byte_format(F.lit(20480)).alias("d"),
        columns.metric_name(F.lit("/data/x/cpu/load.wsp"), "/data").alias("e"), columns.tsv_line(F.lit(5), F.lit(None).cast("double")).alias("f"), columns.byte_format(F.lit(3 << 30)).alias("g"),
    ).first()
    assert tuple(r) == (-9, 9, 1, "20.000 KB", "x.cpu.load", "5\tNone", "3.000 GB")


def test_rules(spark):
    wanted = rules.apply_rules(spark.createDataFrame([("x.cpu",), ("cpu.x",), ("disk",)], "name string"), [rules.Rule("^cpu", "10s:1d"), rules.Rule("cpu", "1m:1d")], [rules.Rule("disk", xff=0.1, method="max")])
    assert {r.name: (r.rule, r.retentions, round(r.xff, 6), r.method) for r in wanted.collect()} == {"x.cpu": (1, "1m:1d", 0.5, "average"), "cpu.x": (0, "10s:1d", 0.5, "average"), "disk": (None, "1m:7d", 0.1, "max")}
    t = rules.transform(frame(spark, [("a", 0, 1, 2.0), ("a", 0, 2, None)]), lambda i, v: v * 1024)
    assert [r.value for r in t.orderBy("interval").collect()] == [2048.0, None]
    assert math.isclose(rules.estimate(spark.createDataFrame([("a", 1440)], "schema_id string, points long")).where("metrics = 1000").first().disk_bytes, 20480_000)


def test_replay_keeps_what_batch_drops(spark):
    """A late point after part of its bucket has left the fine ring overwrites the rollup with what is left."""
    ladder = Ladder.of((1, 60), (60, 60))
    rows = [("a", t, 1.0, k, t) for k, t in enumerate(range(6000, 6120))] + [("a", 6059, 5.0, 500, 6118)]
    raw = spark.createDataFrame(rows, RAW + ", now long")
    got = {r.interval: r.value for r in replay.replay(raw, ladder, "sum", 0.0).where("level = 1").collect()}
    assert got[6000] == 5.0 and got[6060] == 60.0
