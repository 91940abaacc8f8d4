"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierfold.functions.columns import ring_slot, tsv_line
from tierfold.functions.config import METHODS, Ladder
from tierfold.operators import align, compare, read, regrid, replay, rollup, rules
from tierfold.sources import tables, text
from tierfold.sources.shared import settle
from tierfold.streaming import ingest

NOW, OLD_NOW = 1706659200, 1004918400
S = Ladder.of("1h:7d", "6h:14d", "1d:60d")
U = Ladder.of("1d:30d", "7d:1y")
L = Ladder.of("1d:2y", "7d:8y")
SHORT = Ladder.of("1h:2d", "6h:4d", "1d:6d")

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _queries[name] = query
    if sql is not None:
        _sql[name] = sql


def _round(x: str | Column = "value") -> Column:
    return F.round(x, 6)


# --- SQL building blocks; i and v stand for interval and value.


def _raw(where: str = "true", series: str = "event_type") -> str:
    return f"SELECT CAST({series} AS VARCHAR) AS s, epoch_us(ts) // 1000000 AS t, value AS v, event_id AS a FROM events WHERE value IS NOT NULL AND {where}"


RAW_L = "SELECT l_returnflag AS s, epoch_us(l_shipdate) // 1000000 AS t, l_quantity AS v, l_orderkey * 10 + l_linenumber AS a FROM lineitem WHERE l_quantity IS NOT NULL"
RAW_O = "SELECT o_orderpriority AS s, epoch_us(o_orderdate) // 1000000 AS t, o_totalprice AS v, o_orderkey AS a FROM orders WHERE o_totalprice IS NOT NULL"


def _slots(raw: str, step: int) -> str:
    return f"SELECT s, t - t % {step} AS i, arg_max(v, (t, -a)) AS v FROM ({raw}) GROUP BY 1, 2"


AGG = {
    "average": "avg(v)",
    "sum": "sum(v)",
    "last": "arg_max(v, i)",
    "max": "max(v)",
    "min": "min(v)",
    "avg_zero": "sum(v) / {n}",
    "absmax": "arg_max(v, (abs(v), -i))",
    "absmin": "arg_min(v, (abs(v), i))",
}


def _up(src: str, fine: int, coarse: int, method: str, xff: float) -> str:
    n = coarse // fine
    return f"SELECT s, i - i % {coarse} AS i, {AGG[method].format(n=n)} AS v FROM ({src}) GROUP BY s, i - i % {coarse} HAVING count(v) / {n}.0 >= CAST({xff} AS FLOAT)::DOUBLE"


def _chain(raw: str, ladder: Ladder, method: str, xff: float) -> list[str]:
    out = [_slots(raw, ladder[0].step)]
    for k in range(1, len(ladder)):
        out.append(_up(out[-1], ladder[k - 1].step, ladder[k].step, method, xff))
    return out


def _levels(parts: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT s, {k} AS l, i, v FROM ({p})" for k, p in enumerate(parts))


def _out(src: str, level: bool = False, exact: bool = False) -> str:
    return f'SELECT s AS series_id, {"CAST(l AS INTEGER) AS level, " if level else ""}i AS "interval", {"v" if exact else "round(v, 6)"} AS value FROM ({src})'


# --- Alignment and routing


_add("align_last_write", lambda s, d: align.last_write_wins(tables.events(s, d), 3600), _out(_slots(_raw(), 3600), exact=True))
_add("align_last_write_ties", lambda s, d: align.last_write_wins(tables.lineitem(s, d), 86400), _out(_slots(RAW_L, 86400), exact=True))
_add(
    "route_by_age",
    lambda s, d: align.routed(tables.events(s, d), S, NOW).groupBy("series_id", "level").agg(F.count("*").alias("points"), F.max("ts").alias("newest")),
    "SELECT s AS series_id, CAST(CASE WHEN age <= 604800 THEN 0 WHEN age <= 1209600 THEN 1 ELSE 2 END AS INTEGER) AS level, count(*) AS points, max(t) AS newest "
    f"FROM (SELECT *, {NOW} - t AS age FROM ({_raw()})) WHERE age BETWEEN 0 AND 5184000 GROUP BY 1, 2",
)
_add(
    "dropped_points",
    lambda s, d: align.dropped(tables.events(s, d), SHORT, NOW - 10 * 86400).select("series_id", "ts", "arrival", "reason"),
    f"SELECT s AS series_id, t AS ts, a AS arrival, CASE WHEN t > {NOW - 864000} THEN 'future' ELSE 'too old' END AS reason FROM ({_raw()}) WHERE t > {NOW - 864000} OR {NOW - 864000} - t > 518400",
)


def _direct(raw: str, ladder: Ladder, now: int, future: bool = False) -> list[str]:
    out, newer = [], -now if future else -1
    for x in ladder.levels:
        out.append(_slots(f"SELECT * FROM ({raw}) WHERE {now} - t > {newer} AND {now} - t <= {x.retention}", x.step))
        newer = x.retention
    return out


_add("bulk_direct_writes", lambda s, d: align.direct_writes(tables.events(s, d), S, NOW).select("series_id", "level", "interval", "value"), _out(_levels(_direct(_raw(), S, NOW)), True, True))


def _bulk(raw: str, ladder: Ladder, now: int, method: str, xff: float) -> list[str]:
    """Direct writes win over rollups of the level below."""
    direct = _direct(raw, ladder, now)
    out = [direct[0]]
    for k in range(1, len(ladder)):
        up = _up(out[-1], ladder[k - 1].step, ladder[k].step, method, xff)
        out.append(f"SELECT s, i, arg_max(v, p) AS v FROM (SELECT s, i, v, 2 AS p FROM ({direct[k]}) UNION ALL SELECT s, i, v, 1 AS p FROM ({up})) GROUP BY 1, 2")
    return out


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "series_id string, level int, interval long, value double")


_add(
    "bulk_ingest",
    lambda s, d: rollup.cascade(_empty(s), align.direct_writes(tables.events(s, d), S, NOW), S, "average", 0.5).withColumn("value", _round()),
    _out(_levels(_bulk(_raw(), S, NOW, "average", 0.5)), True),
)

# --- Rollups


def _rollup(method: str) -> Query:
    return lambda s, d: rollup.roll_up(align.last_write_wins(tables.events(s, d), 3600), 3600, 21600, method, 0.1).withColumn("value", _round())


for _m in METHODS:
    _add(f"rollup_{_m}", _rollup(_m), _out(_up(_slots(_raw(), 3600), 3600, 21600, _m, 0.1)))
_add("rollup_chain3", lambda s, d: rollup.chain(tables.events(s, d), S, "average", 0.5).withColumn("value", _round()), _out(_levels(_chain(_raw(), S, "average", 0.5)), True))
_add("rollup_chain3_sum", lambda s, d: rollup.chain(tables.events(s, d), S, "sum", 0.0, colocate=False).withColumn("value", _round()), _out(_levels(_chain(_raw(), S, "sum", 0.0)), True))
_add("rollup_lineitem", lambda s, d: rollup.chain(tables.lineitem(s, d), L, "average", 0.5).withColumn("value", _round()), _out(_levels(_chain(RAW_L, L, "average", 0.5)), True))
_add("rollup_orders", lambda s, d: rollup.chain(tables.orders(s, d), L, "absmax", 0.75).withColumn("value", _round()), _out(_levels(_chain(RAW_O, L, "absmax", 0.75)), True))
_add("rollup_xff_float32", lambda s, d: rollup.chain(tables.events(s, d, "user_id"), U, "max", 0.6).withColumn("value", _round()), _out(_levels(_chain(_raw(series="user_id"), U, "max", 0.6)), True))
_add(
    "rollup_retained",
    lambda s, d: rollup.retained(rollup.chain(tables.events(s, d), S, "average", 0.5), S, NOW).withColumn("value", _round()),
    _out(f"SELECT * FROM ({_levels(_chain(_raw(), S, 'average', 0.5))}) WHERE i > {NOW} - CASE l WHEN 0 THEN 604800 WHEN 1 THEN 1209600 ELSE 5184000 END", True),
)
_MIXED = ["average", "sum", "max"]
_add(
    "rollup_mixed_methods",
    lambda s, d: rollup.roll_up(
        align.last_write_wins(tables.events(s, d), 3600).withColumn("aggregation_method", F.element_at(F.array(*map(F.lit, _MIXED)), F.length("series_id") % 3 + 1)), 3600, 21600, _MIXED, 0.5
    ).withColumn("value", _round()),
    " UNION ALL ".join(_out(f"SELECT * FROM ({_up(_slots(_raw(), 3600), 3600, 21600, m, 0.5)}) WHERE length(s) % 3 = {k}") for k, m in enumerate(_MIXED)),
)

# --- Reads


def _state(spark: SparkSession, d: str) -> DataFrame:
    return rollup.chain(tables.events(spark, d), S, "average", 0.1)


_STATE = _levels(_chain(_raw(), S, "average", 0.1))


def _grid_sql(w: read.Window, ladder: Ladder, where: str = "true") -> str:
    oldest = NOW - ladder[w.level].retention
    return (
        f"SELECT g.s AS series_id, g.i AS \"interval\", round(p.v, 6) AS value FROM (SELECT s, unnest(range({w.lo}, {w.hi}, {w.step})) AS i FROM (SELECT DISTINCT s FROM ({_STATE}))) g "
        f"LEFT JOIN (SELECT * FROM ({_STATE}) WHERE l = {w.level} AND i > {oldest}) p ON p.s = g.s AND p.i = g.i WHERE {where}"
    )


def _fetch(start: int, end: int | None, step: int | None = None, drop: str | None = None) -> Query:
    return lambda s, d: read.fetch(_state(s, d), S, start, end, NOW, step, drop=drop).withColumn("value", _round())


_DROPS = {None: "true", "nulls": "p.v IS NOT NULL", "zeroes": "p.v IS NULL OR p.v <> 0", "empty": "p.v IS NOT NULL AND p.v <> 0"}
for _name, _start, _end, _step, _drop in (
    ("fetch_auto", NOW - 6 * 86400, NOW - 86400, None, None),
    ("fetch_auto_coarse", NOW - 40 * 86400, None, None, None),
    ("fetch_explicit", NOW - 10 * 86400, NOW - 2 * 86400, 21600, None),
    ("fetch_explicit_beyond_retention", NOW - 20 * 86400, NOW, 3600, None),
    ("fetch_single_point", NOW - 7200, NOW - 7200, None, None),
    ("fetch_empty_grid", NOW, NOW, None, None),
    ("fetch_drop_nulls", NOW - 13 * 86400, NOW, None, "nulls"),
    ("fetch_drop_zeroes", NOW - 13 * 86400, NOW, None, "zeroes"),
    ("fetch_drop_empty", NOW - 13 * 86400, NOW, None, "empty"),
):
    _add(_name, _fetch(_start, _end, _step, _drop), _grid_sql(read.select_window(S, _start, _end, NOW, _step), S, _DROPS[_drop]))
_WEEK = read.select_window(S, NOW - 12 * 86400, NOW - 9 * 86400, NOW)
_add(
    "fetch_array",
    lambda s, d: read.as_arrays(read.fetch(_state(s, d), S, NOW - 12 * 86400, NOW - 9 * 86400, NOW), _WEEK.step).select(
        "series_id", "start", "end", "step", F.array_join(F.transform("values", lambda v: F.coalesce(F.format_string("%.4f", v), F.lit("null"))), ",").alias("values")
    ),
    f"SELECT series_id, min(\"interval\") AS start, max(\"interval\") + {_WEEK.step} AS \"end\", CAST({_WEEK.step} AS BIGINT) AS step, string_agg(coalesce(printf('%.4f', value), 'null'), ',' ORDER BY \"interval\") AS \"values\" FROM ({_grid_sql(_WEEK, S)}) GROUP BY 1",
)
_add(
    "fetch_tsv",
    lambda s, d: read.fetch(_state(s, d), S, NOW - 12 * 86400, NOW - 9 * 86400, NOW).select("series_id", tsv_line("interval", _round()).alias("line")),
    f"SELECT series_id, CAST(\"interval\" AS VARCHAR) || chr(9) || coalesce(printf('%f', value), 'None') AS line FROM ({_grid_sql(_WEEK, S)})",
)

# --- Two series: even and odd events


def _half(spark: SparkSession, d: str, odd: int) -> DataFrame:
    return rollup.chain(tables.events(spark, d).where(F.col("arrival") % 2 == odd), S, "average", 0.1)


def _half_sql(odd: int) -> str:
    return _levels(_chain(_raw(f"event_id % 2 = {odd}"), S, "average", 0.1))


def _merge_sql(start: int, end: int) -> str:
    windows = [read.grid_window(k, x.step, max(start, NOW - x.retention), end) for k, x in enumerate(S.levels) if end >= NOW - x.retention]
    inside = {w.level: f"i >= {w.lo} AND i < {w.hi}" for w in windows}
    parts: list[str] = []
    up: str | None = None
    for k, x in enumerate(S.levels):
        tiers = [f"SELECT s, i, v, 0 AS p FROM ({_half_sql(1)}) WHERE l = {k}", f"SELECT s, i, v, 2 AS p FROM ({_half_sql(0)}) WHERE l = {k} AND {inside.get(k, 'false')}"]
        if up:
            tiers.append(f"SELECT s, i, v, 1 AS p FROM ({up})")
        now = f"SELECT s, i, arg_max(v, p) AS v, max(p) AS p FROM ({' UNION ALL '.join(tiers)}) GROUP BY 1, 2"
        parts.append(now)
        if k + 1 < len(S):
            coarse, n = S[k + 1].step, S[k + 1].step // x.step
            up = f"SELECT s, i - i % {coarse} AS i, avg(v) AS v FROM ({now}) GROUP BY s, i - i % {coarse} HAVING count(v) / {n}.0 >= CAST(0.5 AS FLOAT)::DOUBLE AND max(p) > 0"
    return _out(_levels(parts), True)


def _merged(start: int, end: int) -> Query:
    # Settled, as stores would hold them: each level reads them.
    return lambda s, d: compare.merge(settle(_half(s, d, 0)), settle(_half(s, d, 1)), S, NOW, "average", 0.5, start, end).withColumn("value", _round())


_add("merge_overlay", _merged(0, NOW), _merge_sql(0, NOW))
_add("merge_window", _merged(NOW - 9 * 86400, NOW - 2 * 86400), _merge_sql(NOW - 9 * 86400, NOW - 2 * 86400))


def _exact_state(s: SparkSession, d: str) -> DataFrame:
    """Rounded, as sums in another order differ in their last bits."""
    return _state(s, d).withColumn("value", _round())


_EXACT_STATE = f"SELECT s, l, i, round(v, 6) AS v FROM ({_STATE})"


def _changed(points: DataFrame) -> DataFrame:
    """Some values changed, some NaN, some gone, by a rule on the interval."""
    k = F.floor(F.col("interval") / 3600) % 11
    value = F.when(k == 1, F.col("value") + 1).when(k == 2, F.lit(float("nan"))).otherwise(F.col("value"))
    return points.where(k != 3).withColumn("value", value)


_CHANGED = f"SELECT s, l, i, CASE (i // 3600) % 11 WHEN 1 THEN v + 1 WHEN 2 THEN 'nan'::DOUBLE ELSE v END AS v FROM ({_EXACT_STATE}) WHERE (i // 3600) % 11 <> 3"


def _compared_sql(ignore: bool) -> str:
    inside = " OR ".join(f"(l = {w.level} AND i >= {w.lo} AND i < {w.hi})" for w in compare.diff_windows(S, NOW))
    side = lambda src: f"(SELECT * FROM ({src}) WHERE {inside})"
    return f"SELECT coalesce(x.s, y.s) AS s, coalesce(x.l, y.l) AS l, coalesce(x.i, y.i) AS i, x.v AS va, y.v AS vb FROM {side(_EXACT_STATE)} x {'JOIN' if ignore else 'FULL JOIN'} {side(_CHANGED)} y ON x.s = y.s AND x.l = y.l AND x.i = y.i"


_DIFFERS = "(va IS DISTINCT FROM vb OR (isnan(va) AND isnan(vb)))"


def _diffed(ignore: bool) -> Query:
    def query(s, d):
        state = _exact_state(s, d)
        return compare.diff(state, _changed(state), S, NOW, ignore_empty=ignore).select("series_id", "level", "interval", _round("a").alias("a"), _round("b").alias("b"))

    return query


def _diff_sql(ignore: bool) -> str:
    return f'SELECT s AS series_id, CAST(l AS INTEGER) AS level, i AS "interval", round(va, 6) AS a, round(vb, 6) AS b FROM ({_compared_sql(ignore)}) WHERE {_DIFFERS}'


_add("diff_detail", _diffed(False), _diff_sql(False))
_add("diff_ignore_empty", _diffed(True), _diff_sql(True))


def _diff_summary(s: SparkSession, d: str) -> DataFrame:
    state = _exact_state(s, d)
    return compare.diff_summary(state, _changed(state), S, NOW, by=("series_id",))


_add("diff_summary", _diff_summary, f"SELECT s AS series_id, CAST(l AS INTEGER) AS level, count(*) AS total, count(*) FILTER (WHERE {_DIFFERS}) AS differing FROM ({_compared_sql(False)}) GROUP BY 1, 2")

# --- Gaps


def _holes(points: DataFrame) -> DataFrame:
    """Without the slots of some hours of the day."""
    hour = F.floor(F.col("interval") / 3600) % 24
    return points.where(~((F.col("level") == 0) & hour.isin(3, 4, 5, 9, 15, 16, 17, 18)))


_HOLES = f"SELECT * FROM ({_STATE}) WHERE NOT (l = 0 AND (i // 3600) % 24 IN (3, 4, 5, 9, 15, 16, 17, 18))"
_W0 = read.grid_window(0, 3600, NOW - 604800, NOW)


def _gaps(s: SparkSession, d: str) -> DataFrame:
    holes = _holes(_state(s, d))
    return compare.gaps(read.on_grid(holes, holes, _W0), 3600)


_add(
    "gaps",
    _gaps,
    "SELECT s AS series_id, min(i) AS gap_start, max(i) AS gap_end, count(*) AS slots, CASE WHEN max(i) < max(last) THEN max(i) + 3600 END AS closed_by FROM ("
    "SELECT s, i, last, i - 3600 * row_number() OVER (PARTITION BY s ORDER BY i) AS island FROM ("
    f"SELECT g.s, g.i, {_W0.hi - _W0.step} AS last, p.v FROM (SELECT s, unnest(range({_W0.lo}, {_W0.hi}, 3600)) AS i FROM (SELECT DISTINCT s FROM ({_HOLES}))) g "
    f"LEFT JOIN (SELECT * FROM ({_HOLES}) WHERE l = 0) p ON p.s = g.s AND p.i = g.i) WHERE v IS NULL) GROUP BY s, island",
)


def _filled(mode: str) -> Query:
    def query(s, d):
        state = settle(_state(s, d))  # as a store would hold it
        return compare.fill(state, _holes(state), S, S, NOW, "average", 0.5, mode=mode).select("series_id", "level", "interval", _round().alias("value"))

    return query


_KEPT = f"i > {NOW} - CASE l WHEN 0 THEN 604800 WHEN 1 THEN 1209600 ELSE 5184000 END"
_FILL_WINDOWS = [read.grid_window(k, x.step, NOW - x.retention, (NOW, NOW - 604800, NOW - 1209600)[k]) for k, x in enumerate(S.levels)]
_add(
    "fill_strict",
    _filled("strict"),
    _out(
        f"SELECT * FROM ({_HOLES}) WHERE {_KEPT} UNION ALL SELECT * FROM ({_STATE}) q WHERE ({' OR '.join(f'(l = {w.level} AND i >= {w.lo} AND i < {w.hi})' for w in _FILL_WINDOWS)}) "
        f"AND NOT EXISTS (SELECT 1 FROM ({_HOLES}) h WHERE h.s = q.s AND h.l = q.l AND h.i = q.i AND {_KEPT.replace('i >', 'h.i >').replace('CASE l', 'CASE h.l')}) AND s IN (SELECT s FROM ({_HOLES}) WHERE {_KEPT})",
        True,
    ),
)


def _with(steps: list[tuple[str, str]], last: str) -> str:
    return "WITH " + ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in steps) + f" {last}"


def _cascade_steps(name: str, state: str | None, writes: list[str], ladder: Ladder) -> list[tuple[str, str]]:
    """The state after writes into each level, as table ``name`` (s, l, i, v): a write beats a rollup, which beats what was there; only fresh buckets roll up."""
    steps: list[tuple[str, str]] = []
    for k in range(len(ladder)):
        tiers = [f"SELECT s, i, v, 2 AS p FROM ({writes[k]})"]
        if state:
            tiers.append(f"SELECT s, i, v, 0 AS p FROM {state} WHERE l = {k}")
        if k:
            coarse, n = ladder[k].step, ladder[k].step // ladder[k - 1].step
            tiers.append(f"SELECT s, i - i % {coarse} AS i, avg(v) AS v, 1 AS p FROM {name}_{k - 1} GROUP BY s, i - i % {coarse} HAVING count(v) / {n}.0 >= CAST(0.5 AS FLOAT)::DOUBLE AND max(p) > 0")
        steps.append((f"{name}_{k}", f"SELECT s, i, arg_max(v, p) AS v, max(p) AS p FROM ({' UNION ALL '.join(tiers)}) GROUP BY 1, 2"))
    return [*steps, (name, " UNION ALL ".join(f"SELECT s, {k} AS l, i, v FROM {name}_{k}" for k in range(len(ladder))))]


def _fill_compat_sql() -> str:
    """Level by level: runs of two or more unknown or zero slots and the slot that closes them take the source's finest points by bulk write."""
    steps = [("source", _STATE), ("target", _HOLES), ("state0", f"SELECT * FROM target WHERE {_KEPT}")]
    end, pieces, newer = NOW, [], None
    for j, y in enumerate(S.levels):
        pieces.append(f"(l = {j} AND i > {NOW - y.retention}" + (f" AND i <= {newer})" if newer else ")"))
        newer = NOW - y.retention
    for k, x in enumerate(S.levels):
        w = read.grid_window(k, x.step, NOW - x.retention, end)
        steps += [
            (f"empty{k}", f"SELECT g.s, g.i FROM (SELECT s, unnest(range({w.lo}, {w.hi}, {x.step})) AS i FROM (SELECT DISTINCT s FROM target)) g LEFT JOIN (SELECT * FROM state{k} WHERE l = {k}) p ON p.s = g.s AND p.i = g.i WHERE p.v IS NULL OR p.v = 0"),
            (f"runs{k}", f"SELECT s, min(i) AS a, max(i) AS b FROM (SELECT s, i, i - {x.step} * row_number() OVER (PARTITION BY s ORDER BY i) AS island FROM empty{k}) GROUP BY s, island HAVING count(*) > 1"),
            (f"slots{k}", f"SELECT DISTINCT s, unnest(range(a, CASE WHEN b < {w.hi - x.step} THEN b + {x.step} ELSE b END + {x.step}, {x.step})) AS i FROM runs{k}"),
            (f"raw{k}", f"SELECT q.s, q.i AS t, q.v, 0 AS a FROM source q WHERE ({' OR '.join(pieces)}) AND EXISTS (SELECT 1 FROM slots{k} z WHERE z.s = q.s AND z.i = (q.i + {x.step - 1}) // {x.step} * {x.step})"),
            *_cascade_steps(f"state{k + 1}", f"state{k}", _direct(f"SELECT * FROM raw{k}", S, NOW), S),
        ]
        end = NOW - x.retention
    return _with(steps, _out(f"state{len(S)}", True).replace(f"(state{len(S)})", f"state{len(S)}"))


_add("fill_compat", _filled("compat"), _fill_compat_sql())

# --- New levels

NEW = Ladder.of("2h:10d", "12h:40d")


def _resized(aggregate: bool, aligned: bool = False) -> Query:
    def query(s, d):
        state = rollup.retained(_state(s, d), S, NOW)
        out = regrid.resize_aggregate(state, S, NEW, NOW, "average", 0.5, aligned) if aggregate else regrid.resize(state, S, NEW, NOW, "average", 0.5)
        return out.withColumn("value", _round())

    return query


def _resize_sql() -> str:
    """Coarsest first: each old level's points go in by age, over what is there, and roll up where they are fresh."""
    state: list[str | None] = [None] * len(NEW)
    for w in reversed([read.select_window(S, NOW - x.retention + x.step, NOW, NOW) for x in S.levels]):
        raw = f"SELECT s, i AS t, v, 0 AS a FROM ({_STATE}) WHERE l = {w.level} AND i >= {w.lo} AND i < {w.hi} AND {_KEPT}"
        direct, up = _direct(raw, NEW, NOW), None
        for k in range(len(NEW)):
            tiers = [f"SELECT s, i, v, 2 AS p FROM ({direct[k]})"]
            tiers += [f"SELECT s, i, v, 0 AS p FROM ({state[k]})"] if state[k] else []
            tiers += [f"SELECT s, i, v, 1 AS p FROM ({up})"] if up else []
            now = f"SELECT s, i, arg_max(v, p) AS v, max(p) AS p FROM ({' UNION ALL '.join(tiers)}) GROUP BY 1, 2"
            state[k] = f"SELECT s, i, v FROM ({now})"
            if k + 1 < len(NEW):
                coarse, n = NEW[k + 1].step, NEW[k + 1].step // NEW[k].step
                up = f"SELECT s, i - i % {coarse} AS i, avg(v) AS v FROM ({now}) GROUP BY s, i - i % {coarse} HAVING count(v) / {n}.0 >= CAST(0.5 AS FLOAT)::DOUBLE AND max(p) > 0"
    return _out(_levels(state), True)


_add("resize_plain", _resized(False), _resize_sql())


def _resize_aggregate_sql(aligned: bool) -> str:
    """The old grids spliced, the finest for each age; buckets of the new steps summed up from them and written in by age, level by level."""
    grids, oldest = [], None
    for w in [read.select_window(S, NOW - x.retention + x.step, NOW, NOW) for x in S.levels]:
        hi = w.hi if oldest is None else min(w.hi, -(-(oldest - w.lo) // w.step) * w.step + w.lo)
        if hi > w.lo:
            grids.append(f"SELECT g.s, g.i, p.v FROM (SELECT s, unnest(range({w.lo}, {hi}, {w.step})) AS i FROM (SELECT DISTINCT s FROM old)) g LEFT JOIN (SELECT * FROM old WHERE l = {w.level}) p ON p.s = g.s AND p.i = g.i")
            oldest = w.lo
    steps, state = [("old", f"SELECT * FROM ({_STATE}) WHERE {_KEPT}"), ("spliced", " UNION ALL ".join(grids))], None
    for k, x in enumerate(NEW.levels):
        first = NOW - x.retention + NOW % x.step
        start = f"i - i % {x.step}" if aligned else f"{first} + (i - {first}) // {x.step} * {x.step}"
        summed = f"SELECT s, {start} AS t, avg(v) AS v, 0 AS a FROM spliced WHERE i >= {first} AND i < {first + x.points * x.step} GROUP BY s, {start} HAVING count(v) > 0 AND count(v) / count(*) >= 0.5"
        steps += [(f"raw{k}", summed), *_cascade_steps(f"state{k}", state, _direct(f"SELECT * FROM raw{k}", NEW, NOW, True), NEW)]
        state = f"state{k}"
    return _with(steps, _out(state, True).replace(f"({state})", state))


_add("resize_aggregate", _resized(True), _resize_aggregate_sql(False))
_add("resize_aggregate_aligned", _resized(True, True), _resize_aggregate_sql(True))

# --- Configuration

_SCHEMAS = [("a", "60:1440"), ("b", "1h:7d,6h:14d,1d:60d"), ("c", "1s:60,60:60"), ("bad_even", "60:60,7:60"), ("bad_dup", "1:60,60:60,1:60"), ("bad_span", "1:60,10:1"), ("bad_points", "1:30,60:60")]


def _archives(spark: SparkSession) -> DataFrame:
    from tierfold.functions.config import parse_retention

    rows = [(name, k, *parse_retention(x)) for name, text_ in _SCHEMAS for k, x in enumerate(text_.split(","))]
    return spark.createDataFrame(rows, "schema_id string, level int, seconds_per_point long, points long")


def _archives_sql() -> str:
    from tierfold.functions.config import parse_retention

    rows = ", ".join(f"('{name}', {k}, {p[0]}, {p[1]})" for name, text_ in _SCHEMAS for k, x in enumerate(text_.split(",")) for p in [parse_retention(x)])
    return f"(VALUES {rows}) AS q(id, k, spp, pts)"


_add(
    "estimate_storage",
    lambda s, d: rules.estimate(_archives(s)),
    "SELECT *, CASE WHEN disk_bytes >= 1073741824 THEN printf('%.3f GB', disk_bytes / 1073741824.0) WHEN disk_bytes >= 1048576 THEN printf('%.3f MB', disk_bytes / 1048576.0) WHEN disk_bytes >= 1024 THEN printf('%.3f KB', disk_bytes / 1024.0) ELSE printf('%d bytes', disk_bytes) END AS size "
    f"FROM (SELECT id AS schema_id, CAST(m AS BIGINT) AS metrics, CAST(b * m AS BIGINT) AS bytes, CAST((b + 4095) // 4096 * 4096 * m AS BIGINT) AS disk_bytes FROM (SELECT id, 16 + 12 * count(*) + 12 * sum(pts) AS b FROM {_archives_sql()} GROUP BY 1), (SELECT unnest([1, 1000, 5000, 10000, 50000, 100000, 500000]) AS m))",
)
_add(
    "validate_configs",
    lambda s, d: rules.check_archives(_archives(s)),
    "SELECT id AS schema_id, arg_min(problem, n) AS problem FROM (SELECT id, n, CASE WHEN nx = spp THEN 'same precision' WHEN nx % spp <> 0 THEN 'uneven division' WHEN nx * np <= spp * pts THEN 'no longer retention' WHEN pts < nx // spp THEN 'too few points to consolidate' END AS problem "
    f"FROM (SELECT id, spp, pts, row_number() OVER w AS n, lead(spp) OVER w AS nx, lead(pts) OVER w AS np FROM {_archives_sql()} WINDOW w AS (PARTITION BY id ORDER BY spp, pts))) WHERE problem IS NOT NULL GROUP BY 1",
)


def _info(s: SparkSession, d: str) -> DataFrame:
    names = tables.table(s, d, "events").select(F.col("event_type").alias("series_id")).distinct()
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(x.step).cast("long").alias("seconds_per_point"), F.lit(x.points).cast("long").alias("points")) for k, x in enumerate(S.levels)])
    series = names.withColumn("aggregation_method", F.lit("average")).withColumn("max_retention", F.lit(S.max_retention).cast("long"))
    out = rules.info(series, names.select("series_id", F.inline(levels)))
    return out.select("series_id", "aggregation_method", "max_retention", F.col("file_size").cast("long").alias("file_size"), F.explode("archives").alias("x")).select("series_id", "aggregation_method", "max_retention", "file_size", "x.level", "x.retention", "x.size", "x.offset")


_add(
    "series_info",
    _info,
    f"SELECT s AS series_id, 'average' AS aggregation_method, CAST({S.max_retention} AS BIGINT) AS max_retention, CAST({16 + 36 + 12 * sum(x.points for x in S.levels)} AS BIGINT) AS file_size, CAST(k AS INTEGER) AS level, CAST(r AS BIGINT) AS retention, CAST(z AS BIGINT) AS size, CAST(o AS BIGINT) AS \"offset\" "
    "FROM (SELECT DISTINCT event_type AS s FROM events), (VALUES " + ", ".join(f"({k}, {x.retention}, {12 * x.points}, {52 + 12 * sum(y.points for y in S.levels[:k])})" for k, x in enumerate(S.levels)) + ") AS q(k, r, z, o)",
)
_RULES = [rules.Rule("STEEL$", "1m:1d", 0.3, "max"), rules.Rule("^PROMO", "10s:6h,1m:7d", 0.1, "sum"), rules.Rule("BRASS|COPPER", "5m:30d", 0.5, "last")]
_add(
    "schema_rule_match",
    lambda s, d: rules.apply_rules(tables.table(s, d, "part").select("p_partkey", "p_type"), _RULES, _RULES, "p_type").withColumn("xff", _round("xff")),
    "SELECT p_partkey, p_type, CAST(rule AS INTEGER) AS rule, coalesce(['1m:1d', '10s:6h,1m:7d', '5m:30d'][rule + 1], '1m:7d') AS retentions, coalesce([0.3, 0.1, 0.5][rule + 1], 0.5)::DOUBLE AS xff, coalesce(['max', 'sum', 'last'][rule + 1], 'average') AS method "
    "FROM (SELECT p_partkey, p_type, CASE WHEN regexp_matches(p_type, 'STEEL$') THEN 0 WHEN regexp_matches(p_type, '^PROMO') THEN 1 WHEN regexp_matches(p_type, 'BRASS|COPPER') THEN 2 END AS rule FROM part)",
)


def _drift(s: SparkSession, d: str) -> DataFrame:
    parts = tables.table(s, d, "part").select(F.col("p_partkey").alias("series_id"), "p_type")
    wanted = rules.apply_rules(parts, _RULES, _RULES, "p_type")
    return rules.drift(wanted.withColumn("retentions", F.lit("1m:7d")).withColumn("xff", F.lit(0.5)).withColumn("method", F.lit("average")), wanted).select("series_id", "retentions", "method")


_add(
    "rule_drift",
    _drift,
    "SELECT p_partkey AS series_id, ['1m:1d', '10s:6h,1m:7d', '5m:30d'][rule + 1] AS retentions, ['max', 'sum', 'last'][rule + 1] AS method FROM (SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'STEEL$') THEN 0 WHEN regexp_matches(p_type, '^PROMO') THEN 1 WHEN regexp_matches(p_type, 'BRASS|COPPER') THEN 2 END AS rule FROM part) WHERE rule IS NOT NULL",
)
_add("transform_values", lambda s, d: rules.transform(align.last_write_wins(tables.events(s, d), 3600), lambda i, v: v * 1024 + i % 7).withColumn("value", _round()), _out(f"SELECT s, i, v * 1024 + i % 7 AS v FROM ({_slots(_raw(), 3600)})"))


def _ring(s: SparkSession, d: str) -> DataFrame:
    slots = align.last_write_wins(tables.events(s, d), 3600).withColumn("slot", ring_slot("interval", 3600, S[0].points))
    return slots.groupBy("series_id", "slot").agg(F.max("interval").alias("interval"), F.max_by("value", "interval").alias("value"))


_add("ring_slots", _ring, f'SELECT s AS series_id, (i // 3600) % {S[0].points} AS slot, max(i) AS "interval", arg_max(v, i) AS value FROM ({_slots(_raw(), 3600)}) GROUP BY 1, 2')


def _parsed(s: SparkSession, d: str) -> DataFrame:
    lines = tables.events(s, d).select(F.concat_ws(":", F.col("ts").cast("string"), F.col("value").cast("string")).alias("value"))
    return text.parse_points(lines, NOW, "all").groupBy("series_id").agg(F.count("*").alias("points"), F.max("ts").alias("newest"), F.round(F.sum("value"), 3).alias("total"))


_add("text_points", _parsed, f"SELECT 'all' AS series_id, count(*) AS points, max(t) AS newest, round(sum(v), 3) AS total FROM ({_raw()})")

# --- Replay and streaming


def _late(s: SparkSession, d: str) -> DataFrame:
    """Each point is written up to three days after its time."""
    raw = tables.events(s, d)
    raw = raw.withColumn("now", F.col("ts") + F.col("arrival") * 7919 % (3 * 86400)).withColumn("arrival", F.col("now") * 10_000_000 + F.col("arrival"))
    return replay.replay(raw, SHORT, "average", 0.3).withColumn("value", _round())


def _late_sql() -> str:
    """Puts into each level's ring, in order n: those of the points that belong there by age, and after each put into the level
    below the average of what that level's ring then holds of the bucket. A slot holds what was put there last."""
    steps = [("w", f"SELECT s, t, v, a * 7919 % 259200 AS age, (t + a * 7919 % 259200) * 10000000 + a AS n FROM ({_raw()})")]
    younger = -1
    for k, x in enumerate(SHORT.levels):
        put = f"SELECT s, n, t, t - t % {x.step} AS i, v FROM w WHERE age > {younger} AND age <= {x.retention} AND age < {SHORT.max_retention}"
        if k:
            f = SHORT[k - 1]
            n = x.step // f.step
            asked = f"SELECT s, n, t, t - t % {x.step} AS b, unnest(range(t - t % {x.step}, t - t % {x.step} + {x.step}, {f.step})) AS f FROM put{k - 1}"
            steps.append((f"asked{k}", f"SELECT *, f // {f.step} % {f.points} AS r FROM ({asked})"))
            held = f"SELECT q.s, q.n, q.t, q.b, q.f, CASE WHEN z.i = q.f THEN z.v END AS v FROM asked{k} q ASOF LEFT JOIN put{k - 1} z ON q.s = z.s AND q.r = z.r AND q.n >= z.n"
            put += f" UNION ALL SELECT s, n, t, b AS i, avg(v) AS v FROM ({held}) GROUP BY s, n, t, b HAVING count(v) > 0 AND count(v) / {n}.0 >= CAST(0.3 AS FLOAT)::DOUBLE"
        steps.append((f"put{k}", f"SELECT *, i // {x.step} % {x.points} AS r FROM ({put})"))
        younger = x.retention
    rings = " UNION ALL ".join(f"SELECT s, {k} AS l, arg_max(i, n) AS i, arg_max(v, n) AS v FROM put{k} GROUP BY s, r" for k in range(len(SHORT)))
    return _with(steps, _out(rings, True))


_add("replay_late_points", _late, _late_sql())
_add(
    "replay_in_order",
    lambda s, d: replay.replay(tables.events(s, d).withColumn("now", F.col("ts")).withColumn("arrival", F.col("ts") * 1_000_000_000 - F.col("arrival")), S, "sum", 0.0).withColumn("value", _round()),
    _out(" UNION ALL ".join(f"SELECT s, {k} AS l, max(i) AS i, arg_max(v, i) AS v FROM ({src}) GROUP BY s, i // {x.step} % {x.points}" for k, (x, src) in enumerate(zip(S.levels, _chain(_raw(), S, "sum", 0.0), strict=True))), True),
)


def _stream(s: SparkSession, d: str) -> DataFrame:
    schema = tables.table(s, d, "events").schema
    rows = s.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    raw = tables.as_raw(rows, "event_type", "ts", "value", "event_id")
    name = f"stream_{uuid.uuid4().hex}"
    q = ingest.windowed(raw, 3600, 86400).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.table(name)


_add("stream_windowed", _stream, _out(_slots(_raw(), 3600), exact=True))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
