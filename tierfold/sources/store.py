"""A store of many series in Parquet, each with its own ladder, method and coverage factor.

Series that share all three have one profile; profiles are few, as rules give them, and a store has a default one for
series that it doesn't know yet. ``points`` and ``series`` lie in versions, partitioned by shard (a hash of the
series); a manifest says which version holds each shard. A write reads the shards that it touches, writes their new
state once, as a new version, and then a new manifest, which takes effect whole or not at all: who reads meanwhile, or after a
crash, sees the old state. Two writers at once: the second to finish is refused. Versions that neither the newest nor the previous
manifest names are deleted.

Points that their level no longer keeps go with the next write to their shard.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierfold.functions.config import ConcurrentWrite, InvalidConfiguration, Ladder, Level, checked_method, parse_retention, stored_xff
from tierfold.operators import align, compare, read, regrid, rollup, rules
from tierfold.sources import ringfile
from tierfold.sources.shared import settle

SCHEMAS = {"points": "series_id string, interval long, value double, version string, shard int, level int", "series": "series_id string, profile int, version string, shard int"}
STATE = ["series_id", "level", "interval", "value"]
#: Manifests that are kept, with the versions they name.
KEPT = 2


@dataclass(frozen=True)
class Profile:
    method: str
    xff: float
    ladder: Ladder

    def packed(self) -> list:
        return [self.method, self.xff, [list(p) for p in self.ladder.pairs()]]

    @staticmethod
    def of(method: str, xff: float, ladder: Ladder) -> Profile:
        return Profile(checked_method(method), stored_xff(xff), ladder)

    @property
    def retentions(self) -> str:
        return ",".join(f"{s}:{p}" for s, p in self.ladder.pairs())


def canonical(retentions: str) -> str:
    """'1h:7d, 1d:60d' as '3600:168,86400:60'."""
    return ",".join(f"{s}:{p}" for s, p in sorted(map(parse_retention, retentions.split(","))))


class Store:
    """``root`` is any path that Spark reads and writes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- Files

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *names)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *names: str) -> list[str]:
        fs, path = self._fs(), self._path(*names)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def _manifests(self) -> list[str]:
        return [x for x in self._names("manifests") if x.endswith(".json")]

    def exists(self) -> bool:
        return bool(self._manifests())

    def _manifest(self) -> dict:
        names = self._manifests()
        if not names:
            raise InvalidConfiguration(f"no store at {self.root}")
        return self._load(names[-1])

    def _load(self, name: str) -> dict:
        stream = self._fs().open(self._path("manifests", name))
        try:
            m = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        m["profiles"] = [Profile(method, xff, Ladder(tuple(Level(*p) for p in pairs))) for method, xff, pairs in m["profiles"]]
        return m | {"number": int(name.split(".")[0])}

    def _commit(self, old: dict | None, new: dict) -> None:
        """Puts ``new`` in the place of ``old``, unless another writer has done so."""
        number = old["number"] + 1 if old else 0
        body = {k: new[k] for k in ("shards", "default", "points", "series")} | {"profiles": [p.packed() for p in new["profiles"]]}
        fs, path, draft = self._fs(), self._path("manifests", f"{number:012d}.json"), self._path("manifests", f"draft-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(json.dumps(body).encode())
        out.close()
        if fs.exists(path) or not fs.rename(draft, path):
            fs.delete(draft, False)
            raise ConcurrentWrite(f"{self.root} was written meanwhile; try again")
        self._tidy()

    def _tidy(self) -> None:
        """Deletes manifests beyond those kept, and the versions that only they name."""
        fs, names = self._fs(), self._manifests()
        gone, kept = names[:-KEPT], [self._load(x) for x in names[-KEPT:]]
        for name in gone:
            m = self._load(name)
            for table in SCHEMAS:
                for v in set(m[table].values()) - {v for k in kept for v in k[table].values()}:
                    fs.delete(self._path(table, f"version={v}"), True)
            fs.delete(self._path("manifests", name), False)

    def vacuum(self, older: int = 86400) -> int:
        """Deletes what writers that broke off have left, if it is so many seconds old; how many versions."""
        fs, kept, n = self._fs(), [self._load(x) for x in self._manifests()], 0
        for table in SCHEMAS:
            named = {f"version={v}" for m in kept for v in m[table].values()}
            for name in self._names(table):
                path = self._path(table, name)
                if name not in named and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 >= older:
                    n += fs.delete(path, True)
        return n

    def _read(self, m: dict, table: str, shards: list[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/{table}/version={v}/shard={k}" for k, v in sorted(m[table].items()) if shards is None or int(k) in shards]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[table]).drop("version")
        return self.spark.read.schema(SCHEMAS[table]).option("basePath", f"{self.root}/{table}").parquet(*paths).drop("version")

    def _shard(self, m: dict):
        return F.pmod(F.xxhash64("series_id"), F.lit(m["shards"])).cast("int")

    def _write(self, m: dict, table: str, rows: DataFrame, touched: list[int] | None) -> dict[str, str]:
        """The table's shards in a manifest after ``rows`` have become all there is of those touched (None: of all)."""
        version = uuid.uuid4().hex
        by, order = (["shard", "level"], ["shard", "level", "series_id", "interval"]) if table == "points" else (["shard"], ["shard", "series_id"])
        # Rows of a shard lie together, in order of series and time, so that reads of few series skip row groups.
        rows.withColumn("shard", self._shard(m)).repartition(*by).sortWithinPartitions(*order).write.partitionBy(*by).parquet(f"{self.root}/{table}/version={version}")
        there = {x.removeprefix("shard="): version for x in self._names(table, f"version={version}") if x.startswith("shard=")}
        return ({} if touched is None else {k: v for k, v in m[table].items() if int(k) not in touched}) | there

    # --- Settings

    def create(self, ladder: Ladder, method: str = "average", xff: float = 0.5, shards: int = 64, overwrite: bool = False) -> Store:
        """An empty store whose default profile is as given."""
        if self.exists() and not overwrite:
            raise InvalidConfiguration(f"{self.root} already exists")
        profile = Profile.of(method, xff, ladder)
        old = self._manifest() if self.exists() else None
        self._fs().mkdirs(self._path("manifests"))
        self._commit(old, {"shards": shards, "default": 0, "points": {}, "series": {}, "profiles": [profile]})
        return self

    def settings(self):
        """Method, coverage factor and ladder of the default profile, and the number of shards."""
        m = self._manifest()
        p = m["profiles"][m["default"]]
        return p.method, p.xff, p.ladder, m["shards"]

    def profiles(self) -> list[Profile]:
        return self._manifest()["profiles"]

    def series(self) -> DataFrame:
        """(series_id, profile) of every series."""
        return self._read(self._manifest(), "series").select("series_id", "profile")

    def _with(self, m: dict, profile: Profile) -> int:
        """The number of a profile, new or not."""
        if profile not in m["profiles"]:
            m["profiles"] = [*m["profiles"], profile]
        return m["profiles"].index(profile)

    def add(self, series: DataFrame, ladder: Ladder, method: str = "average", xff: float = 0.5) -> None:
        """New series (series_id) with settings of their own; those that are there already are an error."""
        m = self._manifest()
        new, known = settle(series.select("series_id").distinct()), self._read(m, "series").select("series_id", "profile")
        if new.join(known, "series_id", "left_semi").limit(1).count():
            raise InvalidConfiguration("some of these series already exist")
        old, number = dict(m), self._with(m, Profile.of(method, xff, ladder))
        m["series"] = self._write(m, "series", known.union(new.withColumn("profile", F.lit(number))), None)
        self._commit(old, m)

    def _set(self, change, series: DataFrame | None) -> list[Profile]:
        """Profiles changed, of all series and the default or of some series; the old ones that did."""
        m = self._manifest()
        old = dict(m)
        rows = self._read(m, "series").select("series_id", "profile")
        picked = rows if series is None else rows.join(series.select("series_id").distinct(), "series_id", "left_semi")
        found = sorted({r.profile for r in picked.select("profile").distinct().collect()} | ({m["default"]} if series is None else set()))
        if not found:
            raise InvalidConfiguration("no such series")
        before = [m["profiles"][k] for k in found]
        to = {k: self._with(m, change(m["profiles"][k])) for k in found}
        moved = reduce(lambda c, k: F.when(F.col("profile") == k, F.lit(to[k])).otherwise(c), found, F.col("profile"))
        if series is None:
            rows = rows.withColumn("profile", moved)
            m["default"] = to[m["default"]]
        else:
            rows = rows.join(picked.select("series_id", F.lit(True).alias("on")), "series_id", "left").select("series_id", F.when(F.col("on"), moved).otherwise(F.col("profile")).alias("profile"))
        if old["series"]:
            m["series"] = self._write(m, "series", rows, None)
        self._commit(old, m)
        return before

    def set_xff(self, xff: float, series: DataFrame | None = None) -> float:
        """The old one (of several, that of the first profile). Points stay as they are."""
        return self._set(lambda p: Profile.of(p.method, xff, p.ladder), series)[0].xff

    def set_method(self, method: str, xff: float | None = None, series: DataFrame | None = None) -> str:
        return self._set(lambda p: Profile.of(method, p.xff if xff is None else xff, p.ladder), series)[0].method

    # --- Points

    def points(self) -> DataFrame:
        return self._read(self._manifest(), "points").select(*STATE, "shard")

    def _parts(self, m: dict, rows: DataFrame, shards: list[int] | None = None, default: bool = False) -> list[tuple[int, DataFrame]]:
        """``rows`` by the profile of their series; with ``default``, unknown series have that one. One profile needs no join."""
        known = self._read(m, "series", shards).select("series_id", "profile")
        if len(m["profiles"]) == 1:
            return [(0, rows)]
        rows = rows.join(known, "series_id", "left" if default else "inner")
        if default:
            rows = rows.withColumn("profile", F.coalesce("profile", F.lit(m["default"])))
        return [(k, rows.where(F.col("profile") == k).drop("profile")) for k in range(len(m["profiles"]))]

    def update_many(self, raw: DataFrame, now: int, future: str = "reject", clock: str | None = None) -> None:
        """Write raw points, routed by age at ``now``, or at each point's own time of writing in the column ``clock``."""
        m = self._manifest()
        old = dict(m)
        touched = [r[0] for r in raw.select(self._shard(m).alias("s")).distinct().collect()]  # at most ``shards``
        if not touched:
            return
        state = dict(self._parts(m, self._read(m, "points", touched).select(*STATE), touched))
        out = []
        for k, part in self._parts(m, raw, touched, True):
            p = m["profiles"][k]
            writes = align.direct_writes(part, p.ladder, F.col(clock) if clock else now, future)
            out.append(rollup.retained(rollup.cascade(state[k], writes, p.ladder, p.method, p.xff), p.ladder, now))
        known = self._read(m, "series", touched).select("series_id", "profile")
        new = settle(raw.select("series_id").where("series_id is not null").distinct().join(known, "series_id", "left_anti"))
        m["points"] = self._write(m, "points", reduce(DataFrame.union, out), touched)
        if not new.isEmpty():
            m["series"] = self._write(m, "series", known.union(new.withColumn("profile", F.lit(m["default"]))), touched)
        self._commit(old, m)

    def _profile_of(self, series_id: str) -> Profile:
        m = self._manifest()
        row = self._read(m, "series").where(F.col("series_id") == series_id).first()
        return m["profiles"][row.profile if row else m["default"]]

    def update(self, series_id: str, value: float, ts: int, now: int) -> None:
        align.check_single(int(ts), self._profile_of(series_id).ladder, now)
        self.update_many(self.spark.createDataFrame([(series_id, int(ts), float(value), 0)], "series_id string, ts long, value double, arrival long"), now)

    def fetch(self, start: int, end: int | None, now: int, step: int | None = None, series: DataFrame | None = None, drop: str | None = None) -> DataFrame | None:
        """Every series (or those in ``series``) on the grid that its own ladder gives; None if the range lies outside of all. A ``step`` leaves out series without such a level, and is an error if none has it."""
        m = self._manifest()
        names = self._read(m, "series").select("series_id") if series is None else series.select("series_id")
        points, some, ladders = dict(self._parts(m, self._read(m, "points").select(*STATE))), self._parts(m, names, default=True), [p.ladder for p in m["profiles"]]
        if step is not None and not any(x.step == step for ladder in ladders for x in ladder.levels):
            raise ValueError(f"no level has a step of {step} s")
        found = [read.fetch(points[k], ladders[k], start, end, now, step, part, drop) for k, part in some if step is None or any(x.step == step for x in ladders[k].levels)]
        found = [x for x in found if x is not None]
        return reduce(DataFrame.union, found) if found else None

    def info(self) -> DataFrame:
        m = self._manifest()
        out = []
        for k, part in self._parts(m, self._read(m, "series").select("series_id")):
            p = m["profiles"][k]
            rows = part.select("series_id", F.lit(p.method).alias("aggregation_method"), F.lit(p.xff).cast("float").alias("xff"), F.lit(p.ladder.max_retention).cast("long").alias("max_retention"))
            levels = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(x.step).cast("long").alias("seconds_per_point"), F.lit(x.points).cast("long").alias("points")) for k, x in enumerate(p.ladder.levels)])
            out.append(rules.info(rows, part.select("series_id", F.inline(levels))))
        return reduce(DataFrame.union, out)

    def _pairs(self, m: dict, other: Store, n: dict) -> list[tuple[int, int, DataFrame]]:
        """Series that both stores have, by their two profiles."""
        mine, its = self._read(m, "series").select("series_id", "profile"), other._read(n, "series").select("series_id", F.col("profile").alias("its"))
        both = settle(mine.join(its, "series_id"))
        return [(r.profile, r.its, both.where((F.col("profile") == r.profile) & (F.col("its") == r.its)).select("series_id")) for r in both.select("profile", "its").distinct().collect()]

    def _of(self, m: dict, series: DataFrame) -> DataFrame:
        return self._read(m, "points").select(*STATE).join(series, "series_id", "left_semi")

    def _replace(self, m: dict, series: DataFrame, state: list[DataFrame]) -> None:
        """``state`` in the place of all points of some series; only their shards are written."""
        touched = [r[0] for r in series.select(self._shard(m).alias("s")).distinct().collect()]  # at most ``shards``
        rest = self._read(m, "points", touched).select(*STATE).join(series.select("series_id"), "series_id", "left_anti")
        m["points"] = self._write(m, "points", reduce(DataFrame.union, [x.select(*STATE) for x in state]).union(rest), touched)

    def merge(self, source: Store, now: int, start: int = 0, end: int | None = None) -> None:
        """The source's points over those of the same series; series that only the source has come with their settings."""
        m, n = self._manifest(), source._manifest()
        old, out = dict(m), []
        for k, j, series in self._pairs(m, source, n):
            p = m["profiles"][k]
            compare.check_alike(n["profiles"][j].ladder, p.ladder)
            out.append(compare.merge(source._of(n, series), self._of(m, series), p.ladder, now, p.method, p.xff, start, end))
        known = self._read(m, "series").select("series_id", "profile")
        its = source._read(n, "series").select("series_id", F.col("profile").alias("its"))
        new = settle(its.join(known, "series_id", "left_anti"))
        added = []
        for r in new.select("its").distinct().collect():
            p, series = n["profiles"][r.its], new.where(F.col("its") == r.its).select("series_id")
            part = source._of(n, series)
            out.append(compare.merge(part, part.limit(0), p.ladder, now, p.method, p.xff, start, end))
            added.append(series.withColumn("profile", F.lit(self._with(m, p))))
        if out:
            self._replace(m, its, out)
            if added:
                m["series"] = self._write(m, "series", reduce(DataFrame.union, added, known), None)
            self._commit(old, m)

    def diff(self, other: Store, now: int, until: int | None = None, ignore_empty: bool = False) -> DataFrame:
        return self._compared(other, lambda a, b, ladder: compare.diff(a, b, ladder, now, until, ignore_empty))

    def diff_summary(self, other: Store, now: int, until: int | None = None, ignore_empty: bool = False) -> DataFrame:
        found = self._compared(other, lambda a, b, ladder: compare.diff_summary(a, b, ladder, now, until, ignore_empty))
        return found.groupBy("level").agg(F.sum("total").alias("total"), F.sum("differing").alias("differing"))

    def _compared(self, other: Store, compared) -> DataFrame:
        """Of series that both have, each pair of profiles by itself; a series that one of them lacks is compared with nothing."""
        m, n = self._manifest(), other._manifest()
        out = []
        for k, j, series in self._pairs(m, other, n):
            compare.check_alike(m["profiles"][k].ladder, n["profiles"][j].ladder)
            out.append(compared(self._of(m, series), other._of(n, series), m["profiles"][k].ladder))
        empty = self.spark.createDataFrame([], "series_id string, level int, interval long, value double")
        mine, its = self._read(m, "series").select("series_id"), other._read(n, "series").select("series_id")
        for one, those, store, man, swap in ((mine, its, self, m, False), (its, mine, other, n, True)):
            alone = settle(one.join(those, "series_id", "left_anti"))
            if alone.isEmpty():
                continue
            for k, part in store._parts(man, store._of(man, alone)):
                out.append(compared(empty, part, man["profiles"][k].ladder) if swap else compared(part, empty, man["profiles"][k].ladder))
        return reduce(DataFrame.union, out) if out else compared(empty, empty, m["profiles"][0].ladder)

    def fill(self, source: Store, now: int, mode: str = "compat") -> None:
        """Gaps of the series that both have, from the source."""
        m, n = self._manifest(), source._manifest()
        old, out, both = dict(m), [], []
        for k, j, series in self._pairs(m, source, n):
            p = m["profiles"][k]
            out.append(compare.fill(source._of(n, series), self._of(m, series), p.ladder, n["profiles"][j].ladder, now, p.method, p.xff, mode=mode))
            both.append(series)
        if out:
            self._replace(m, reduce(DataFrame.union, both), out)
            self._commit(old, m)

    def resize(self, ladder: Ladder, now: int, aggregate: bool = False, method: str | None = None, xff: float | None = None, aligned: bool = False, series: DataFrame | None = None) -> None:
        """New levels for all series and the default, or for some series."""
        m = self._manifest()
        if series is None:
            p = m["profiles"][m["default"]]
            m["default"] = self._with(m, Profile.of(method or p.method, p.xff if xff is None else xff, ladder))
        self._resize(m, [(series, ladder, method, xff)], now, aggregate, aligned)

    def _resize(self, m: dict, wanted: list[tuple[DataFrame | None, Ladder, str | None, float | None]], now: int, aggregate: bool, aligned: bool) -> None:
        """One write for any number of groups of series with their new settings."""
        old, points, groups = self._manifest(), [], []
        everyone = self._read(old, "series").select("series_id", "profile")
        for series, ladder, method, xff in wanted:
            picked = settle(everyone if series is None else everyone.join(series.select("series_id").distinct(), "series_id", "left_semi"))
            for r in picked.select("profile").distinct().collect():
                before = old["profiles"][r.profile]
                after = Profile.of(method or before.method, before.xff if xff is None else xff, ladder)
                some = picked.where(F.col("profile") == r.profile).select("series_id")
                state = rollup.retained(self._of(old, some), before.ladder, now)
                regridded = regrid.resize_aggregate(state, before.ladder, ladder, now, after.method, after.xff, aligned) if aggregate else regrid.resize(state, before.ladder, ladder, now, after.method, after.xff)
                points.append(rollup.retained(regridded, ladder, now).select(*STATE))
                groups.append(some.withColumn("profile", F.lit(self._with(m, after))))
        if groups:
            moved = reduce(DataFrame.union, groups)
            m["series"] = self._write(m, "series", moved.union(everyone.join(moved, "series_id", "left_anti")), None)
            self._replace(m, moved, points)
        self._commit(old, m)

    def drift(self, storage: list[rules.Rule], aggregation: list[rules.Rule]) -> DataFrame:
        """Series that aren't as the rules want them, with what they are and what they should be; retentions in their plain form."""
        m = self._manifest()
        plain = lambda rs: [rules.Rule(r.pattern, r.retentions and canonical(r.retentions), r.xff, r.method) for r in rs]
        wanted = rules.apply_rules(self._read(m, "series").select("series_id"), plain(storage), plain(aggregation), "series_id", canonical("1m:7d"))
        are = [part.select("series_id", F.lit(m["profiles"][k].retentions).alias("retentions"), F.lit(m["profiles"][k].xff).alias("xff"), F.lit(m["profiles"][k].method).alias("method")) for k, part in self._parts(m, self._read(m, "series").select("series_id"))]
        return rules.drift(reduce(DataFrame.union, are), wanted)

    def follow(self, storage: list[rules.Rule], aggregation: list[rules.Rule], now: int, aggregate: bool = False) -> DataFrame:
        """Resizes the series that aren't as the rules want them, in one write; what was changed."""
        found = settle(self.drift(storage, aggregation))
        wanted = found.select("retentions", "xff", "method").distinct().collect()  # no more than the rules can give
        if wanted:
            of = lambda r: found.where((F.col("retentions") == r.retentions) & (F.col("xff") == r.xff) & (F.col("method") == r.method))
            self._resize(self._manifest(), [(of(r), Ladder.of(*r.retentions.split(",")), r.method, r.xff) for r in wanted], now, aggregate, False)
        return found

    def copy(self, root: str) -> Store:
        """The same store at another place: what a resize leaves as backup, or resizes instead of this one."""
        m, out = self._manifest(), Store(self.spark, root)
        if out.exists():
            raise InvalidConfiguration(f"{out.root} already exists")
        out._fs().mkdirs(out._path("manifests"))
        n = dict(m)
        for table in SCHEMAS:
            n[table] = out._write(m, table, self._read(m, table).drop("shard"), None) if m[table] else {}
        out._commit(None, n)
        return out

    def restore(self) -> None:
        """The state before the last write, as a new one."""
        names = self._manifests()
        if len(names) < 2:
            raise InvalidConfiguration(f"{self.root} has no earlier state")
        now, before = self._load(names[-1]), self._load(names[-2])
        self._commit(now, before)

    def load_files(self, path: str, root: str = "", pattern: str = "*.wsp") -> DataFrame:
        """Takes in ring files, each with its own settings, in the place of any series of the same name; the files that can't be read."""
        m = self._manifest()
        old = dict(m)
        heads = settle(ringfile.read_headers(self.spark, path, pattern, slots=True))
        fine = heads.where("error is null").select(ringfile.series_name("path", root).alias("series_id"), "method", "xff", F.transform("archives", lambda a: F.array(a["seconds_per_point"], a["points"])).alias("pairs"))
        groups = []
        for r in fine.select("method", "xff", "pairs").distinct().collect():  # settings, which are few
            number = self._with(m, Profile.of(r.method, r.xff, Ladder.of(*map(tuple, r.pairs))))
            groups.append(fine.where((F.col("method") == r.method) & (F.col("xff") == r.xff) & (F.col("pairs") == F.array(*[F.array(*[F.lit(x).cast("long") for x in p]) for p in r.pairs]))).select("series_id", F.lit(number).alias("profile")))
        if groups:
            new = settle(reduce(DataFrame.union, groups))
            known = self._read(m, "series").select("series_id", "profile").join(new, "series_id", "left_anti")
            m["series"] = self._write(m, "series", known.union(new), None)
            self._replace(m, new, [ringfile.read_points(self.spark, path, root, pattern)])
            self._commit(old, m)
        return heads.where("error is not null").select("path", "error")

    def transform(self, value, now: int, start: int = 0, end: int | None = None) -> None:
        """Values of a range replaced by a function of (interval, value), written back by age."""
        got = self.fetch(start, end, now)
        if got is not None:
            known = rules.transform(got.where("value is not null"), value)
            self.update_many(settle(known.select("series_id", F.col("interval").alias("ts"), "value", F.lit(0).cast("long").alias("arrival"))), now)
