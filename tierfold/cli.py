"""Command line: python -m tierfold.cli COMMAND STORE ...; stores are folders (see sources.store)."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierfold.functions.columns import raw_line, tsv_line
from tierfold.functions.config import METHODS, Ladder, TierfoldError, estimate_bytes, parse_retention
from tierfold.operators import rules
from tierfold.sources import ringfile, rulefile, text
from tierfold.sources.store import Store


def _lines(df, column: str = "line") -> None:
    for r in df.toLocalIterator():
        print(r[column])


def _one(spark: SparkSession, series: str | None) -> DataFrame | None:
    return None if series is None else spark.createDataFrame([(series,)], "series_id string")


def _complain(broken: DataFrame) -> int:
    n = 0
    for r in broken.toLocalIterator():
        print(f"[ERROR] {r.path}: {r.error}", file=sys.stderr)
        n += 1
    return int(n > 0)


def _header(h) -> None:
    print(f"{h.path}\nmethod {h.method}, coverage {h.xff:g}, keeps {h.max_retention} s")
    for x in h.archives:
        print(f"level {x.level}: {x.points} points of {x.seconds_per_point} s, {x.seconds_per_point * x.points} s in all, {12 * x.points} bytes from {x.offset}")


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tierfold")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str, now: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for x in places:
            p.add_argument(x)
        if now:
            p.add_argument("--now", type=int, default=None, help="epoch seconds; the clock's by default")
        return p

    p = command("create", "store", now=False)
    p.add_argument("retentions", nargs="+")
    p.add_argument("--xFilesFactor", type=float, default=0.5)
    p.add_argument("--aggregationMethod", choices=sorted(METHODS), default="average")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--estimate", action="store_true")
    p = command("update", "store", "series")
    p.add_argument("points", nargs="*", help="time:value, N for now; standard input if none")
    p = command("fetch", "store", "series")
    p.add_argument("--from", dest="start", type=int, default=None)
    p.add_argument("--until", type=int, default=None)
    p.add_argument("--json", action="store_true")
    p.add_argument("--pretty", action="store_true")
    p.add_argument("-t", "--time-format", default=None)
    p.add_argument("--drop", choices=["nulls", "zeroes", "empty"], default=None)
    p = command("info", "store", "series", now=False)
    p.add_argument("field", nargs="?")
    p.add_argument("--json", action="store_true")
    p = command("add", "store", "series", now=False)
    p.add_argument("retentions", nargs="+")
    p.add_argument("--xFilesFactor", type=float, default=0.5)
    p.add_argument("--aggregationMethod", choices=sorted(METHODS), default="average")
    p = command("load", "store", "path", now=False)
    p.add_argument("--root", default="", help="what to leave out of the paths for the names of series")
    command("restore", "store", now=False)
    p = command("dump", "path", now=False)
    p.add_argument("-r", "--raw", action="store_true")
    p.add_argument("--pretty", action="store_true")
    p.add_argument("-t", "--time-format", default=None)
    for name in ("merge", "fill", "diff"):
        p = command(name, "source", "target")
        if name == "merge":
            p.add_argument("--from", dest="start", type=int, default=0)
        if name != "fill":
            p.add_argument("--until", type=int, default=None)
        else:
            p.add_argument("--mode", choices=["compat", "strict"], default="compat")
        if name == "diff":
            p.add_argument("--summary", action="store_true")
            p.add_argument("--ignore-empty", action="store_true")
            p.add_argument("--columns", action="store_true")
            p.add_argument("--no-headers", action="store_true")
            p.add_argument("--json", action="store_true")
    p = command("resize", "store")
    p.add_argument("retentions", nargs="+")
    p.add_argument("--xFilesFactor", type=float, default=None)
    p.add_argument("--aggregationMethod", choices=sorted(METHODS), default=None)
    p.add_argument("--aggregate", action="store_true")
    p.add_argument("--aligned", action="store_true")
    p.add_argument("--series", default=None, help="this one alone")
    p.add_argument("--newfile", default=None, help="another place for the result; the store stays as it is")
    p.add_argument("--backup", default=None, help="a place for the store as it was; the restore command needs none")
    p = command("set-aggregation-method", "store", "method", now=False)
    p.add_argument("xff", type=float, nargs="?", default=None)
    p.add_argument("--series", default=None)
    p = command("set-xfilesfactor", "store", now=False)
    p.add_argument("xff", type=float)
    p.add_argument("--series", default=None)
    p = command("find-corrupt", now=False)
    p.add_argument("path", nargs="+")
    p.add_argument("--delete-corrupt", action="store_true")
    p.add_argument("--slots", action="store_true", help="files that are cut short are corrupt too")
    p.add_argument("--verbose", action="store_true")
    p = command("follow-rules", "store")
    p.add_argument("--storage", required=True, help="a file of rules that give retentions")
    p.add_argument("--aggregation", default=None, help="a file of rules that give xFilesFactor and aggregationMethod")
    p.add_argument("--aggregate", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--quiet", action="store_true")
    p = command("match-rules", "names", now=False)
    p.add_argument("rules", help="JSON list of {pattern, retentions, xff, method}")
    p = command("transform", "store", "expression")
    p.add_argument("--from", dest="start", type=int, default=0)
    p.add_argument("--until", type=int, default=None)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    now = getattr(a, "now", None) or int(time.time())
    if a.command == "create" and a.estimate:
        pairs = [parse_retention(x) for r in a.retentions for x in r.split(",")]
        size, disk = estimate_bytes(pairs)
        print(f"bytes {size}, on disk {disk}")
        for n in (1, 5, 10, 50, 100, 500):
            print(f"{n}k metrics: {disk * n * 1000} bytes on disk")
        return 0
    spark = spark or SparkSession.builder.appName("tierfold").getOrCreate()
    try:
        return _run(a, spark, now)
    except (TierfoldError, ValueError, SparkRuntimeException) as e:
        print(f"[ERROR] {e}", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace, spark: SparkSession, now: int) -> int:
    if a.command == "create":
        Store(spark, a.store).create(Ladder.of(*a.retentions), a.aggregationMethod, a.xFilesFactor, overwrite=a.overwrite)
    elif a.command == "update":
        words = a.points or sys.stdin.read().split()
        store = Store(spark, a.store)
        raw = text.parse_points(spark.createDataFrame([(" ".join(words),)], "value string"), now, a.series, strict=True).withColumn("arrival", F.monotonically_increasing_id())
        if len(words) == 1:
            r = raw.first()
            store.update(a.series, r.value, r.ts, now)
        else:
            store.update_many(raw, now, "accept")
    elif a.command == "fetch":
        store = Store(spark, a.store)
        series = spark.createDataFrame([(a.series,)], "series_id string")
        got = store.fetch(now - 86400 if a.start is None else a.start, a.until, now, series=series, drop=a.drop)
        if got is None:
            print("No data in the given time range")
            return 1
        pattern = a.time_format or ("EEE MMM d HH:mm:ss yyyy" if a.pretty else None)
        if a.json:
            rows = got.orderBy("interval").collect()
            times = [r.interval for r in rows]
            step = times[1] - times[0] if len(times) > 1 else 0
            print(json.dumps({"start": min(times, default=None), "end": max(times, default=0) + step, "step": step, "values": [r.value for r in rows]}))
        else:
            _lines(got.orderBy("interval").select(tsv_line("interval", "value", pattern).alias("line")))
    elif a.command == "info":
        r = Store(spark, a.store).info().where(F.col("series_id") == a.series).first()
        if r is None:
            print(f"[ERROR] no series {a.series}", file=sys.stderr)
            return 1
        x = r.asDict(recursive=True)
        if a.field and a.field not in x:
            print(f"Unknown field '{a.field}'. Valid fields are {', '.join(x)}")
            return 1
        print(x[a.field] if a.field else json.dumps(x, indent=2) if a.json else "\n".join(f"{k}: {v}" for k, v in x.items()))
    elif a.command == "add":
        Store(spark, a.store).add(_one(spark, a.series), Ladder.of(*a.retentions), a.aggregationMethod, a.xFilesFactor)
    elif a.command == "load":
        broken = Store(spark, a.store).load_files(a.path, a.root)
        return _complain(broken)
    elif a.command == "restore":
        Store(spark, a.store).restore()
    elif a.command == "dump":
        if not a.raw:
            for h in ringfile.read_headers(spark, a.path, slots=True).where("error is null").orderBy("path").toLocalIterator():
                _header(h)
        slots = ringfile.dump(spark, a.path).orderBy("path", "level", "slot")
        if a.raw:
            _lines(slots.where(F.col("interval") > 0).select(raw_line("interval", "value").alias("line")))
        else:
            pattern = a.time_format or ("yyyy-MM-dd HH:mm:ss" if a.pretty else None)
            at = F.date_format(F.timestamp_seconds("interval"), pattern) if pattern else F.col("interval").cast("string")
            _lines(slots.select(F.concat_ws(" ", F.concat(F.col("level").cast("string"), F.lit("/"), F.col("slot").cast("string"), F.lit(":")), at, F.col("value").cast("string")).alias("line")))
        return _complain(ringfile.corrupt_files(spark, a.path, slots=True))
    elif a.command == "merge":
        Store(spark, a.target).merge(Store(spark, a.source), now, a.start, a.until)
    elif a.command == "fill":
        Store(spark, a.target).fill(Store(spark, a.source), now, a.mode)
    elif a.command == "diff":
        x, y = Store(spark, a.source), Store(spark, a.target)
        got = x.diff_summary(y, now, a.until, a.ignore_empty) if a.summary else x.diff(y, now, a.until, a.ignore_empty)
        got = got.orderBy(*[c for c in ("series_id", "level", "interval") if c in got.columns])
        if a.json:
            for r in got.toJSON().toLocalIterator():
                print(r)
        else:
            if not a.no_headers:
                print("\t".join(got.columns))
            for r in got.toLocalIterator():
                print("\t".join(str(v) for v in r))
    elif a.command == "resize":
        store = Store(spark, a.store)
        if a.backup:
            store.copy(a.backup)
        if a.newfile:
            store = store.copy(a.newfile)
        store.resize(Ladder.of(*a.retentions), now, a.aggregate, a.aggregationMethod, a.xFilesFactor, a.aligned, _one(spark, a.series))
    elif a.command == "set-aggregation-method":
        old = Store(spark, a.store).set_method(a.method, a.xff, _one(spark, a.series))
        print(f"Updated aggregation method: {a.store} ({old} -> {a.method})")
    elif a.command == "set-xfilesfactor":
        old = Store(spark, a.store).set_xff(a.xff, _one(spark, a.series))
        print(f"Updated xFilesFactor: {a.store} ({old} -> {a.xff})")
    elif a.command == "find-corrupt":
        for path in a.path:
            found = ringfile.read_headers(spark, path, slots=a.slots).cache()
            broken = found.where("error is not null").orderBy("path")
            for r in broken.toLocalIterator():
                print(f"deleting {r.path}" if a.delete_corrupt else r.path)
            if a.verbose:
                for r in found.where("error is null").orderBy("path").toLocalIterator():
                    print(f"{r.path}: {sum(x.points for x in r.archives)} points")
            if a.delete_corrupt:
                ringfile.delete_files(broken)
            found.unpersist()
    elif a.command == "follow-rules":
        store = Store(spark, a.store)
        given = (rulefile.read_rules(spark, a.storage), rulefile.read_rules(spark, a.aggregation) if a.aggregation else [])
        found = store.drift(*given) if a.dry_run else store.follow(*given, now, a.aggregate)
        if not a.quiet:
            for r in found.orderBy("series_id").toLocalIterator():
                print(f"{r.series_id}\t{r.current_retentions} {r.current_xff:.2f} {r.current_method}\t{r.retentions} {r.xff:.2f} {r.method}")
    elif a.command == "match-rules":
        listed = [rules.Rule(**x) for x in json.loads(a.rules)]
        for r in rules.apply_rules(spark.read.text(a.names).withColumnRenamed("value", "name"), listed, listed).toLocalIterator():
            print("\t".join(str(v) for v in r))
    elif a.command == "transform":
        def value(interval, v):
            return F.expr(a.expression)  # in terms of the columns interval and value

        Store(spark, a.store).transform(value, now, a.start, a.until)
    return 0


if __name__ == "__main__":
    sys.exit(main())
