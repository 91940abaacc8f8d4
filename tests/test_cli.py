import json

from tierfold import cli
from tierfold.functions.config import Ladder
from tierfold.sources.ringfile import write_file

NOW = "10000"


def test_commands(spark, tmp_path, capsys):
    store, other = str(tmp_path / "a"), str(tmp_path / "b")
    run = lambda *x: (cli.main([str(y) for y in x], spark), capsys.readouterr().out)[1]
    for s in (store, other):
        run("create", s, "1s:60", "10s:60", "--aggregationMethod", "sum", "--xFilesFactor", "0")
    assert cli.main(["create", store, "1s:60"], spark) == 1 and "already exists" in capsys.readouterr().err
    run("update", store, "s", "9995:1.5", "9996:2", "N:3", "--now", NOW)
    run("update", other, "s", "9996:5", "--now", NOW)
    assert cli.main(["update", store, "s", "1:5", "--now", NOW], spark) == 1
    capsys.readouterr()
    assert run("fetch", store, "s", "--from", 9994, "--until", 9996, "--now", NOW).split() == ["9995", "1.500000", "9996", "2.000000"]
    assert json.loads(run("fetch", store, "s", "--from", 9994, "--until", 9997, "--json", "--now", NOW)) == {"start": 9995, "end": 9998, "step": 1, "values": [1.5, 2.0, None]}
    assert "None" in run("fetch", store, "s", "--from", 9996, "--until", 9997, "--now", NOW)
    assert run("info", store, "s", "aggregation_method").strip() == "sum"
    assert cli.main(["info", store, "s", "nothing"], spark) == 1
    capsys.readouterr()
    assert len(run("diff", store, other, "--now", NOW, "--no-headers").splitlines()) == 3
    assert "differing" in run("diff", store, other, "--summary", "--json", "--now", NOW)
    run("merge", other, store, "--now", NOW)
    assert "5.000000" in run("fetch", store, "s", "--from", 9995, "--until", 9996, "--now", NOW)
    run("fill", store, other, "--mode", "strict", "--now", NOW)
    run("transform", store, "value * 2", "--from", 9990, "--now", NOW)
    assert "10.000000" in run("fetch", store, "s", "--from", 9995, "--until", 9996, "--now", NOW)
    assert "sum -> max" in run("set-aggregation-method", store, "max") and "0.5" in run("set-xfilesfactor", store, "0.5")
    run("resize", store, "2s:60", "20s:60", "--aggregate", "--now", NOW)
    assert json.loads(run("info", store, "s", "--json"))["archives"][0]["seconds_per_point"] == 2


def test_files_and_rules(spark, tmp_path, capsys):
    run = lambda *x: (cli.main([str(y) for y in x], spark), capsys.readouterr().out)[1]
    (tmp_path / "x.wsp").write_bytes(write_file(Ladder.of((1, 3)), "last", 0.5, {0: [(101, 2.0), (102, 3.5)]}))
    (tmp_path / "bad.wsp").write_bytes(b"no")
    assert run("dump", tmp_path, "--raw").split() == ["101:2.0", "102:3.5"]
    lines = run("dump", tmp_path).splitlines()
    assert lines[-1] == "0/2: 0 0.0" and lines[1:3] == ["method last, coverage 0.5, keeps 3 s", "level 0: 3 points of 1 s, 3 s in all, 36 bytes from 28"]
    assert cli.main(["dump", str(tmp_path)], spark) == 1 and "bad.wsp" in capsys.readouterr().err
    assert run("find-corrupt", tmp_path).strip().endswith("bad.wsp")
    (tmp_path / "names.txt").write_text("a.cpu\nb\n")
    assert run("match-rules", tmp_path / "names.txt", '[{"pattern": "cpu$", "retentions": "10s:1d"}]').splitlines()[0].split("\t")[1:3] == ["0", "10s:1d"]
    assert "17308" in run("create", "none", "60:1440", "--estimate")


def test_series_of_their_own_and_rules(spark, tmp_path, capsys):
    run = lambda *x: (cli.main([str(y) for y in x], spark), capsys.readouterr().out)[1]
    store = tmp_path / "st"
    run("create", store, "1s:60", "10s:60")
    run("add", store, "shop.sales", "2s:60", "--aggregationMethod", "sum", "--xFilesFactor", "0.1")
    run("update", store, "shop.sales", "9995:1.5", "9996:2", "--now", NOW)
    run("update", store, "cpu", "9995:1", "9996:2", "--now", NOW)
    assert run("fetch", store, "shop.sales", "--from", 9993, "--until", 9996, "--now", NOW).split() == ["9994", "1.500000", "9996", "2.000000"]
    assert cli.main(["update", str(store), "cpu", "9995:1", "nonsense", "--now", NOW], spark) == 1
    assert cli.main(["add", str(store), "cpu", "1s:60"], spark) == 1
    (tmp_path / "storage.conf").write_text("[a]\npattern = ^shop\nretentions = 5s:60, 10s:60\n\n[all]\npattern = .*\nretentions = 1s:60,10s:60\n")
    (tmp_path / "aggregation.conf").write_text("[a]\npattern = ^shop\nxFilesFactor = 0.25\naggregationMethod = max\n")
    given = ("--storage", tmp_path / "storage.conf", "--aggregation", tmp_path / "aggregation.conf", "--now", NOW)
    capsys.readouterr()
    said = run("follow-rules", store, *given, "--dry-run")
    assert said.splitlines() == ["shop.sales\t2:60 0.10 sum\t5:60,10:60 0.25 max"]
    assert run("follow-rules", store, *given) == said and run("follow-rules", store, *given) == ""
    assert json.loads(run("info", store, "shop.sales", "--json"))["archives"][0]["seconds_per_point"] == 5
    assert run("fetch", store, "shop.sales", "--from", 9989, "--until", 9996, "--now", NOW).split()[2:] == ["9995", "2.000000"]
    run("restore", store)
    assert json.loads(run("info", store, "shop.sales", "--json"))["archives"][0]["seconds_per_point"] == 2
    run("resize", store, "3s:60", "--series", "cpu", "--newfile", tmp_path / "new", "--now", NOW)
    assert json.loads(run("info", tmp_path / "new", "cpu", "--json"))["archives"][0]["seconds_per_point"] == 3
    assert json.loads(run("info", store, "cpu", "--json"))["archives"][0]["seconds_per_point"] == 1
    (tmp_path / "bad.conf").write_text("[a]\nretentions = 1s:60\n")
    assert cli.main(["follow-rules", str(store), "--storage", str(tmp_path / "bad.conf")], spark) == 1


def test_corrupt_files_go(spark, tmp_path, capsys):
    run = lambda *x: (cli.main([str(y) for y in x], spark), capsys.readouterr().out)[1]
    whole = write_file(Ladder.of((1, 3)), "last", 0.5, {0: [(101, 2.0)]})
    for name, content in (("x", whole), ("short", whole[:40]), ("bad", b"no")):
        (tmp_path / f"{name}.wsp").write_bytes(content)
    assert run("find-corrupt", tmp_path, "--verbose").count("points") == 2
    assert len(run("find-corrupt", tmp_path, "--slots").split()) == 2
    assert run("find-corrupt", tmp_path, "--delete-corrupt", "--slots").count("deleting") == 2
    assert [p.name for p in tmp_path.glob("*.wsp")] == ["x.wsp"]
