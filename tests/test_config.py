import struct

import pytest

from tierfold.functions import config as c


@pytest.mark.parametrize(("text", "want"), [("60:10", (60, 10)), ("10:60", (10, 60)), ("10s:10h", (10, 3600)), ("15m:8", (900, 8)), ("1h:7d", (3600, 168)), ("12h:2y", (43200, 1460)), ("1min:2weeks", (60, 20160))])
def test_retentions(text, want):
    assert c.parse_retention(text) == want


@pytest.mark.parametrize("text", ["10x:10", "60:10x", "10", "10X:10", "10:10$", "", ":", "1m", "1M:10", "0:10"])
def test_bad_retentions(text):
    with pytest.raises(ValueError):
        c.parse_retention(text)


def test_units():
    assert [c.unit_of(x) for x in ("s", "min", "minutes", "h", "d", "week", "y")] == ["seconds", "minutes", "minutes", "hours", "days", "weeks", "years"]
    with pytest.raises(ValueError, match="'z' is no unit"):
        c.unit_of("z")


def test_ladders():
    for good in ([(1, 60), (60, 60)], [(60, 60), (6, 60)]):
        c.validate(good)
    for bad in ([], [(1, 60), (60, 60), (1, 60)], [(60, 60), (7, 60)], [(1, 60), (10, 1)], [(1, 30), (60, 60)]):
        with pytest.raises(c.InvalidConfiguration):
            c.validate(bad)
    assert c.Ladder.of("1d:60d", "1h:7d").pairs() == [(3600, 168), (86400, 60)]


def test_coverage_factor():
    assert c.stored_xff(0.42) == struct.unpack("f", struct.pack("f", 0.42))[0] != 0.42
    for bad in ("zero", -1, 2, None):
        with pytest.raises(c.InvalidConfiguration):
            c.stored_xff(bad)
    with pytest.raises(c.InvalidMethod):
        c.checked_method("median")


def test_estimate():
    assert c.estimate_bytes([(60, 1440)]) == (17308, 20480)
    assert c.estimate_bytes([c.parse_retention(x) for x in ("1h:7d", "6h:14d", "1d:60d")]) == (3460, 4096)
