"""Rule files: sections in order, each with a pattern and what it gives.

    [sales]
    pattern = ^shop\\.sales\\.
    retentions = 1m:7d, 1h:1y

gives ladders; ``xFilesFactor`` and ``aggregationMethod`` in place of ``retentions`` give the rest.
"""

from __future__ import annotations

import configparser

from pyspark.sql import SparkSession

from tierfold.functions.config import InvalidConfiguration, Ladder, checked_method, stored_xff
from tierfold.operators.rules import Rule


def parse_rules(text: str) -> list[Rule]:
    parser = configparser.ConfigParser(interpolation=None, strict=True, default_section="")
    try:
        parser.read_string(text)
    except configparser.Error as e:
        raise InvalidConfiguration(str(e)) from e
    out = []
    for name in parser.sections():
        x = parser[name]
        if "pattern" not in x:
            raise InvalidConfiguration(f"[{name}] has no pattern")
        retentions, xff, method = x.get("retentions"), x.get("xfilesfactor"), x.get("aggregationmethod")
        if retentions:
            Ladder.of(*[r.strip() for r in retentions.split(",")])
        if xff is not None:
            stored_xff(xff)
        out.append(Rule(x["pattern"], retentions, float(xff) if xff is not None else None, checked_method(method) if method else None))
    return out


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    return parse_rules("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
