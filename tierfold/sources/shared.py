"""Files that driver and executors share."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def findable(spark: SparkSession) -> SparkSession:
    """Python workers look for this package where the driver has it, besides where --py-files puts it on a cluster."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset on a local master, as in tests: on a cluster no folder of one machine will do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file:///tmp/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def settle(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, so that a loop over levels doesn't repeat what it has done."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
