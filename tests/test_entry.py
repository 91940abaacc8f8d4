import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_is_of_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_part(tmp_path):
    """The rest imports when the subpackage and the pipeline are gone, even if an empty folder is left."""
    shutil.copytree(ROOT / "tierfold", tmp_path / "tierfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'rollup_chain3' in n and 'pipeline' not in n and not [x for x in n if x.startswith('op')]; e.oracle_sql()"
    for leftover in (False, True):
        if leftover:
            (tmp_path / "tierfold" / "llm" / "__pycache__").mkdir(parents=True)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_the_rest_runs_without_the_training_data_part(tmp_path):
    shutil.copytree(ROOT / "tierfold", tmp_path / "tierfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = """
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() > 0
q = e.queries()
assert all(q[n](spark, "/root/testdata/sf0.001").count() > 0 for n in ("fetch_auto", "replay_late_points", "resize_plain"))
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
