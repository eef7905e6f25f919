"""Queries from another working folder, where executors cannot import this package."""

import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
import importlib.util
def absent(_):
    yield importlib.util.find_spec("webloom") is None
assert spark.sparkContext.range(0, 4, numSlices=2).mapPartitions(absent).collect() == [True, True]
from webloom.llm.queries import QUERIES
for name, query in QUERIES.items():
    print(name, query(spark, sys.argv[2]).count(), flush=True)
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_executors_need_no_copy_of_the_package(tmp_path):
    (tmp_path / "script.py").write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "script.py", ROOT, SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.split("\n")) >= 13
