"""Queries with Python in their tasks, from another working folder, where executors cannot import this package."""

import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "dom_depth listing_sections listing_plugin listing_plugin_sql template_records template_pages live_completions".split()
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from webloom.plans.queries import QUERIES
for name in sys.argv[3:]:
    print("ROWS", name, len(QUERIES[name](spark, sys.argv[2]).collect()), flush=True)
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_executors_need_no_copy_of_the_package(tmp_path):
    (tmp_path / "script.py").write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "script.py", ROOT, SF, *NAMES], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    counts = {line.split()[1]: int(line.split()[2]) for line in done.stdout.split("\n") if line.startswith("ROWS")}
    assert list(counts) == NAMES and all(counts.values())
