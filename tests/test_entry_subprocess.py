"""The driver imports __spark_entry__ from its own working directory with its
own session: Python workers must still find the package."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as e
assert e.entry(spark).count() == 6
assert e.queries()["loss_gradient"](spark, "/root/testdata/sf0.001").count() == 6
print("OK")
"""


def test_entry_from_other_directory():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tempfile.mkdtemp(), env=env,
                         capture_output=True, text=True, timeout=600)
    assert "OK" in out.stdout, out.stderr[-2000:]
