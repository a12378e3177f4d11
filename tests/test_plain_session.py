"""A local session without any setting of ours: in a process of its own, since settings can't be taken back."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
from pyspark.sql import SparkSession
from matchloom.sources import files
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
made = files.shared_folder(spark)
assert made == files.shared_folder(spark)
assert spark.conf.get("spark.checkpoint.dir", None) is None
spark.range(3).write.parquet(made + "/rows")
assert spark.read.parquet(made + "/rows").count() == 3
print("fine")
"""


def test_shared_folder_without_a_setting():
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_CONF_DIR": os.path.join(ROOT, "no-such-folder")}
    out = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("fine"), out.stderr[-2000:]
