"""Jobs run from another folder: the executors get the package from the driver."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

CODE = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
q = e.queries()
for name in ("clean_text", "op5_quality_rules", "op3_toxicity", "op4_packing"):
    assert q[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""


def test_from_another_folder(tmp_path):
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "all ran" in done.stdout, done.stderr[-2000:]
