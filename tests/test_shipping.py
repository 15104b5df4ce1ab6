import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
print("ROWS", e.queries()["segment_batches"](spark, {data!r}).count())
"""


def test_workers_find_the_package_from_any_folder(data, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT), data=data)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS" in run.stdout, run.stderr[-2000:]
