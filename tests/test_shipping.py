"""The package reaches the workers from wherever a job is started."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys
from datetime import datetime
sys.path.insert(0, {root!r})
import __spark_entry__ as contract
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", {shared!r}).getOrCreate())
rows = contract.queries()["reassemble"](spark, "/root/testdata/sf0.001")
print("ROWS", rows.count())
"""


def test_started_from_another_folder(tmp_path):
    script = SCRIPT.format(root=str(ROOT), shared=str(tmp_path / "shared"))
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.rsplit("ROWS", 1)[1]) > 0
