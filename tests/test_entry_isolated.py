"""The driver imports __spark_entry__ by path from another working directory
with its own session; jobs that run Python in tasks must still work."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile

from conftest import ROOT, SF001

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.ansi.enabled", "false").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
spec = importlib.util.spec_from_file_location("__spark_entry__", {os.path.join(ROOT, "__spark_entry__.py")!r})
E = importlib.util.module_from_spec(spec)
spec.loader.exec_module(E)
q = E.queries()
print("ROWS", E.entry(spark).count(), q["chi_square_test"](spark, {SF001!r}).count(),
      q["pareto_full_curve"](spark, {SF001!r}).count())
"""


def test_entry_from_foreign_cwd():
    cwd = tempfile.mkdtemp(prefix="lateflow-driver-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True, timeout=600
    )
    assert out.returncode == 0, out.stderr[-3000:]
    rows = next(line for line in out.stdout.splitlines() if line.startswith("ROWS")).split()[1:]
    assert rows[0] == "4" and rows[1] == "1" and int(rows[2]) > 0
