"""Intermediate folders belong to the application and go with it."""

from __future__ import annotations

import os
import subprocess
import sys

from tidemark.sources import scratch

RUN = """
import sys
from pyspark.sql import SparkSession
from tidemark.sources import scratch
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
df = scratch.staged(spark.range(5))
print("HELD", df.count(), df.inputFiles()[0])
"""


def test_folders_go_with_the_application(tmp_path):
    done = subprocess.run([sys.executable, "-c", RUN, f"file://{tmp_path}"], capture_output=True, text=True, env=os.environ, check=True)
    held = next(line for line in done.stdout.splitlines() if line.startswith("HELD")).split()
    assert held[1] == "5" and str(tmp_path) in held[2]
    assert not list(tmp_path.rglob("*.parquet"))


def test_paths_are_new_and_shared(spark):
    a, b = scratch.scratch(spark), scratch.scratch(spark)
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0] and spark.sparkContext.applicationId in a
