"""The driver's contract where parts of the repository are gone."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
USE = """
import __spark_entry__ as e
assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries()), len(e.queries())
assert not [n for n in e.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"]
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.queries()["lang_counts"](spark, "/root/testdata/sf0.001").count() > 0
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_llm_folders(tmp_path, pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm"))
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", USE], cwd=copy, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
