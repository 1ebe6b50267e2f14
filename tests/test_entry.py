"""The entry must import, and its queries run, whether or not the training-data operators are present."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

CHECK = """
import sys
import __spark_entry__ as entry
names = set(entry.queries())
assert "panelstress.llm" not in sys.modules
assert not [n for n in names if n.startswith("op") or n == "pipeline"], names
assert set(entry.oracle_sql()) <= names and len(names) >= 129
"""

RUN = """
from pyspark.sql import SparkSession
from panelstress.session import configure
spark = configure(SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate())
assert entry.queries()["a1_rainfall_reader"](spark, sys.argv[1]).count() > 0
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, pipeline):
    left_out = ["llm", "__pycache__", ".git", *([] if pipeline else ["corpus_pipeline.py"])]
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(*left_out))
    assert (copy / "corpus_pipeline.py").exists() == pipeline
    run = RUN if pipeline and os.path.isdir(SF) else ""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CHECK + run, SF], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
