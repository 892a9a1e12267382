"""The engine without the corpus operators."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from kokek.plans import registry

ROOT = Path(__file__).resolve().parent.parent
LISTS = "import __spark_entry__ as e, json; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def copy_without(tmp_path, *gone):
    """A copy of the repository without some of its files and folders."""
    left = lambda folder, names: [n for n in names if n in ("__pycache__", ".git", ".pytest_cache") or str((Path(folder) / n).relative_to(ROOT)) in gone]
    shutil.copytree(ROOT, tmp_path / "copy", ignore=left)
    return tmp_path / "copy"


def run(folder, text):
    out = subprocess.run([sys.executable, "-c", text], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)} | _java())
    assert out.returncode == 0, out.stderr[-3000:]
    return out


def _java():
    return {k: v for k, v in os.environ.items() if k in ("JAVA_HOME", "PATH", "SPARK_LOCAL_IP", "HOME")}


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_corpus_folders(tmp_path, pipeline):
    folder = copy_without(tmp_path, "kokek/llm", "tests/llm", *([] if pipeline else ["corpus_pipeline.py"]))
    names, sql = json.loads(run(folder, LISTS).stdout)
    assert names == sorted(registry.QUERIES) and sql == sorted(registry.ORACLE_SQL)


def test_entry_runs_without_the_corpus_folders(tmp_path):
    folder = copy_without(tmp_path, "kokek/llm", "tests/llm")
    text = "from pyspark.sql import SparkSession\nimport __spark_entry__ as e\nspark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\ndf = e.queries()['tokenize'](spark, '/root/testdata/sf0.001')\nassert df.count() > 0\nassert e.entry(spark).columns"
    run(folder, text)


def test_an_error_inside_the_corpus_folders_leaves_the_rest(tmp_path):
    if not (ROOT / "kokek" / "llm").is_dir():
        pytest.skip("no corpus operators here")
    folder = copy_without(tmp_path)
    (folder / "kokek" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    out = run(folder, LISTS)
    assert json.loads(out.stdout)[0] == sorted(registry.QUERIES)
    assert "cannot be imported" in out.stderr
