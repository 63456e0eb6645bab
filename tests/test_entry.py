"""The driver's contract, with the text operators and without them."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

REPO = Path(__spark_entry__.__file__).parent


def test_entry(spark):
    assert [r.stage for r in __spark_entry__.entry(spark).orderBy("step").collect()][0] == "triggers"


def test_sql_has_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_imports_without_the_text_operators(tmp_path, pipeline):
    """With the pipeline's file left behind, and without it."""
    shutil.copytree(REPO / "threadline", tmp_path / "threadline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for file in REPO.glob("*.py"):
        if pipeline or file.name != "corpus_pipeline.py":
            shutil.copy(file, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
