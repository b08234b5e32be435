"""The entry point without the corpus operators, and with a session that knows nothing of the packages."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def copy(to, without=()):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in without and (ROOT / name).exists():
            shutil.copy(ROOT / name, to / name)
    shutil.copytree(ROOT / "panelloom", to / "panelloom", ignore=shutil.ignore_patterns("__pycache__", *without))


def names(at, before=""):
    code = f"{before}import __spark_entry__ as e; print(*e.queries())"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=at, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return set(run.stdout.split())


@pytest.mark.parametrize("kind", ["folder", "leftover", "library"])
def test_other_queries_register_without_the_corpus_operators(tmp_path, kind):
    copy(tmp_path, ("llm", "corpus_pipeline.py") if kind == "folder" else ("llm",) if kind == "leftover" else ())
    if kind == "leftover":  # an empty package of that name
        (tmp_path / "panelloom/llm/__pycache__").mkdir(parents=True)
    found = names(tmp_path, "import sys; sys.modules['zstandard'] = None; " if kind == "library" else "")
    assert len(found) > 200 and "pipeline" not in found and not any(n.startswith("op") for n in found)


@pytest.mark.skipif(not (ROOT / "panelloom/llm").is_dir(), reason="without the corpus operators")
def test_a_session_that_began_before_the_import_finds_the_packages(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
print("rows", e.queries()["op8_main_text"](spark, "/root/testdata/sf0.001").count())
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0 and int(run.stdout.split("rows ")[1]) > 0, run.stderr[-2000:]
