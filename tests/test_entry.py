"""The registered queries must not need the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_training_data_operators(tmp_path):
    left = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=left)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and set(q) == set(e.oracle_sql()); print(*q)"
    env = os.environ | {"PYTHONPATH": str(tmp_path / "repo")}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert "op8" not in said.stdout and "pipeline" not in said.stdout


def test_other_missing_modules_are_not_hidden(tmp_path):
    left = shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", "test*", "bpe.py")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=left)
    package = tmp_path / "repo" / "pastlane" / "llm"
    if package.exists():
        (package / "bpe.py").write_text("import no_such_module\n")
        env = os.environ | {"PYTHONPATH": str(tmp_path / "repo")}
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "repo", env=env, capture_output=True, text=True)
        assert "no_such_module" in said.stderr and said.returncode


def test_entry_without_a_library_of_theirs():
    code = ("import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); "
            "assert len(q) > 40 and 'op5_licence_scan' not in q")
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr


def test_workers_find_the_package_from_any_folder(tmp_path):
    """The driver runs elsewhere and has the repository on its own path only."""
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "from pastlane.session import local_session, use_query_settings\n"
            f"spark = use_query_settings(local_session(cores=1, partitions=1, memory='1g', scratch={str(tmp_path)!r}))\n"
            "from pyspark.sql import functions as F\n"
            "from pastlane.operators.cutting import time_length_batch\n"
            "rows = spark.range(10).select(F.lit(1).alias('link_id'), F.lit(1.0).alias('speed'), F.lit(1).alias('volume'), 'id',"
            " F.timestamp_seconds('id').cast('timestamp_ntz').alias('ts'))\n"
            "assert time_length_batch(rows, 60, 3, 60, ['id']).count() == 3\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
