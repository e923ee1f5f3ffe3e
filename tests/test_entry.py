"""The driver contract without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; from pagewatch.plans import catalogue as c; assert set(e.queries()) == set(c.QUERIES) and set(e.oracle_sql()) == set(c.ORACLE_SQL)"


def run(folder, code):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, check=True, timeout=120)


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/pagewatch", tmp_path / "pagewatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    run(tmp_path, CODE)
    (tmp_path / "pagewatch/llm/__pycache__").mkdir(parents=True)  # what a removal may leave
    run(tmp_path, CODE)


def test_entry_without_a_library(tmp_path):
    shutil.copytree(f"{ROOT}/pagewatch", tmp_path / "pagewatch", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    run(tmp_path, "import sys; sys.modules['ahocorasick'] = None\n" + CODE)
