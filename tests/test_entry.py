"""The registry, with and without the training-data package."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q), set(o) - set(q); assert all(map(callable, q.values())); print(len(q), 'op1_warc' in q)"


def ask(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split()


def test_registry():
    n, has = ask(ROOT)
    assert int(n) >= 60 and has == str(os.path.isfile(os.path.join(ROOT, "loomdex", "llm", "queries.py")))


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
@pytest.mark.parametrize("left", [False, True])
def test_registry_without_llm(tmp_path, also, left):
    """With the two folders gone or empty, with or without the pipeline beside them."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", *also, "__pycache__", "spark-warehouse"))
    if left:
        (copy / "loomdex" / "llm" / "__pycache__").mkdir(parents=True)
    n, has = ask(copy)
    assert int(n) >= 110 and has == "False"


def test_a_broken_import_is_not_swallowed(tmp_path):
    if not os.path.isfile(os.path.join(ROOT, "loomdex", "llm", "queries.py")):
        pytest.skip("the llm folders are absent")
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    os.remove(copy / "loomdex" / "llm" / "vectors.py")
    with pytest.raises(subprocess.CalledProcessError):
        ask(copy)


def test_nothing_outside_imports_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "loomdex")):
        for name in names:
            if name.endswith(".py") and os.path.basename(folder) != "llm":
                with open(os.path.join(folder, name)) as f:
                    assert "loomdex.llm" not in f.read(), name
