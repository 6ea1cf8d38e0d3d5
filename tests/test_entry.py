import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


def run_in(copy: Path, code: str) -> subprocess.CompletedProcess:
    """Python in the copy, with nothing of this repository on its path."""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=copy, env=environment, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("gone", [("quillon/llm", "tests/llm"), ("quillon/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    """The rest imports and has its queries when the corpus operators are deleted."""
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q)); import sys; print(*{m.__file__ for n, m in sys.modules.items() if n.split('.')[0] in ('quillon', 'corpus_pipeline', '__spark_entry__')}, sep=chr(10))"
    out = run_in(copy, code)
    assert out.returncode == 0, out.stderr
    first, *files = out.stdout.splitlines()
    assert files and all(Path(f).resolve().is_relative_to(copy.resolve()) for f in files)
    n, corpus, pipeline, oracles = first.split()
    assert int(n) >= 60 and (pipeline, oracles) == ("False", "True")
    if "quillon/llm" in gone:
        assert corpus == "0"


def test_a_broken_corpus_module_is_not_hidden(tmp_path):
    if not (REPO / "quillon" / "llm").exists():
        pytest.skip("the corpus operators are not there")
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    (copy / "quillon" / "llm" / "common.py").unlink()
    out = run_in(copy, "import __spark_entry__")
    assert out.returncode != 0 and "quillon.llm.common" in out.stderr
