"""The contract's three functions, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q), set(o) - set(q); print(len(q), *sorted(n for n in q if n.startswith('op') and n[2].isdigit()))"


def said(folder):
    out = subprocess.run([sys.executable, "-c", SAYS], cwd=folder, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(folder)})
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_imports_without_corpus_operators(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/veilspark", tmp_path / "veilspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    n, *corpus = said(tmp_path)
    assert int(n) > 25 and not corpus


def test_registers_all(spark):
    import __spark_entry__

    n, *corpus = said(ROOT)
    assert len(corpus) in (0, 13) and int(n) >= 25 + len(corpus)
    assert __spark_entry__.entry(spark).count() > 0
