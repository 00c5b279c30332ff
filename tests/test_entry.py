"""What the driver calls, with and without the llm subpackage."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

TOP = os.path.dirname(os.path.abspath(entry.__file__))


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "reuse_matches" in entry.queries()


def test_imports_without_llm(tmp_path):
    """The rest neither needs the subpackage nor imports it."""
    for name in os.listdir(TOP):
        if name not in ("assonance", "corpus_pipeline.py", ".git"):
            os.symlink(f"{TOP}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "assonance")
    for name in os.listdir(f"{TOP}/assonance"):
        if name != "llm":
            os.symlink(f"{TOP}/assonance/{name}", tmp_path / "assonance" / name)
    os.unlink(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(open(f"{TOP}/__spark_entry__.py").read())
    code = "import sys, __spark_entry__ as e; q = e.queries(); assert 'reuse_matches' in q and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q); assert not [m for m in sys.modules if 'llm' in m]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


@pytest.mark.skipif(not os.path.exists(entry.SMOKE), reason="the driver's tables aren't here")
def test_flagship(spark):
    assert entry.entry(spark).columns[:2] == ["u_id", "v_id"]
