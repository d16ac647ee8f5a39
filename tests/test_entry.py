"""The driver's contract, with and without the optional part."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_llm(tmp_path):
    for name in ("__spark_entry__.py", "reelquery"):
        (tmp_path / name).symlink_to(ROOT / name)
    code = "import sys; sys.modules['reelquery.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'retrieval_topk' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_llm():
    for p in (ROOT / "reelquery").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "reelquery").parts:
            assert "reelquery.llm" not in p.read_text(), p
