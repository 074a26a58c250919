"""The driver's contract, with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["window_id", "dist", "rank"] and got.count() == 100


def test_queries_and_sql_agree():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values()))
    if entry.HAS_LLM:
        assert all(any(q.startswith(f"op{n}_") for q in queries) for n in range(1, 14))


def test_imports_without_the_corpus_operators(tmp_path):
    (tmp_path / "lodestone").mkdir()
    for part in (ROOT / "lodestone").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "lodestone" / part.name).symlink_to(part)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, timeout=120)
