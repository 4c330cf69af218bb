import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "route", "memory_id", "rank0", "score"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_llm_part(tmp_path):
    """The rest imports and registers its queries when the training-data operators are gone."""
    for f in ("__spark_entry__.py", "jobs", "loreweave"):
        (tmp_path / f).symlink_to(ROOT / f)
    (tmp_path / "loreweave").unlink()
    (tmp_path / "loreweave").mkdir()
    for f in (ROOT / "loreweave").iterdir():
        if f.name not in ("llm", "__pycache__"):
            (tmp_path / "loreweave" / f.name).symlink_to(f)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and 'job1_index_texts' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, timeout=120).returncode == 0


def test_nothing_else_imports_the_llm_part():
    for f in [*(ROOT / "loreweave").rglob("*.py"), *(ROOT / "jobs").rglob("*.py"), ROOT / "tests/test_jobs.py"]:
        if "llm" not in f.relative_to(ROOT).parts:
            assert "loreweave.llm" not in f.read_text() and "corpus_pipeline" not in f.read_text(), f
