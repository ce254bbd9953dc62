import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_queries_have_sql_of_the_same_name():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.catalog.QUERIES) >= 40 and set(entry.catalog.QUERIES) == set(entry.catalog.SQL)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_works_without_the_optional_part(tmp_path):
    import shutil

    shutil.copytree(ROOT / "tideframe", tmp_path / "tideframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(entry.catalog.QUERIES)), str(len(entry.catalog.SQL))]


def test_works_where_the_optional_part_cannot_be_imported(tmp_path):
    import shutil

    shutil.copytree(ROOT / "tideframe", tmp_path / "tideframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "tideframe" / "llm").mkdir()
    (tmp_path / "tideframe" / "llm" / "__init__.py").write_text("import a_package_that_is_not_there\n")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(entry.catalog.QUERIES))] and "a_package_that_is_not_there" in out.stderr
