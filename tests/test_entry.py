import os
import subprocess
import sys

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_queries_and_sql_have_the_same_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 60


@needs_data
def test_entry_gives_rows(spark):
    row = __spark_entry__.entry(spark).first()
    assert row["n_queries"] > 0 and 0 <= row["recall_at5"] <= 1


def test_importable_without_the_llm_folders(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "prismrank"):
        os.symlink(os.path.join(here, name), tmp_path / name) if name.endswith(".py") else None
    (tmp_path / "prismrank").mkdir()
    for part in os.listdir(os.path.join(here, "prismrank")):
        if part not in ("llm", "__pycache__"):
            os.symlink(os.path.join(here, "prismrank", part), tmp_path / "prismrank" / part)
    said = subprocess.run([sys.executable, "-c", "import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; assert e.corpus is None; print(len(e.queries()))", str(tmp_path)], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[-1]) > 60
