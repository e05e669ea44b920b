"""The registry, and that it stands without the training-data folder."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns == ["source", "node", "dist"] and got.count() > 0


def test_without_the_training_data_folder(tmp_path):
    (tmp_path / "weftnet").mkdir()
    for part in (ROOT / "weftnet").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "weftnet" / part.name).symlink_to(part)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    code = "import sys; sys.path[:0] = [sys.argv[1]]; import importlib.util as u; s = u.spec_from_file_location('e', sys.argv[1] + '/__spark_entry__.py'); m = u.module_from_spec(s); s.loader.exec_module(m); print(len(m.queries()), len(m.oracle_sql()), any(q.startswith('op') for q in m.queries()))"
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, cwd=tmp_path, check=True).stdout.split()
    assert int(out[0]) > 40 and int(out[1]) > 30 and out[2] == "False"
