import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

TOP = Path(__file__).resolve().parents[1]


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["profile", "place", "title", "stamp", "percent", "event_id"]
    assert df.count() > 0


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_alone(tmp_path):
    for p in ("reelforge", "__spark_entry__.py"):
        (shutil.copytree if (TOP / p).is_dir() else shutil.copy)(TOP / p, tmp_path / p)
    shutil.rmtree(tmp_path / "reelforge/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
