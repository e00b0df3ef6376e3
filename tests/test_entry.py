import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__spark_entry__.__file__).resolve().parent


def test_entry(spark):
    if Path("/root/testdata/sf0.001").exists():
        r = __spark_entry__.entry(spark).first()
        assert r["count"] == 500 and r.correct > 0


def test_each_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_subpackage(tmp_path):
    """The rest imports and has its queries when that subpackage is gone; its own errors are not hidden."""
    for name in ("__spark_entry__.py", "tensorframe"):
        source = REPO / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "tensorframe/llm", ignore_errors=True)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and all(n.startswith('q_') for n in q)"], cwd=tmp_path, capture_output=True, text=True)
    assert run().returncode == 0, run().stderr
    (tmp_path / "tensorframe/llm").mkdir()
    (tmp_path / "tensorframe/llm/__init__.py").write_text("import surely_not_installed\n")
    assert "surely_not_installed" in run().stderr
