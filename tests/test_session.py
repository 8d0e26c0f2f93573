"""The shared folder, and the package on workers that do not have its source folder."""

import os
import subprocess
import sys
import textwrap
import zipfile
from pathlib import Path
from types import SimpleNamespace

import pytest

from kohorta import session

REPO = Path(__file__).resolve().parent.parent


def test_cluster_needs_a_shared_folder():
    for folder in (None, "file:/tmp/x"):
        spark = SimpleNamespace(
            sparkContext=SimpleNamespace(master="spark://host:7077"), conf=SimpleNamespace(get=lambda key, default, f=folder: f)
        )
        spark.sparkContext.getConf = lambda: SimpleNamespace(get=lambda key: None)
        with pytest.raises(ValueError, match="share"):
            session.checkpoint_dir(spark)


def _run(script: str, cwd: Path, **env: str) -> str:
    done = subprocess.run(
        [sys.executable, "-c", textwrap.dedent(script)], cwd=cwd, env={**os.environ, **env}, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_nothing_stays_in_the_shared_folder(tmp_path):
    shared = tmp_path / "shared"
    _run(
        f"""
        from pyspark.sql import SparkSession
        from kohorta.session import written
        spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
                 .config("spark.checkpoint.dir", "file://{shared}").getOrCreate())
        assert written(spark.range(5), "five").count() == 5
        spark.stop()
        """,
        tmp_path,
        PYTHONPATH=str(REPO),
    )
    assert shared.exists() and not list(shared.glob("kohorta-*"))


def test_workers_take_the_package_from_an_archive(tmp_path):
    archive = tmp_path / "kohorta.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in (REPO / "kohorta").rglob("*.py"):
            z.write(path, path.relative_to(REPO))
    out = _run(
        f"""
        import sys
        sys.path.insert(0, "{archive}")
        import numpy as np
        from pyspark.sql import SparkSession, functions as F
        from kohorta.operators.cluster import assign
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.addPyFile("{archive}")
        points = spark.range(10).select("id", F.array(F.col("id").cast("double")).alias("features"))
        print(sorted(r.labels[0] for r in assign(points, [np.array([[0.0], [9.0]])]).collect()))
        """,
        tmp_path,
        PYTHONPATH="",
    )
    assert "[0, 0, 0, 0, 0, 1, 1, 1, 1, 1]" in out
