"""The shared folder where the cluster names none."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

UNSET = """
from inkwell.session import builder, enable, shared_dir
s = enable(builder().master("local[2]").config("spark.ui.enabled", "false").getOrCreate())
assert s.conf.get("spark.checkpoint.dir", None) is None
path = shared_dir(s)
assert path == shared_dir(s)
s.range(7).write.parquet(path + "/t")
assert s.read.parquet(path + "/t").count() == 7
"""


def test_local_master_without_a_shared_folder(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root + os.pathsep + os.environ.get("PYTHONPATH", "")}
    done = subprocess.run([sys.executable, "-c", UNSET], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
