"""Executors of a cluster get the package as a file and import it from there."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
from factloom.session import get_session
s = get_session("ship", master="local-cluster[2,1,1024]", **{"spark.checkpoint.dir": "file:///tmp/factloom-ship-test", "spark.sql.shuffle.partitions": "2", "spark.executorEnv.PYTHONPATH": ""})
s.sparkContext.setLogLevel("OFF")
def where(_):
    import factloom, os
    from factloom.functions import timeparse
    return [os.path.dirname(factloom.__file__)]
print("FROM", sorted(set(s.sparkContext.parallelize(range(4), 4).mapPartitions(where).collect())))
s.stop()
"""


def test_package_reaches_executors(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {root!r})" + CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "FROM [" in r.stdout and "factloom.zip" in r.stdout.split("FROM")[1], r.stderr[-2000:]
