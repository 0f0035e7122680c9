"""Session defaults and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "factloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; what the caller or the cluster sets wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers: by path where they share this machine's files, else as a file that
    executors fetch. Done once per application."""
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parents[1])
    have = sc.environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
        if not on_one_machine(sc.master):
            d = tempfile.mkdtemp(prefix="factloom-ship-")  # executors fetch the file whenever they start: it stays until exit
            atexit.register(shutil.rmtree, d, ignore_errors=True)
            sc.addPyFile(shutil.make_archive(f"{d}/factloom", "zip", root, "factloom"))
    return spark


def on_one_machine(master: str) -> bool:
    """Whether driver and executors are one process; `local-cluster` starts executors of their own."""
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only where the setting is absent, as in tests on one
    machine, a temporary folder is made, kept in the session's setting and removed at exit."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not on_one_machine(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        folder = f"file://{path}"
        spark.sparkContext.setCheckpointDir(folder)
        _FALLBACK[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


_FALLBACK: dict[str, str] = {}


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df as a parquet table into the shared folder and read it back: lineage is cut, the work is done once,
    and the loss of an executor costs nothing that was written."""
    spark = df.sparkSession
    folder = _FALLBACK.get(spark.sparkContext.applicationId) or shared_folder(spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_STAGED: list[tuple[SparkSession, str]] = []


@contextmanager
def staged_here() -> Iterator[None]:
    """Tables staged inside the block are removed at its end. For callers that have written or collected the result; other
    staged tables live until the driver ends."""
    n = len(_STAGED)
    try:
        yield
    finally:
        _remove(n)


def _remove(since: int = 0) -> None:
    while len(_STAGED) > since:
        spark, path = _STAGED.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may already be gone
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


atexit.register(_remove)
