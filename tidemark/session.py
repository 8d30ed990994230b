"""Session settings, the shared work folder and shipping of the package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def build_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tidemark")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is the cluster's ``spark.checkpoint.dir``. Only a local master, whose executors share this machine's disk, may
    go without; on a cluster a missing setting is an error, since a machine-local folder would lose data.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        named = _local_shared()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_local: list[str] = []


def _local_shared() -> str:
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return "file://" + _local[0]


_run_dirs: dict[str, str] = {}


def _run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; the file system deletes it when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _run_dirs:
        named = f"{shared_dir(spark)}/tidemark-{app}-{uuid.uuid4().hex[:8]}"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _run_dirs[app] = named
    return _run_dirs[app]


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for a written intermediate table in the shared folder, which lasts as long as the application."""
    return f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables made so far; results not yet read that come from them are lost. For applications that run long."""
    named = _run_dirs.pop(spark.sparkContext.applicationId, None)
    if named:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df, name: str):
    """Write ``df`` to the shared folder and read it back: cuts lineage, and survives the loss of executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tidemark-ship-")  # read by the driver's file server only
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "tidemark_pkg.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    spark.sparkContext.addPyFile(archive)


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
