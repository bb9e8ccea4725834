"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import os
import shutil
import site
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "wicketlake",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session for local runs and tests.

    On a cluster the session normally comes from the launcher; this builder
    sets what the library relies on (UTC, AQE, no UI). Memory and the number
    of shuffle partitions are set for local mode only.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    if master is None and "spark.master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        master = os.environ.get("WICKETLAKE_MASTER", "local[8]")
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        # One process: as many shuffle partitions as threads, and its memory.
        cores = master[master.find("[") + 1:master.find("]")] if "[" in master else "1"
        parts = shuffle_partitions or (int(cores) if cores.isdigit() else os.cpu_count())
        builder = (builder.config("spark.sql.shuffle.partitions", str(parts))
                   .config("spark.driver.memory", os.environ.get("WICKETLAKE_DRIVER_MEMORY", "16g")))
    elif shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there. Only a local-mode session, whose
    driver and executors are one process, gets a folder of its own when the
    setting is absent; elsewhere a missing setting is an error, because
    executors would write to their own disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="wicketlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written intermediate table, under the shared
    checkpoint folder (never a machine-local temporary folder)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/wicketlake/{name}-{uuid.uuid4().hex[:12]}"


#: Spark's setting that removes the shuffle files of a query when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here leave no shuffle files. Else these stay until
    the driver collects garbage, and the shuffles of all steps add up."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read
    back: later passes read a table, not the lineage behind it, and the
    shuffles that made it are freed."""
    path = scratch_path(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._folder = path
    return made


def emptied(table: DataFrame) -> None:
    """Free the disk of a ``written`` table that no step reads any more, by an
    empty table in its place. A lazy table over it cannot be read then."""
    table.sparkSession.createDataFrame([], table.schema).coalesce(1).write.mode("overwrite").parquet(table._folder)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers.

    Workers find it by themselves where the driver was started in its folder
    or has it on PYTHONPATH (or it is installed on every node). Elsewhere it
    is sent once per application, as a Spark job's other Python files are."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep), site.getsitepackages()[0]]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or root in map(os.path.abspath, filter(None, known)):
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="wicketlake-package-"), "wicketlake"), "zip", root, "wicketlake")
    spark.sparkContext.addPyFile(made)  # from the driver's own folder; Spark serves it to the executors
    _SHIPPED.add(app)
