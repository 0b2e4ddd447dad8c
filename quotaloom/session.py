"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "quotaloom", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    On a cluster pass no master and let spark-submit decide; locally the number
    of shuffle partitions follows the thread count.
    """
    builder = SparkSession.builder.appName(app_name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if master:
        builder = builder.master(master)
        settings["spark.ui.enabled"] = "false"
        settings["spark.ui.showConsoleProgress"] = "false"
        settings["spark.sql.shuffle.partitions"] = str(os.cpu_count() or 8)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Where none is set a local session gets a private one; on a cluster each machine
    would write to its own disk, so a session without a shared folder is refused.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="quotaloom-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared checkpoint folder.

    Parquet rather than an RDD checkpoint: readers prune columns, and the planner
    and AQE see the real size.  The rows survive the loss of any executor.
    """
    folder = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python finds it wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_quotaloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quotaloom-package-")) / "quotaloom-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._quotaloom_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a scan of fewer partitions than cores before heavy per-row work.

    A table of many files keeps its partitions; only a few large row groups are moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
