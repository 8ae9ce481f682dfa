"""Session helpers shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

STATE_STORE = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the jobs expect on a cluster too."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("downmark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("DOWNMARK_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session without the setting falls back to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="downmark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df):
    """Write the frame to the reliable checkpoint folder and read on from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Spark copies the archive to every executor, so they need no installed package
    and no shared working directory.
    """
    context = spark.sparkContext
    if getattr(context, "_downmark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(os.path.realpath(tempfile.mkdtemp(prefix="downmark-package-"))) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._downmark_shipped = True
