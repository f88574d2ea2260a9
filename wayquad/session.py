"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(cores: str = "*", shuffle_partitions: int = 8, app: str = "wayquad") -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where none is configured a local session gets a temporary one, removed at the end of the process; any other
    session is refused, because its executors would not see a folder of the driver's machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="wayquad-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
        configured = sc.getCheckpointDir()
    return configured


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, row_bytes: int = 64, max_bytes: int = 32 << 20) -> DataFrame:
    """``df`` written to the shared folder, with a broadcast hint if its counted rows of ``row_bytes`` are at most ``max_bytes``."""
    df = pin(df)
    return F.broadcast(df) if df.count() * row_bytes <= max_bytes else df


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store with all that it holds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
