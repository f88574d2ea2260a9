"""The index and cell similarities on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_index(trajectories: DataFrame, path: str, partitions: int | None = None) -> None:
    """Trajectories in the order of their codes, so that ranges of codes prune files and row groups."""
    ranged = trajectories.repartitionByRange(partitions, "quad_code") if partitions else trajectories.repartitionByRange("quad_code")
    ranged.sortWithinPartitions("quad_code", "tid").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan(index: DataFrame, lo: int, hi: int) -> DataFrame:
    """Trajectories with codes in [lo, hi): the filter reaches the Parquet scan."""
    return index.where((F.col("quad_code") >= lo) & (F.col("quad_code") < hi))


def lookup(index: DataFrame, tids: list[int]) -> DataFrame:
    """Trajectories by id; ids that are not there are skipped."""
    return index.where(F.col("tid").isin(tids))


def save_similarity(sims: DataFrame, path: str) -> None:
    sims.write.mode("overwrite").parquet(path)


def load_similarity(spark: SparkSession, path: str, cells: DataFrame) -> DataFrame | None:
    """Saved similarities, or none if they name cells that the index does not have."""
    sims = spark.read.parquet(path)
    named = sims.select(F.col("code_a").alias("quad_code")).union(sims.select("code_b")).distinct()
    return sims if named.join(cells, "quad_code", "left_anti").limit(1).count() == 0 else None
