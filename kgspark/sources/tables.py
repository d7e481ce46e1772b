"""Parquet stage tables and resumable stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgspark.session import shuffles_freed


class Tables:
    """The parquet tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def save(df: DataFrame, root: str, name: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_freed(df.sparkSession):
        writer.parquet(f"{root.rstrip('/')}/{name}")


def exists(spark: SparkSession, root: str, name: str) -> bool:
    """True when the stage was written to its end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def stage(
    spark: SparkSession,
    root: str | None,
    name: str,
    compute: Callable[[], DataFrame],
    save_table: bool = True,
    try_load: bool = True,
    partition_by: tuple[str, ...] = (),
) -> DataFrame:
    """Read a finished stage back, or compute and write it first.

    Reading back what was written also cuts the lineage, so later stages do
    not recompute this one when an executor is lost.
    """
    if root is None or not save_table:
        return compute()
    if not (try_load and exists(spark, root, name)):
        save(compute(), root, name, partition_by)
    return load(spark, root, name)
