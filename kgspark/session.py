"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # names and ids shrink much in a shuffle; the usual 64 MB of them are many million rows for one task's sorts and hash tables
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a budget's first rows of a group are picked before the shuffle, so that no task gets a whole group
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
}

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time SQL settings the jobs rely on, and send the package to the workers."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        # staged next to the driver; Spark's own file service hands it to the executors
        package = Path(__file__).parent
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp(prefix='kgspark-code-')}/kgspark", "zip", package.parent, package.name
        )
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and stage tables, as the cluster names it.

    Only a local session may fall back to a temporary folder; on a cluster a
    machine-local path would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kgspark-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    # an eager checkpoint works every row out once, so nothing needs to be kept beside it
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed stage table of the shared folder: for many rows, of which ``cut`` would write a larger copy.

    And for loops of joins: ``cut`` hands on an estimated size, the product of both sides, whose digits
    multiply every round until planning takes longer than the rows do.
    """
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names) or any(x in df.schema.simpleString() for x in ("void", "interval")):
        return cut(df)  # what Parquet does not hold
    path = scratch_path(df.sparkSession, "stage")
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes in here take their shuffle files away at their end; else these lie about until the driver collects garbage."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def discard(*tables: DataFrame) -> None:
    """Delete stage tables made by ``stored`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.rpartition("/")[2].startswith("stage-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a stage table inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Give heavy row work at least one partition per core; a table of many files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
