"""Small helpers shared by the operators: normalisation, hashing and stage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.session import scratch_path, spread, tune

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# ASCII white space as the contracts list it: \x20 and \x09 to \x0D
BLANKS = " \t\n\x0b\x0c\r"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; an all-ASCII value takes the faster ``lower``."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


# Rows of whole texts that go to a Python worker at once.
TEXT_ROWS = 1_000


def texts_for_python(df: DataFrame) -> DataFrame:
    """``df`` with enough partitions, and small Arrow batches: a worker holds few whole texts at once."""
    spark = tune(df.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return spread(df)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder, read by Spark so that any store works."""
    return tune(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back, so that lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_plain(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """Mark a staged narrow table for broadcast only after its rows were counted; a larger one is shuffled."""
    return F.broadcast(df) if df.count() <= most_rows else df
