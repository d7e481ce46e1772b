"""Node titles as 64-bit numbers, so that iterations move no text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.session import stored


def dictionary(titles: DataFrame) -> DataFrame:
    """title, id for each distinct title of a one-column table; ids are in the order of the titles.

    The titles are range-partitioned, sorted and written down once, so a smallest id stands for a
    smallest title.
    """
    named = titles.toDF("title").distinct().orderBy("title")
    return stored(named.withColumn("id", F.monotonically_increasing_id()))


def encoded(edges: DataFrame, ids: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """``edges`` with numbers in place of both titles; edges of unlisted titles are left out."""
    for column in (source, target):
        pair = ids.select(F.col("title").alias(column), F.col("id").alias("__id"))
        edges = edges.join(pair, column).drop(column).withColumnRenamed("__id", column)
    return edges
