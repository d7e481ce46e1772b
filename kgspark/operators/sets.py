"""Set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators import order


def union(*tables: DataFrame) -> DataFrame:
    """All rows by column name, columns a table lacks as null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def dedupe(df: DataFrame, columns: Sequence[str], keep: Sequence[tuple[str, str]]) -> DataFrame:
    """First row per key under the order ``keep``."""
    return order.top_k_per_group(df, columns, keep, 1, "__rn").drop("__rn")


def merge_shards(shards: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of partial results; an earlier shard wins, later ones fill the gaps."""
    marked = [s.withColumn("__shard", F.lit(i)) for i, s in enumerate(shards)]
    return dedupe(union(*marked), [key], [("__shard", "asc")]).drop("__shard")
