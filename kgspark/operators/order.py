"""Sorting, top-k and seeded order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark import config
from kgspark.operators import ordered


def directions(orders: Sequence[tuple[str, str]]) -> list[Column]:
    """Sort keys from (column, "asc" | "desc"), nulls last in both directions."""
    return [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in orders]


def order_by(df: DataFrame, orders: Sequence[tuple[str, str]]) -> DataFrame:
    return df.orderBy(*directions(orders))


def numbered(df: DataFrame, orders: Sequence[tuple[str, str]], to: str, **limits) -> DataFrame:
    """Global 1-based position under a total order."""
    return ordered.row_numbers(df, to, [], directions(orders), **limits)


def top_k(df: DataFrame, orders: Sequence[tuple[str, str]], k: int) -> DataFrame:
    """The first k rows: each task keeps k, only those meet."""
    return df.orderBy(*directions(orders)).limit(k)


def top_k_per_group(df: DataFrame, keys: Sequence[str], orders: Sequence[tuple[str, str]], k: int, to: str) -> DataFrame:
    """First k rows of each group; Spark cuts every partition to k per group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*directions(orders))
    return df.withColumn(to, F.row_number().over(w)).filter(F.col(to) <= k)


def seeded_order(df: DataFrame, key: str, seed: int = config.SHUFFLE_SEED, to: str = "shuffle_key") -> DataFrame:
    """A sort key that looks random but is the same in every run."""
    return df.withColumn(to, F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))))


def distinct_levels(df: DataFrame, column: str = "level") -> DataFrame:
    return df.filter(F.col(column).isNotNull() & (F.col(column) != -1)).select(column).distinct()


def levels(df: DataFrame, column: str = "level") -> list[int]:
    """Levels in use, deepest first. A hierarchy has a handful of them."""
    return [r[0] for r in distinct_levels(df, column).orderBy(F.col(column).desc()).collect()]
