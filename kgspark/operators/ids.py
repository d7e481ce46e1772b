"""Row ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.operators import ordered


def md5_of(columns: Sequence[str]) -> Column:
    """md5 over the columns' texts, kept apart so that ("a","bc") and ("ab","c") differ."""
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns]))


def gen_id(
    df: DataFrame, to: str, method: str = "md5_hash", hash: Sequence[str] = (), order: Sequence[str] = (), **limits
) -> DataFrame:
    if method == "md5_hash":
        if not hash:
            raise ValueError("md5_hash needs the columns to hash")
        return df.withColumn(to, md5_of(hash))
    if method == "increment":
        return ordered.row_numbers(df, to, [], order, **limits)
    raise ValueError(f"unknown id method: {method}")
