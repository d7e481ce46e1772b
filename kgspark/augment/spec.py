"""Feature specifications: features with a type, and their ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions import jsontext

# The two feature types.
BOOLEAN, NUMERICAL = "boolean", "numerical"


def keyword_spec(answers: DataFrame, keep: list[str], output: str) -> DataFrame:
    """keep, feature, dtype from JSON answers; types other than the two are left out."""
    spec = jsontext.latest_keys(jsontext.repair(F.col(output)))
    rows = answers.select(*keep, F.explode(spec).alias("feature", "dtype"))
    return rows.withColumn("dtype", F.lower(F.trim("dtype"))).filter(F.col("dtype").isin(BOOLEAN, NUMERICAL))


def normal_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def merge_specs(specs: DataFrame) -> DataFrame:
    """One type per normalised feature: the most frequent, the first by name on a tie."""
    votes = specs.groupBy(normal_name(F.col("feature")).alias("feature"), "dtype").agg(F.count(F.lit(1)).alias("n"))
    top = votes.groupBy("feature").agg(F.max("n").alias("top"), F.sum("n").alias("mentions"))
    return (
        votes.join(top, "feature").filter("n = top").groupBy("feature").agg(F.min("dtype").alias("dtype"), F.first("mentions").alias("mentions"))
    )


def existing_features(specs: DataFrame, columns: list[str]) -> DataFrame:
    """Features that the table has already, by normalised name."""
    names = [" ".join(c.lower().split()) for c in columns]
    return specs.filter(normal_name(F.col("feature")).isin(names))


def feature_range_kinds(specs: DataFrame, ranges: DataFrame, kinds: Sequence[str] = ("healthy", "possible")) -> DataFrame:
    """feature, dtype, and <kind>_lo, <kind>_hi of the numerical features.

    ``ranges`` holds feature, kind, range_text; of several texts for one feature and kind the widest
    bounds count. A kind without a readable range is null. Values within the first kind's range are
    usual, those beyond the last kind's cannot be.
    """
    lo, hi = jsontext.parse_range(F.col("range_text"))
    bounds = [
        side(F.when(F.col("kind") == kind, c)).alias(f"{kind}_{name}") for kind in kinds for side, c, name in ((F.min, lo, "lo"), (F.max, hi, "hi"))
    ]
    return specs.filter(F.col("dtype") == NUMERICAL).join(ranges.groupBy("feature").agg(*bounds), "feature", "left")


def feature_ranges(specs: DataFrame, ranges: DataFrame) -> DataFrame:
    """feature, dtype, lo, hi of the numerical features; ``ranges`` holds feature, range_text."""
    lo, hi = jsontext.parse_range(F.col("range_text"))
    parsed = ranges.select("feature", lo.alias("lo"), hi.alias("hi"))
    return specs.filter(F.col("dtype") == NUMERICAL).join(parsed, "feature", "left")
