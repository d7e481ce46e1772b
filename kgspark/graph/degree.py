"""Degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node_degree(edges: DataFrame) -> DataFrame:
    """title, degree; a self-loop counts twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("title"))
    return ends.groupBy("title").agg(F.count(F.lit(1)).alias("degree"))


def edge_combined_degree(edges: DataFrame, degrees: DataFrame, to: str = "rank") -> DataFrame:
    """Adds source_degree, target_degree and their sum; a missing node counts 0."""
    if to in edges.columns:
        return edges
    s = degrees.select(F.col("title").alias("source"), F.col("degree").alias("source_degree"))
    t = degrees.select(F.col("title").alias("target"), F.col("degree").alias("target_degree"))
    zero = F.lit(0).cast("long")
    joined = edges.join(s, "source", "left").join(t, "target", "left")
    return joined.withColumns(
        {"source_degree": F.coalesce("source_degree", zero), "target_degree": F.coalesce("target_degree", zero)}
    ).withColumn(to, F.col("source_degree") + F.col("target_degree"))


def k_degree_subgraph(edges: DataFrame, k: int = 2) -> DataFrame:
    """Edges between nodes of degree k or more."""
    strong = node_degree(edges).filter(F.col("degree") >= k).select("title")
    first = edges.join(strong, F.col("source") == F.col("title"), "left_semi")
    return first.join(strong, F.col("target") == F.col("title"), "left_semi")
