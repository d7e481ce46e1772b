"""Aggregate verb: a list of {column, operation, to, separator, order} items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.operators import ordered

_SIMPLE = {
    "count": lambda c: F.count(c),
    "valid": lambda c: F.count(c),
    "invalid": lambda c: F.count_if(c.isNull()),
    "distinct": lambda c: F.count_distinct(c),
    "max": lambda c: F.max(c),
    "min": lambda c: F.min(c),
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    # a null value makes the product null
    "product": lambda c: F.when(F.count_if(c.isNull()) == 0, F.product(c)),
    "mean": lambda c: F.avg(c),
    "stdev": lambda c: F.stddev_samp(c),
    "stdevp": lambda c: F.stddev_pop(c),
    "variance": lambda c: F.var_samp(c),
}
# Operations that need the values of a group and so a shape of their own.
_SHAPED = ("median", "mode", "array_agg", "array_agg_distinct", "string_concat")


def aggregate(df: DataFrame, specs: Sequence[dict], groupby: Sequence[str] | None = None) -> DataFrame:
    """Grouped or global aggregates. Rows with a null group key are left out.

    Array and text results of long groups go on in further rows, told apart by
    ``page``; ask for one such item at a time.
    """
    keys = list(groupby or [])
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    simple = [s for s in specs if s["operation"] not in _SHAPED]
    shaped = [s for s in specs if s["operation"] in _SHAPED]
    parts = []
    if simple:
        parts.append(df.groupBy(*keys).agg(*[_expression(s).alias(s["to"]) for s in simple]))
    elif keys and shaped[0]["operation"] in ("median", "mode"):
        # a group whose values are all null has neither, but stays
        parts.append(df.select(*keys).distinct())
    parts += [_shaped(df, s, keys) for s in shaped]
    out = parts[0]
    for p in parts[1:]:
        if "page" in p.columns or "page" in out.columns:
            raise ValueError("ask for array and text results one at a time")
        out = out.join(p, keys, "left") if keys else out.join(F.broadcast(p))  # one row each
    return out


def _expression(spec: dict) -> Column:
    op, c = spec["operation"], F.col(spec["column"])
    if op == "any":
        if spec.get("order"):
            position = F.struct(*[F.col(o) for o in spec["order"]])
            return F.min_by(c, F.when(c.isNotNull(), position))
        return F.first(c, ignorenulls=True)
    if op not in _SIMPLE:
        raise ValueError(f"unknown aggregate: {op}")
    return _SIMPLE[op](c)


def _shaped(df: DataFrame, spec: dict, keys: list[str]) -> DataFrame:
    op, column, to = spec["operation"], spec["column"], spec["to"]
    c = F.col(column)
    if op == "median":
        return ordered.quantiles(df, column, {to: 0.5}, keys)
    if op == "mode":
        counts = df.filter(c.isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__n"))
        top = counts.groupBy(*keys).agg(F.max("__n").alias("__top"))
        best = counts.join(top, keys) if keys else counts.join(F.broadcast(top))  # one row
        return best.filter(F.col("__n") == F.col("__top")).groupBy(*keys).agg(F.min(column).alias(to))
    order = list(spec.get("order") or [column])
    if op == "array_agg_distinct":
        first = df.groupBy(*keys, column).agg(
            F.min(F.struct(*order)).alias("__pos")
        )
        return ordered.collect_pages(first, c, to, keys, ["__pos", column])
    pages = ordered.collect_pages(df, c, to, keys, order)
    if op == "string_concat":
        return pages.withColumn(to, F.array_join(F.transform(to, lambda x: x.cast("string")), spec.get("separator", ",")))
    return pages


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, spread, extremes and quartiles, one row."""
    c = F.col(column)
    base = df.agg(
        F.count(c).alias("n"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    )
    parts = ordered.quantiles(df, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return base.join(F.broadcast(parts))  # one row each


def outlier_count(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    c = F.col(column)
    return df.agg(
        F.count_if(c < low).alias("below"),
        F.count_if(c > high).alias("above"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    )
