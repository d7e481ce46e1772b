"""Row predicates. A comparison with an unknown side drops the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {
    "equals": lambda c, v: c == v,
    "=": lambda c, v: c == v,
    "is not equal": lambda c, v: c != v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "contains": lambda c, v: F.contains(c, v),
    "starts with": lambda c, v: F.startswith(c, v),
    "ends with": lambda c, v: F.endswith(c, v),
    "regex": lambda c, v: F.rlike(c, v),
}
_UNARY = {
    "is empty": lambda c: c.isNull(),
    "is not empty": lambda c: c.isNotNull(),
    "is true": lambda c: c,
    "is false": lambda c: ~c,
}


def predicate(column: str, operator: str, value=None, strategy: str = "value") -> Column:
    """Condition on one column, against a literal or another column."""
    c = F.col(column)
    if operator in _UNARY:
        return _UNARY[operator](c)
    if operator not in _COMPARE:
        raise ValueError(f"unknown operator: {operator}")
    return _COMPARE[operator](c, F.col(value) if strategy == "column" else F.lit(value))


def filter_rows(df: DataFrame, column: str, operator: str, value=None, strategy: str = "value") -> DataFrame:
    return df.filter(predicate(column, operator, value, strategy))


def edges_to_nodes(edges: DataFrame, nodes: DataFrame, title: str = "title") -> DataFrame:
    """Edges whose two ends are both in the node set."""
    names = nodes.select(F.col(title).alias("__title")).distinct()
    first = edges.join(names, F.col("source") == F.col("__title"), "left_semi")
    return first.join(names, F.col("target") == F.col("__title"), "left_semi")


def claims_to_nodes(claims: DataFrame, nodes: DataFrame, subject: str, title: str) -> DataFrame:
    names = nodes.select(F.col(title).alias("__title"))
    return claims.join(names, F.col(subject) == F.col("__title"), "left_semi")


def under_level(df: DataFrame, level: int, column: str = "level") -> DataFrame:
    return df.filter(F.col(column) <= level)


def without_self_loops(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    return edges.filter(F.col(source) != F.col(target))


def in_any(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))
