"""How far generated values are from the truth."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.operators import ordered

# Samples whose orders are counted one by one; the work grows with the product of both sizes.
EXACT_SAMPLE = 10_000


def paired(truth: DataFrame, generated: DataFrame, key: str, truth_col: str, generated_col: str) -> DataFrame:
    """x (truth) and y (generated) by key."""
    return truth.select(key, F.col(truth_col).cast("double").alias("x")).join(
        generated.select(key, F.col(generated_col).cast("double").alias("y")), key
    )


def rmse(pairs: DataFrame) -> DataFrame:
    d = F.col("x") - F.col("y")
    return pairs.agg(F.sqrt(F.avg(d * d)).alias("rmse"))


def ks_statistic(pairs: DataFrame, **limits) -> DataFrame:
    """ks, n1, n2 of the two samples x and y.

    Equal values are counted first; the running counts then step once per
    value, as ties ask for.
    """
    samples = pairs.select(F.inline(F.array(
        F.struct(F.col("x").alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")),
        F.struct(F.col("y").alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")),
    ))).filter(F.col("v").isNotNull())
    counts = samples.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    run = ordered.running_sums(counts, {"ca": F.col("a"), "cb": F.col("b")}, [], ["v"], **limits)
    total = counts.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    # one row
    return run.join(F.broadcast(total)).agg(
        F.max(F.abs(F.col("ca") / F.col("n1") - F.col("cb") / F.col("n2"))).alias("ks"),
        F.first("n1").alias("n1"),
        F.first("n2").alias("n2"),
    )


def ks_pvalue(ks: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic p-value of the two-sided test."""
    lam = F.sqrt(n1 * n2 / (n1 + n2)) * ks
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    # near zero the alternating series does not settle; the value is 1 there
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))


def _inside_share(reach: int, n1: int, n2: int) -> float:
    """Share of the orders of two samples whose running shares never differ by ``reach / (n1 * n2)`` or more.

    An order is a path over a grid of n1 by n2 steps. In each row the places within reach are next to
    each other, and the paths to a place are those to the places before it in the row above or this
    one: a running sum. Rows are scaled as they come, so that the last value is the share itself.
    """
    columns = np.arange(n2 + 1)
    paths = (columns * n1 < reach).astype(float)
    for row in range(1, n1 + 1):
        within = np.abs(row * n2 - columns * n1) < reach
        paths = np.where(within, np.cumsum(np.where(within, paths, 0.0) * (row / (row + n2))), 0.0)
    return float(paths[-1])


def _exact(ks: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    known: dict[tuple, float | None] = {}

    def one(d: float, a: float, b: float) -> float | None:
        if not (a >= 1 and b >= 1) or d != d:
            return None
        key = (round(d * a * b), *sorted((int(a), int(b))))
        if key not in known:
            known[key] = min(1.0, max(0.0, 1.0 - _inside_share(*key)))
        return known[key]

    return pd.Series([one(d, a, b) for d, a, b in zip(ks, n1, n2)], dtype=float)


def ks_pvalue_exact(ks: Column, n1: Column, n2: Column, upto: int = EXACT_SAMPLE) -> Column:
    """Exact p-value of the two-sided test for samples of up to ``upto`` values, the asymptotic one beyond.

    The chance, over all orders of two samples without ties, that their running shares differ by
    ``ks`` or more somewhere. Null without a value in either sample.
    """
    small = F.greatest(n1, n2) <= upto
    size = lambda n: F.when(small, n).cast("double")
    exact = F.pandas_udf(_exact, "double")
    return F.when(small, exact(ks.cast("double"), size(n1), size(n2))).otherwise(ks_pvalue(ks, n1, n2))


def js_distance(pairs: DataFrame) -> DataFrame:
    """Jensen–Shannon distance (base 2) of the two value vectors, scaled to sum 1; null if one sums to 0."""
    total = pairs.agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    scaled = pairs.join(F.broadcast(total)).select(  # one row
        F.try_divide("x", "sx").alias("p"), F.try_divide("y", "sy").alias("q")
    )
    m = (F.col("p") + F.col("q")) / 2

    def part(c):
        return F.when(c > 0, c * F.log2(F.try_divide(c, m))).when(c.isNotNull(), 0.0)

    summed = F.sum(part(F.col("p")) + part(F.col("q"))) / 2
    # greatest() would turn a null into 0
    return scaled.agg(F.when(summed.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), summed))).alias("js"))


def metric_rows(pairs: DataFrame, feature: str, exact_upto: int = 0, **limits) -> DataFrame:
    """feature, metric, value: all measures of one feature; p-values are exact for samples of up to ``exact_upto``."""
    one = rmse(pairs).join(F.broadcast(ks_statistic(pairs, **limits))).join(F.broadcast(js_distance(pairs)))  # one row each
    sizes = F.col("ks"), F.col("n1"), F.col("n2")
    wide = one.select("rmse", "ks", (ks_pvalue_exact(*sizes, exact_upto) if exact_upto else ks_pvalue(*sizes)).alias("p_value"), "js")
    return wide.select(F.lit(feature).alias("feature"), "*").unpivot(
        ["feature"], ["rmse", "ks", "p_value", "js"], "metric", "value"
    )


def metrics_table(features: dict[str, DataFrame], **limits) -> DataFrame:
    rows = [metric_rows(p, f, **limits) for f, p in features.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin (0-based), low, high, n: equal width bins, the last one closed at the top; empty bins have n 0.

    A constant column gets bins over one unit around its value. Without a value there are no bins.
    """
    c = F.col(column).cast("double")
    ends = df.agg(F.min(c).alias("least"), F.max(c).alias("most")).filter("least IS NOT NULL")
    flat = F.col("least") == F.col("most")
    ends = ends.select(
        F.when(flat, F.col("least") - 0.5).otherwise(F.col("least")).alias("lo"),
        (F.when(flat, F.lit(1.0)).otherwise(F.col("most") - F.col("least")) / bins).alias("w"),
    )
    placed = df.filter(c.isNotNull()).select(c.alias("__x")).join(F.broadcast(ends)).select(  # one row
        F.least(F.floor((F.col("__x") - F.col("lo")) / F.col("w")).cast("int"), F.lit(bins - 1)).alias("bin")
    )
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    all_bins = ends.select("lo", "w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return all_bins.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("w")).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def density_grid(df: DataFrame, column: str, points: int = 50) -> DataFrame:
    """grid_no, x, density: Gaussian kernel estimate with Scott's bandwidth.

    All grid sums are taken in one pass over the distinct values; no row is
    repeated per grid point. Fewer than two different values have no density:
    no rows.
    """
    c = F.col(column).cast("double")
    s = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n"), F.stddev_samp(c).alias("sd")).first()
    if not s["sd"]:
        return df.sparkSession.createDataFrame([], "grid_no int, x double, density double")
    step = (s["hi"] - s["lo"]) / (points - 1)
    h = s["sd"] * s["n"] ** (-0.2)
    grid = [s["lo"] + i * step for i in range(points)]
    counts = df.filter(c.isNotNull()).groupBy(c.alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    sums = counts.agg(
        F.array(*[F.sum(F.col("__n") * F.exp(-0.5 * F.pow((F.col("__x") - g) / h, F.lit(2.0)))) for g in grid]).alias("s")
    )
    scale = s["n"] * h * math.sqrt(2 * math.pi)
    return sums.select(F.posexplode("s").alias("grid_no", "d")).select(
        "grid_no", (F.lit(s["lo"]) + F.col("grid_no") * step).alias("x"), (F.col("d") / scale).alias("density")
    )
