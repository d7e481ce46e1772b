"""Agreement between the features models rely on and expert scores.

Long tables: scores(feature, <score columns>), selected(feature_set, model,
feature), available(feature_set, feature).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.numbers import row_mean
from kgspark.operators import sets

# Score of a feature a model relies on, and of any other.
SELECTED, OTHER = 4, 1


def combine_scores(sheets: Sequence[DataFrame], feature: str, columns: Sequence[str]) -> DataFrame:
    """Mean per feature over all sheets; texts that are no numbers count as missing."""
    rows = sets.union(*sheets).select(feature, *[F.col(c).try_cast("double").alias(c) for c in columns])
    return rows.groupBy(feature).agg(*[F.avg(c).alias(c) for c in columns])


def harmonize(df: DataFrame, feature: str, synonyms: DataFrame) -> DataFrame:
    """Feature names through a synonyms(name, standard) table; unknown names stay."""
    known = synonyms.select(F.lower("name").alias("__n"), F.col("standard").alias("__s"))
    return df.join(known, F.lower(F.col(feature)) == F.col("__n"), "left").withColumn(
        feature, F.coalesce("__s", feature)
    ).drop("__n", "__s")


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums of values near zero (subtract a mean first); null when a side is constant."""
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    flat = 1e-12
    return F.when((vx > flat * n * sxx) & (vy > flat * n * syy), (n * sxy - sx * sy) / F.sqrt(vx * vy))


def agreement_corr(scores: DataFrame, selected: DataFrame, available: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature_set, model, corr_<column>: selected (4) or not (1) against the score.

    Over the features that are available and have a score in that column. The
    sums over all features are per feature set, the selected ones add to them,
    so features and models are never paired row by row. Scores are centred on
    their mean first, which leaves the correlation as it is and keeps the sums
    exact.
    """
    means = scores.agg(*[F.avg(c).alias(f"__mean_{c}") for c in columns])
    # one row
    centred = scores.join(F.broadcast(means)).select("feature", *[(F.col(c) - F.col(f"__mean_{c}")).alias(c) for c in columns])
    base = available.distinct().join(centred, "feature")
    sums = base.groupBy("feature_set").agg(
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.sum(c).alias(f"sx_{c}") for c in columns],
        *[F.sum(F.col(c) * F.col(c)).alias(f"sxx_{c}") for c in columns],
    )
    groups = selected.select("feature_set", "model").distinct()
    hits = selected.distinct().join(base, ["feature_set", "feature"]).groupBy("feature_set", "model").agg(
        *[F.count(c).alias(f"k_{c}") for c in columns], *[F.sum(c).alias(f"sel_{c}") for c in columns]
    )
    joined = groups.join(sums, "feature_set").join(hits, ["feature_set", "model"], "left")
    gain = SELECTED - OTHER

    def corr(c):
        n, k = F.col(f"n_{c}"), F.coalesce(f"k_{c}", F.lit(0))
        sx, sel = F.col(f"sx_{c}"), F.coalesce(f"sel_{c}", F.lit(0))
        # y counted from its lower value, so that it is 0 or ``gain``
        return pearson(n, sx, k * gain, F.col(f"sxx_{c}"), k * gain * gain, sel * gain).alias(f"corr_{c}")

    return joined.select("feature_set", "model", *[corr(c) for c in columns])


def alignment_ratio(scores: DataFrame, selected: DataFrame, columns: Sequence[str], threshold: float = 3) -> DataFrame:
    """feature_set, model, n_selected, n_important, n_aligned, ratio."""
    important = scores.filter(row_mean([F.col(c) for c in columns]) >= threshold).select("feature")
    total = important.agg(F.count(F.lit(1)).alias("n_important"))
    marked = selected.distinct().join(important.withColumn("__hit", F.lit(1)), "feature", "left")
    counted = marked.groupBy("feature_set", "model").agg(F.count(F.lit(1)).alias("n_selected"), F.count("__hit").alias("n_aligned"))
    # one row
    return counted.join(F.broadcast(total)).select(
        "feature_set",
        "model",
        "n_selected",
        "n_important",
        "n_aligned",
        F.coalesce(F.try_divide(F.col("n_aligned"), F.col("n_selected")), F.lit(0.0)).alias("ratio"),
    )


def shared_features(selected: DataFrame, left: str, right: str) -> DataFrame:
    """feature_set, feature: what both models selected."""
    of = lambda model: selected.filter(F.col("model") == model).select("feature_set", "feature")
    return of(left).intersect(of(right))


def corr_by_stratum(scores: DataFrame, selected: DataFrame, plausibility: str, relevance: str, threshold: float = 3) -> DataFrame:
    """model, stratum (high | low relevance), n, corr between the two scores."""
    used = selected.select("model", "feature").distinct().join(scores, "feature")
    x, y = F.col(plausibility), F.col(relevance)
    both = used.filter(x.isNotNull() & y.isNotNull()).withColumn("stratum", F.when(y >= threshold, "high").otherwise("low"))
    # Spark's own correlation is worked out around running means; it is NaN for a constant side
    return both.groupBy("model", "stratum").agg(F.count(F.lit(1)).alias("n"), F.nanvl(F.corr(x, y), F.lit(None)).alias("corr"))


def aligned_scores(scores: DataFrame, selected: DataFrame, columns: Sequence[str], threshold: float = 3) -> DataFrame:
    """feature_set, model, feature, score for selected features at or above the threshold."""
    mean = row_mean([F.col(c) for c in columns])
    rated = scores.select("feature", mean.alias("score")).filter(F.col("score") >= threshold)
    return selected.distinct().join(rated, "feature").select("feature_set", "model", "feature", "score")
