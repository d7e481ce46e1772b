"""Row-wise augmentation: prompts, answer checks, wide output, restart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.augment.spec import BOOLEAN, NUMERICAL
from kgspark.functions import jsontext
from kgspark.model.prompts import render
from kgspark.session import cut

PROMPT = "## Report\n{report}\n\n## Data types\n{spec}\n\n## Ranges\n{ranges}\n\nGive a value for every feature as one JSON object."


def row_prompts(df: DataFrame, report: Column, spec: dict[str, str], ranges: dict[str, str], template: str = PROMPT) -> DataFrame:
    """Adds ``prompt``: the row's report with the wanted features and their ranges."""

    def object_text(d):
        pairs = [x for k, v in d.items() for x in (F.lit(k), F.lit(v))]
        return F.to_json(F.create_map(*pairs)) if pairs else F.lit("{}")

    return df.withColumn(
        "prompt", render(template, {"report": report, "spec": object_text(spec), "ranges": object_text(ranges)})
    )


def _names(features: Sequence[str]) -> Column:
    return F.array(*[F.lit(f) for f in features])


def missing_keys(m: Column, features: Sequence[str]) -> Column:
    return F.array_except(_names(features), F.map_keys(m))


def extra_keys(m: Column, features: Sequence[str]) -> Column:
    return F.array_except(F.map_keys(m), _names(features))


def only_known(m: Column, features: Sequence[str]) -> Column:
    return jsontext.pick_keys(m, _names(features))


def update(m: Column, newer: Column) -> Column:
    """Both maps in one; a value of the newer one wins."""
    return F.map_concat(F.map_filter(m, lambda k, v: ~F.coalesce(F.map_contains_key(newer, k), F.lit(False))), newer)


def has_placeholder(m: Column) -> Column:
    """A value is still the name of its type."""
    return F.exists(F.map_values(m), lambda v: F.lower(v).isin(BOOLEAN, NUMERICAL))


def read_answer(df: DataFrame, output: str = "output", to: str = "values") -> DataFrame:
    """Adds the key → value map of the first balanced object, or of the last one
    when the first only repeats the types; null when neither is of use."""
    found = jsontext.balanced(F.col(output))
    first, last = (jsontext.latest_keys(found[name]) for name in ("first_object", "last_object"))
    both = df.withColumns({"__first": first, "__last": last})
    usable = lambda m: m.isNotNull() & ~has_placeholder(m)
    picked = F.when(usable(F.col("__first")), F.col("__first")).when(usable(F.col("__last")), F.col("__last"))
    return both.withColumn(to, picked).drop("__first", "__last")


def complete(
    answers: DataFrame, key: str, features: Sequence[str], ask_again=None, values: str = "values"
) -> tuple[DataFrame, DataFrame]:
    """(rows with every feature, rejects(key, reason)).

    Unknown keys are taken out. Rows with missing keys are asked about once
    more through ``ask_again(DataFrame(key, missing)) -> DataFrame(key, values)``,
    whose values win.
    """
    known = answers.withColumn(values, only_known(F.col(values), features))
    state = cut(known.withColumn("__missing", missing_keys(F.col(values), features)))
    if ask_again is not None:
        gaps = state.filter(F.col(values).isNotNull() & (F.size("__missing") > 0)).select(key, F.col("__missing").alias("missing"))
        more = ask_again(gaps).select(key, only_known(F.col(values), features).alias("__more"))
        state = state.join(more, key, "left").withColumn(
            values, F.when(F.col("__more").isNotNull(), update(F.col(values), F.col("__more"))).otherwise(F.col(values))
        ).drop("__more")
        state = cut(state.withColumn("__missing", missing_keys(F.col(values), features)))
    good = F.col(values).isNotNull() & (F.size("__missing") == 0)
    reason = F.when(F.col(values).isNull(), F.lit("no object")).otherwise(F.concat(F.lit("missing: "), F.array_join("__missing", ", ")))
    whole = state.filter(good).drop("__missing")
    rejects = state.filter(~F.coalesce(good, F.lit(False))).select(key, reason.alias("reason"))
    return whole, rejects


def wide(df: DataFrame, spec: dict[str, str], values: str = "values", prefix: str = "Augmented_") -> DataFrame:
    """Source columns plus one typed column per feature; a wrong value gives null."""
    columns = [
        jsontext.typed(F.try_element_at(F.col(values), F.lit(f)), dtype).alias(f"{prefix}{f}") for f, dtype in spec.items()
    ]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != values], *columns)


def rename_keys(m: Column, names: dict[str, str]) -> Column:
    """Map with some keys renamed."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.transform_keys(m, lambda k, v: F.coalesce(F.try_element_at(pairs, k), k))


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that a former run has not written yet."""
    return rows.join(done.select(key), key, "left_anti")


def failure_counts(rows: DataFrame, produced: DataFrame, key: str, run: str) -> DataFrame:
    """run, total, failed."""
    found = produced.select(key, F.lit(1).alias("__ok"))
    return rows.select(key).join(found, key, "left").agg(
        F.lit(run).alias("run"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("__ok").isNull()).alias("failed")
    )
