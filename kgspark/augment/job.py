"""The whole augmentation of a table, with or without retrieved texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.augment import rows
from kgspark.model.apply import Chat, model_map

RETRIEVED = "\n\n## Retrieved texts\n"


def augment_table(
    df: DataFrame,
    key: str,
    report: Column,
    spec: dict[str, str],
    ranges: dict[str, str],
    fn: Chat,
    ask_missing: Callable[[list[str]], list[str]] | None = None,
    context: DataFrame | None = None,
    prefix: str = "Augmented_",
) -> tuple[DataFrame, DataFrame]:
    """(wide rows, rejects(key, reason)): prompt, answer, check, second ask, typed columns.

    ``context(key, context)`` are retrieved texts; they go under the prompt of
    their row. Without it, or for a row without texts, the prompt is the row's
    own report only. The wide rows keep the source columns, the prompt as
    ``augmenting_query`` and the raw answer as ``augmenting_output``.
    ``ask_missing`` gets the prompt and the names of the missing features.
    """
    asked = rows.row_prompts(df, report, spec, ranges)
    if context is not None:
        told = asked.join(context.select(key, F.col("context").alias("__context")), key, "left")
        asked = told.withColumn("prompt", F.concat("prompt", F.coalesce(F.concat(F.lit(RETRIEVED), "__context"), F.lit("")))).drop("__context")
    asked = asked.withColumnRenamed("prompt", "augmenting_query")
    answers = model_map(asked, fn, "augmenting_query", asked.columns, "augmenting_output")
    read = rows.read_answer(answers, "augmenting_output")
    again = None
    if ask_missing is not None:

        def again(gaps: DataFrame) -> DataFrame:
            named = F.concat("augmenting_query", F.lit("\n\nMissing: "), F.array_join("missing", ", "))
            prompts = gaps.join(asked.select(key, "augmenting_query"), key).select(key, named.alias("prompt"))
            return rows.read_answer(model_map(prompts, ask_missing, "prompt", [key]))

    whole, rejects = rows.complete(read, key, list(spec), again)
    return rows.wide(whole, spec, prefix=prefix), rejects


def compare_variants(df: DataFrame, key: str, produced: dict[str, DataFrame]) -> DataFrame:
    """run, total, failed for each named variant, such as with and without retrieved texts."""
    out = None
    for name, made in produced.items():
        counts = rows.failure_counts(df, made, key, name)
        out = counts if out is None else out.unionByName(counts)
    return out
