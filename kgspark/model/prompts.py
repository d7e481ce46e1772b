"""Prompt templates filled from columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.operators import ordered

def render(template: str | Column, variables: dict[str, Column]) -> Column:
    """Put each variable in the place of its {name}."""
    base = F.lit(template) if isinstance(template, str) else template
    return reduce(
        lambda acc, kv: F.replace(acc, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))),
        variables.items(),
        base,
    )


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(system: Column | None, history: Column | None, user: Column) -> Column:
    """Message list: system text, earlier messages, the new question."""
    new = F.array(message("user", user))
    if history is not None:
        new = F.concat(history, new)
    return new if system is None else F.concat(F.array(message("system", system)), new)


def questions(topics: DataFrame, topic: str, templates: DataFrame, number: str, template: str) -> DataFrame:
    """One row per topic and template; ``templates`` holds the caller's texts with ``{topic}`` and their numbers.

    A job has a handful of templates, and any number of topics: the side with fewer bytes is
    broadcast by Spark if it is small, else both are dealt out.
    """
    listed = templates.select(F.col(number).cast("int").alias("question_no"), F.col(template).alias("__t"))
    return topics.crossJoin(listed).select(
        *topics.columns, "question_no", render(F.col("__t"), {"topic": F.col(topic)}).alias("question")
    )


def prior_knowledge(answers: DataFrame, topic: str, order: str, text: str, separator: str = "\n") -> DataFrame:
    """Answers of a topic as one text, in order."""
    pages = ordered.collect_pages(answers, F.col(text), "__texts", [topic], [order])
    return pages.select(topic, "page", F.array_join("__texts", separator).alias("prior_knowledge"))
