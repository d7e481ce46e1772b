"""Global search: reports in scope, weights, batches, map and reduce steps.

Questions are a table, so any number of them is answered in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark import config
from kgspark.functions import jsontext
from kgspark.functions import tokens as tok
from kgspark.model.apply import Chat, model_map
from kgspark.model.prompts import render
from kgspark.operators import filters, order, sets
from kgspark.operators.joins import join
from kgspark.session import cut
from kgspark.text import budget

# Answer when no point is left, and the columns of a report table.
NO_DATA_ANSWER = "I am sorry but I am unable to answer this question given the provided data."
WEIGHT = "occurrence weight"

MAP_TEMPLATE = "Use the tables below to answer.\n\n{context_data}\n\nQuestion: {question}"
REDUCE_TEMPLATE = "Join the analysts' points into one answer.\n\n{report_data}\n\nQuestion: {question}"


def reports_in_scope(reports: DataFrame, nodes: DataFrame, level: int = config.COMMUNITY_LEVEL) -> DataFrame:
    """Reports of the deepest community each entity has at or above ``level``."""
    scoped = filters.under_level(nodes, level).filter(F.col("community").isNotNull())
    deepest = scoped.groupBy("title").agg(F.max(F.struct("level", "community")).alias("__d"))
    wanted = deepest.select("__d.level", "__d.community")
    # an id may name communities of several levels, so the level is part of the key
    return filters.under_level(reports, level).join(wanted, ["level", "community"], "left_semi")


def entities_in_scope(nodes: DataFrame, entities: DataFrame, level: int = config.COMMUNITY_LEVEL) -> DataFrame:
    """Entities at or above ``level`` with their deepest community and rank (degree)."""
    scoped = filters.under_level(nodes, level)
    best = scoped.groupBy(F.col("title").alias("name"), F.col("degree").alias("rank")).agg(
        F.max_by("community", F.struct("level", "community")).alias("community")
    )
    return sets.dedupe(best.join(entities, "name"), ["name"], [("rank", "desc")])


def community_weights(links: DataFrame, normalize: bool = True) -> DataFrame:
    """community, weight: distinct text units of its entities, relative to the largest.

    ``links`` holds community, text_unit_id.
    """
    counted = links.groupBy("community").agg(F.count_distinct("text_unit_id").alias("weight"))
    if not normalize:
        return counted
    top = counted.agg(F.max("weight").alias("__max"))
    # one row
    return counted.join(F.broadcast(top)).select("community", (F.col("weight") / F.col("__max")).alias("weight"))


def select_reports(reports: DataFrame, min_rank: float = 0, seed: int | None = config.SHUFFLE_SEED, key: str = "id") -> DataFrame:
    """Reports with a rank, at least ``min_rank``; ``shuffle_key`` gives the order."""
    ranked = reports.filter(F.col("rank").isNotNull() & (F.col("rank") != 0) & (F.col("rank") >= min_rank))
    return order.seeded_order(ranked, key, seed) if seed is not None else ranked.withColumn("shuffle_key", F.col(key).cast("string"))


def report_batches(
    reports: DataFrame,
    keys: list[str],
    content: str = "content",
    max_tokens: int = config.SEARCH_BATCH_TOKENS,
    delimiter: str = "|",
    name: str = "Reports",
    **limits,
) -> DataFrame:
    """keys, batch, n_reports, context: tables of reports within the token budget.

    ``reports`` holds ``keys``, shuffle_key, id, title, weight, rank and the
    content. Reports are packed in shuffle order; inside a batch the heaviest
    and best ranked come first. Every report is in exactly one batch, and every
    batch has its head.
    """
    head = f"-----{name}-----\n" + delimiter.join(["id", "title", WEIGHT, "content", "rank"]) + "\n"
    head_tokens = len(head.split())
    fields = [F.col("id"), F.col("title"), F.col("weight"), F.col(content), F.col("rank")]
    line = F.concat_ws(delimiter, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
    lined = reports.select(*keys, "shuffle_key", "weight", "rank", F.col("id").cast("string").alias("id"), line.alias("__line"))
    lined = lined.withColumn("__n", (tok.count(F.concat("__line", F.lit("\n")))).cast("long"))
    # ids and sizes alone are packed; the lines join them afterwards
    lined = cut(lined.withColumn("__row", F.monotonically_increasing_id()))
    placed = budget.pack(lined.select(*keys, "shuffle_key", "id", "__row", "__n"), keys, ["shuffle_key", "id"], "__n", max_tokens, "batch", head_tokens, **limits)
    packed = lined.join(placed.select("__row", "batch"), "__row")
    rows = F.sort_array(
        F.collect_list(F.struct((-F.col("weight")).alias("w"), (-F.col("rank")).alias("r"), F.col("id"), F.col("__line").alias("line")))
    )
    return packed.groupBy(*keys, "batch").agg(rows.alias("__rows")).select(
        *keys,
        "batch",
        F.size("__rows").alias("n_reports"),
        F.concat(F.lit(head), F.array_join(F.transform("__rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("context"),
    )


POINTS_SCHEMA = "points array<struct<description:string,score:string>>"


def map_points(answers: DataFrame, keys: list[str], output: str = "output") -> DataFrame:
    """keys, point, answer, score from answers; an unreadable one gives an empty point of score 0."""
    parsed = jsontext.parse(jsontext.object_substring(F.col(output)), POINTS_SCHEMA)["points"]
    empty = F.array(F.struct(F.lit("").alias("description"), F.lit("0").alias("score")))
    rows = answers.select(*keys, F.posexplode(F.coalesce(parsed, empty)).alias("point", "__p"))
    return rows.select(
        *keys,
        "point",
        F.coalesce(F.col("__p.description"), F.lit("")).alias("answer"),
        F.coalesce(F.col("__p.score").try_cast("double").cast("int"), F.lit(0)).alias("score"),
    )


def reduce_points(
    points: DataFrame, keys: list[str], max_tokens: int = config.REDUCE_TOKENS, **limits
) -> DataFrame:
    """keys, report_data, n_points: the best points that fit, as one text.

    ``points`` holds ``keys``, analyst (0-based), point, answer, score.
    """
    text = F.concat(
        F.lit("----Analyst "),
        (F.col("analyst") + 1).cast("string"),
        F.lit("----\nImportance Score: "),
        F.col("score").cast("string"),
        F.lit("\n"),
        F.col("answer"),
    )
    useful = points.filter(F.col("score") > 0).withColumn("__text", text)
    sized = useful.withColumn("__n", tok.count(F.col("__text")).cast("long"))
    by = [F.col("score").desc(), F.col("analyst").asc(), F.col("point").asc()]
    kept = budget.prefix(sized, keys, by, F.col("__n"), max_tokens, 0, "__sum", **limits)
    rows = F.sort_array(
        F.collect_list(F.struct((-F.col("score")).alias("s"), "analyst", "point", F.col("__text").alias("text")))
    )
    return kept.groupBy(*keys).agg(rows.alias("__r")).select(
        *keys, F.array_join(F.transform("__r", lambda r: r["text"]), "\n\n").alias("report_data"), F.size("__r").alias("n_points")
    )


def global_search(
    questions: DataFrame,
    reports: DataFrame,
    fn: Chat,
    reduce_fn: Chat | None = None,
    max_tokens: int = config.SEARCH_BATCH_TOKENS,
    reduce_tokens: int = config.REDUCE_TOKENS,
    conversation: DataFrame | None = None,
) -> DataFrame:
    """question_id, question, response, model_calls, prompt_tokens.

    ``questions`` holds question_id, question and, with ``conversation``
    (conv_id, context), conv_id. The batches do not depend on the question, so
    they are packed once and paired with the questions by the batch table,
    which is as short as the reports are few.
    """
    batches = report_batches(reports, [], max_tokens=max_tokens).select(F.col("batch").alias("analyst"), "context")
    asked = questions
    if conversation is not None:
        asked = asked.join(conversation.select("conv_id", F.col("context").alias("__conv")), "conv_id", "left")
        history = F.concat(F.coalesce("__conv", F.lit("")), F.lit("\n\n"))
    else:
        history = F.lit("")
    pairs = join(asked.withColumn("__h", history), batches, strategy="cross").withColumn(
        "prompt", render(MAP_TEMPLATE, {"context_data": F.concat("__h", "context"), "question": F.col("question")})
    )
    pairs = pairs.withColumn("prompt_tokens", tok.count(F.col("prompt")).cast("long"))
    keys = ["question_id", "question", "analyst", "prompt_tokens"]
    answers = cut(model_map(pairs, fn, "prompt", keys))
    points = map_points(answers, keys)
    reduced = reduce_points(points, ["question_id"], reduce_tokens)
    spent = points.filter("point = 0").groupBy("question_id").agg(
        F.count(F.lit(1)).alias("map_calls"), F.sum("prompt_tokens").alias("map_tokens")
    )
    joined = questions.join(spent, "question_id", "left").join(reduced, "question_id", "left").withColumn(
        "prompt", render(REDUCE_TEMPLATE, {"report_data": F.col("report_data"), "question": F.col("question")})
    )
    final = model_map(
        joined.filter("report_data IS NOT NULL"), reduce_fn or fn, "prompt", ["question_id", "prompt"], "response"
    ).withColumn("__t", tok.count(F.col("prompt")).cast("long")).drop("prompt")
    zero = F.lit(0).cast("long")
    return joined.join(final, "question_id", "left").select(
        "question_id",
        "question",
        F.coalesce("response", F.lit(NO_DATA_ANSWER)).alias("response"),
        (F.coalesce("map_calls", zero) + F.col("response").isNotNull().cast("long")).alias("model_calls"),
        (F.coalesce("map_tokens", zero) + F.coalesce("__t", zero)).alias("prompt_tokens"),
    )
