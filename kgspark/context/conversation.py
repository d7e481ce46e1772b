"""Conversations: roles, question-answer turns, context text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark import config
from kgspark.functions import strings
from kgspark.functions import tokens as tok
from kgspark.operators import order, ordered
from kgspark.text import budget

# The roles a turn may have.
ROLES = ("system", "user", "assistant")


def checked_roles(turns: DataFrame) -> DataFrame:
    """The turns; an unknown role stops the job."""
    known = F.col("role").isin(*ROLES)
    stop = F.raise_error(F.concat(F.lit("invalid role: "), F.coalesce("role", F.lit("null"))))
    return turns.withColumn("role", F.when(known, F.col("role")).otherwise(stop))


def qa_turns(turns: DataFrame, **limits) -> DataFrame:
    """conv_id, qa_id (1-based), question, answer (null without one).

    A user turn opens a pair; other turns up to the next one are its answers,
    turns before the first user turn belong to none.
    """
    opened = ordered.running_sums(turns, {"qa_id": (F.col("role") == "user").cast("long")}, ["conv_id"], ["turn"], **limits)
    inside = opened.filter(F.col("qa_id") > 0)
    texts = F.sort_array(F.collect_list(F.when(F.col("role") != "user", F.struct("turn", "text"))))
    grouped = inside.groupBy("conv_id", "qa_id").agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("question"), texts.alias("__a")
    )
    return grouped.select(
        "conv_id",
        "qa_id",
        "question",
        F.when(F.size("__a") > 0, F.array_join(F.transform("__a", lambda s: s["text"]), "\n")).alias("answer"),
    )


def last_user_turns(turns: DataFrame, n: int = 1) -> DataFrame:
    """The last n user turns of each conversation, newest first."""
    users = turns.filter(F.col("role") == "user")
    return order.top_k_per_group(users, ["conv_id"], [("turn", "desc")], n, "position")


def conversation_context(
    turns: DataFrame,
    user_turns_only: bool = True,
    max_qa_turns: int | None = config.CONVERSATION_TURNS,
    max_tokens: int = config.CONVERSATION_TOKENS,
    recency_bias: bool = True,
    delimiter: str = "|",
    name: str = "Conversation History",
) -> DataFrame:
    """conv_id, context, qa_turns: the turns that fit the budget as a table text."""
    qa = qa_turns(turns)
    if user_turns_only:
        qa = qa.withColumn("answer", F.lit(None).cast("string"))
    w = Window.partitionBy("conv_id").orderBy(F.col("qa_id").desc() if recency_bias else F.col("qa_id").asc())
    if max_qa_turns:
        # cut to the first few per conversation before the shuffle
        qa = qa.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= max_qa_turns)
    else:
        qa = ordered.row_numbers(qa, "__rn", ["conv_id"], [F.col("qa_id").desc() if recency_bias else F.col("qa_id").asc()])
    lines = F.concat(
        strings.csv_line([F.lit("user"), F.col("question")], delimiter),
        F.when(F.col("answer").isNotNull(), F.concat(F.lit("\n"), strings.csv_line([F.lit("assistant"), F.col("answer")], delimiter))).otherwise(""),
    )
    lined = qa.withColumn("__lines", lines).withColumn("__n", tok.count(F.col("__lines")).cast("long"))
    head = f"-----{name}-----\nturn{delimiter}content\n"
    # words of the head, and the line break at the end
    head_tokens = len(head.split()) + 1
    kept = budget.prefix(lined, ["conv_id"], ["__rn"], F.col("__n"), max_tokens, head_tokens, "__sum")
    rows = F.sort_array(F.collect_list(F.struct("__rn", "__lines")))
    return kept.groupBy("conv_id").agg(rows.alias("__r")).select(
        "conv_id",
        F.concat(F.lit(head), F.array_join(F.transform("__r", lambda s: s["__lines"]), "\n"), F.lit("\n")).alias("context"),
        F.size("__r").alias("qa_turns"),
    )
