"""Removal of lines that many documents repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import BLANKS, lower_ascii, staged

MIN_CHARS = 20
MIN_DOCS = 3


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """Give each document's text without the lines that at least ``min_docs`` documents hold.

    Lines are compared by a key: blanks stripped at both ends, A-Z lower-cased. Keys shorter than
    ``min_chars`` code points are never dropped. The largest id that holds a key keeps its lines.

    Returns ``id_col``, ``n_lines``, ``n_dropped`` and ``kept_text``, one row per input row; other
    columns are not looked at, so their names cannot clash. A null or empty text is one empty line
    and stays. A null id counts as no document: its lines are neither counted nor dropped. Rows
    that repeat an id have to be the same document listed again; they count once and get the same
    result. An empty table gives no rows.

    Keys travel as 96 bits of hash. A first count over rows leaves the few keys that can reach
    ``min_docs``; documents are told apart for those only. The lines stay where they are: only
    dropped positions are sent back to a document.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    line = rows.filter("doc IS NOT NULL").select("doc", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = line.select("doc", "pos", lower_ascii(F.btrim("line", F.lit(BLANKS))).alias("key")).filter(
        F.char_length("key") >= min_chars
    )
    held = keyed.select("doc", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))
    often = held.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    # the lines of keys on so many rows; a hot key is split by the join, not by a window
    found = staged(held.join(often.drop("n"), ["h1", "h2"]), "repeated-lines")
    keys = (
        found.select("h1", "h2", "doc")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.max("doc").alias("keeper"))
        .filter(F.col("n") >= min_docs)
        .drop("n")
    )
    dropped = (
        found.join(keys, ["h1", "h2"])
        .filter("doc <> keeper")
        .groupBy("doc")
        .agg(F.array_sort(F.collect_set("pos")).alias("drops"))
    )
    dropped = staged(dropped, "dropped-lines")
    # one plan at every size: texts and positions are dealt out by document
    whole = rows.join(dropped.hint("merge"), "doc", "left").select(
        "doc",
        F.split("text", "\n", -1).alias("lines"),
        F.coalesce("drops", F.array().cast("array<int>")).alias("drops"),
    )
    # pieces between dropped lines; linear in the lines, however many are dropped
    pieces = F.expr(
        """flatten(transform(sequence(0, size(drops)), i -> slice(lines,
             if(i = 0, 0, drops[i - 1] + 1) + 1,
             if(i = size(drops), size(lines), drops[i]) - if(i = 0, 0, drops[i - 1] + 1))))"""
    )
    kept = F.when(F.size("drops") == 0, F.col("lines")).otherwise(pieces)
    return whole.select(
        F.col("doc").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("drops").cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept_text"),
    )
