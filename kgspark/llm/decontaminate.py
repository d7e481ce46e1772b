"""Search for benchmark items inside documents by size-partitioned MinHash containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import small_or_plain, staged

WORDS = 5
CONTAINMENT_PERCENT = 80


def shingle_hashes(df: DataFrame, text: Column, out: str, n: int = WORDS) -> DataFrame:
    """Add ``out``: hashes of all runs of ``n`` words, in order, repeats included.

    Words are runs of letters and digits, lower-cased. With fewer than ``n`` words the whole
    sequence is one shingle; without words, or for null, the array is empty.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = df.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w)))
    runs = F.transform(
        F.sequence(F.lit(0), F.size("_words") - n),
        lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(n)]),
    )
    none = F.array().cast("array<bigint>")
    return hashed.withColumn(
        out,
        F.when(F.size("_words") >= n, runs).when(F.size("_words") > 0, F.array(F.xxhash64("_words", F.size("_words")))).otherwise(none),
    ).drop("_words")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = CONTAINMENT_PERCENT,
    n: int = WORDS,
) -> DataFrame:
    """Pairs of a document and an item of which it holds at least ``percent`` of the distinct shingles.

    Returns ``id_col``, ``item_col``, ``n_shared``, ``n_item``. Items and documents without words
    match nothing, as do rows with a null id; an item of fewer than ``n`` words matches a document
    that is just this sequence. Rows that repeat an id count as one text with the shingles of all of
    them. Other columns are not looked at. An empty table on either side gives no rows.

    An item's sketch is its smallest ``m`` hashes. If a document holds the required share of the
    item, it misses fewer than ``m``, so one of them is in it: the search loses nothing. The
    search is not partitioned by size: a document's sketch is its hashes up to the largest hash in
    any item's sketch. With short items that is most of its hashes; only those beyond never leave
    the row. Candidates are verified on whole shingle sets.
    """
    text = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter("doc IS NOT NULL")
    bench = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter("item IS NOT NULL")
    whole = (
        shingle_hashes(bench, F.col("text"), "hashes", n)
        .select("item", F.explode("hashes").alias("h"))
        .groupBy("item")
        .agg(F.array_sort(F.collect_set("h")).alias("hashes"))
        .withColumn("q", F.size("hashes"))
        .withColumn("part", F.floor(F.log2("q")))
        .withColumn("m", (F.col("q") - F.ceil(F.col("q") * percent / 100.0) + 1).cast("int"))
    )
    whole = staged(whole, "items")
    probes = staged(whole.select("item", "q", "part", F.explode(F.slice("hashes", 1, F.col("m"))).alias("h")), "item-sketches")
    # one row per power of two, so 31 at most
    bounds = {r["part"]: r["bound"] for r in probes.groupBy("part").agg(F.max("h").alias("bound")).collect()}
    if not bounds:
        out = f"{id_col} {dict(docs.dtypes)[id_col]}, {item_col} {dict(items.dtypes)[item_col]}, n_shared long, n_item long"
        return docs.sparkSession.createDataFrame([], out)
    sketched = shingle_hashes(text, F.col("text"), "hashes", n).select(
        "doc", F.explode(F.array_distinct(F.filter("hashes", lambda h: h <= max(bounds.values())))).alias("h")
    )
    found = staged(sketched.join(small_or_plain(probes.select("item", "h")), "h").select("doc", "item").distinct(), "item-candidates")
    holders = small_or_plain(staged(found.select("doc").distinct(), "item-holders"))
    # whole sets of the candidates only; a repeated id brings its sets together by the sum over shingles
    sets = shingle_hashes(text.join(holders, "doc"), F.col("text"), "hashes", n).select(
        "doc", F.array_distinct("hashes").alias("hashes")
    )
    shared = (
        sets.join(found, "doc")
        .join(whole.select("item", "q", F.col("hashes").alias("wanted")), "item")
        .select("doc", "item", "q", F.array_intersect("hashes", "wanted").alias("both"))
    )
    counted = (
        shared.groupBy("doc", "item", "q")
        .agg(F.flatten(F.collect_set("both")).alias("both"))
        .select("doc", "item", "q", F.size(F.array_distinct("both")).alias("n_shared"))
    )
    return counted.filter(F.col("n_shared") * 100 >= F.col("q") * percent).select(
        F.col("doc").alias(id_col),
        F.col("item").alias(item_col),
        F.col("n_shared").cast("long").alias("n_shared"),
        F.col("q").cast("long").alias("n_item"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold an item; clean rows, and rows with a null id, stay as they are."""
    bad = staged(contaminated(docs, items, id_col, **options).select(id_col).distinct(), "contaminated")
    return docs.join(small_or_plain(bad), id_col, "left_anti")
