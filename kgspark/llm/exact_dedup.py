"""Exact deduplication as a stateful stream over digests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.common import lower_ascii, small_or_plain, staged
from kgspark.session import scratch_path

# Fixed value: the name of Spark's own disk-backed state store.
DISK_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# What the state stores of one executor hold in memory; the rest is on its disk.
STATE_MEMORY_MB = 128


def normalised(text: Column) -> Column:
    """What two texts are compared by: A-Z lower-cased, null as empty."""
    return lower_ascii(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _stream_session(spark: SparkSession) -> SparkSession:
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", DISK_STATE)
    # many small stores must not reserve space ahead
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    # and share one bound of memory per executor
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", str(STATE_MEMORY_MB))
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB", "8")
    return own


def digest_state(entries: DataFrame, checkpoint: str, batches: int = 4) -> DataFrame:
    """Run ``entries(digest, doc, file, bytes)``, a stage table, through the keyed stream and give its state.

    The state has one entry per digest, kept without expiry on the executors' disks and saved under
    ``checkpoint``: how many rows had the digest, the largest identifier, and where that row's text
    lies (its file and its length). Counts are combined before the shuffle, so a digest on a third
    of all rows is no burden to one task. Calling it again with the same checkpoint takes in new
    files only.
    """
    spark = entries.sparkSession
    own = _stream_session(spark)
    files = entries.inputFiles()
    if not files:
        return spark.createDataFrame([], "digest binary, size long, keep_id long, file string, bytes long")
    folder = files[0].rsplit("/", 1)[0]
    stream = (
        own.readStream.schema(entries.schema)
        .option("maxFilesPerTrigger", max(1, math.ceil(len(files) / batches)))
        .parquet(folder)
        .groupBy("digest")
        .agg(F.count("*").alias("size"), F.max(F.struct("doc", "file", "bytes")).alias("keep"))
    )
    run = (
        stream.writeStream.format("noop")
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    # plain columns again: the value holds the aggregates in the order given above
    state = spark.read.format("statestore").load(checkpoint).select("key.*", "value.*")
    state = state.toDF("digest", "size", "keep")
    return state.select("digest", "size", *[F.col(f"keep.{a}").alias(b) for a, b in (("doc", "keep_id"), ("file", "file"), ("bytes", "bytes"))])


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest=sha256,
    batches: int = 4,
) -> DataFrame:
    """One row per row of ``docs``: which row of its group of equal texts stays.

    Returns ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``digest``. Texts are equal when they
    are the same after lower-casing A-Z; null counts as empty. The largest id of a group stays. Rows
    that repeat an id and a text count in ``group_size`` and share one decision; a null id stays only
    if its group has no other. Other columns are not looked at. An empty table gives no rows.

    Digests, identifiers and locators go through a stream with disk-backed keyed state. Rows that hit
    a digest seen before are then compared with the kept row byte by byte; should a digest stand for
    several texts, these are told apart by their texts, so a weak digest costs time and not results.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), normalised(F.col(text_col)).alias("norm"))
    entries = staged(
        texts.select(
            "doc",
            digest(F.col("norm")).alias("digest"),
            F.substring_index(F.input_file_name(), "/", -1).alias("file"),
            F.octet_length("norm").cast("long").alias("bytes"),
        ),
        "digests",
    )
    state = staged(digest_state(entries, scratch_path(spark, "dedup-state"), batches), "dedup-groups")
    hit = small_or_plain(state.filter("size > 1").select("digest", "keep_id", F.col("bytes").alias("kept_bytes")))
    # whole texts of the hits alone are moved; the kept text is one row per digest
    same = texts.withColumn("digest", digest(F.col("norm"))).join(hit, "digest")
    kept_text = same.filter("doc <=> keep_id").groupBy("digest").agg(F.first("norm").alias("kept_norm"))
    wrong = staged(
        same.filter(~F.col("doc").eqNullSafe(F.col("keep_id")) | (F.octet_length("norm") != F.col("kept_bytes")))
        .join(kept_text, "digest")
        .filter("norm <> kept_norm")
        .select("digest")
        .distinct(),
        "digest-clashes",
    )
    plain = entries.join(state.select("digest", "size", "keep_id"), "digest")
    if wrong.isEmpty():
        return _decided(plain, id_col)
    clean = plain.join(wrong, "digest", "left_anti")
    split = texts.withColumn("digest", digest(F.col("norm"))).join(wrong, "digest")
    groups = split.groupBy("digest", "norm").agg(F.count("*").alias("size"), F.max("doc").alias("keep_id"))
    told = split.join(groups, ["digest", "norm"])
    return _decided(clean.select("doc", "digest", "size", "keep_id").unionByName(told.drop("norm")), id_col)


def _decided(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(
        F.col("doc").alias(id_col),
        "keep_id",
        F.col("size").cast("long").alias("group_size"),
        F.col("doc").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )
