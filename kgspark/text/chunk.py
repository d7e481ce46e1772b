"""Chunking of texts and of groups of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark import config
from kgspark.functions import tokens as tok
from kgspark.operators import ordered
from kgspark.text import split

# Chunks that go back to Spark at once.
CHUNKS_PER_BATCH = 5_000
_chunkers: dict[str, set[str]] = {}

# Sentence end.
SENTENCE_END = r"(?<=[.!?])\s+"


def chunk_tokens(
    df: DataFrame,
    column: str,
    size: int = config.CHUNK_SIZE,
    overlap: int = config.CHUNK_OVERLAP,
    tokenizer: str = "pattern",
) -> DataFrame:
    """Sliding token chunks of each text: ``chunk_index``, ``chunk``, ``n_tokens``.

    A chunk starts at every multiple of size - overlap below the token count,
    so a tail that lies wholly in the overlap still makes a chunk.
    """
    step = size - overlap

    def cut_up(tk):
        starts = F.sequence(F.lit(0), F.size(tk) - 1, F.lit(step))
        return F.when(F.size(tk) > 0, F.transform(starts, lambda start: F.slice(tk, start + 1, F.lit(size))))

    # the outer transform binds the token array, so that it is made once per text
    parts = F.flatten(F.transform(F.array(tok.tokens(F.col(column), tokenizer)), cut_up))
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.posexplode(parts).alias("chunk_index", "__part")).select(
        *kept, "chunk_index", tok.join(F.col("__part")).alias("chunk"), F.size("__part").alias("n_tokens")
    )


def chunk_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    id_column: str,
    column: str,
    size: int = config.CHUNK_SIZE,
    overlap: int = config.CHUNK_OVERLAP,
    tokenizer: str = "pattern",
    **limits,
) -> DataFrame:
    """Chunks over the joined token stream of each group's texts.

    Every text knows its offset in the stream from a running sum and cuts its
    own pieces; a chunk is put together from the pieces of the texts it
    touches. No task sees more of a group than one chunk.
    """
    step = size - overlap
    counted = df.select(*keys, *order, F.col(id_column).alias("__id"), F.col(column).alias("__text")).withColumn(
        "__n", tok.count(F.col("__text"), tokenizer).cast("long")
    ).filter(F.col("__n") > 0)
    placed = ordered.running_sums(counted, {"__end": F.col("__n")}, keys, order, **limits)
    start = F.col("__end") - F.col("__n")
    first = F.greatest(F.lit(0).cast("long"), F.floor((start - size) / step) + 1)
    last = F.floor((F.col("__end") - 1) / step)

    def piece(k, tk):
        low = F.greatest(start, k * step)
        high = F.least(F.col("__end"), k * step + size)
        part = F.slice(tk, (low - start + 1).cast("int"), F.greatest(high - low, F.lit(0).cast("long")).cast("int"))
        return F.struct(k.alias("chunk_index"), part.alias("part"))

    bound = F.array(tok.tokens(F.col("__text"), tokenizer))  # made once per text
    cuts = F.flatten(F.transform(bound, lambda tk: F.transform(F.sequence(first, last), lambda k: piece(k, tk))))
    pieces = placed.select(*keys, *order, "__id", F.inline(cuts)).filter(F.size("part") > 0)
    row = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col("__id").alias("id"), "part")
    return (
        pieces.groupBy(*keys, "chunk_index")
        .agg(F.sort_array(F.collect_list(row)).alias("__rows"))
        .select(
            *keys,
            "chunk_index",
            F.transform("__rows", lambda r: r["id"]).alias("document_ids"),
            F.array_join(F.transform("__rows", lambda r: tok.join(r["part"])), "").alias("chunk"),
            F.aggregate("__rows", F.lit(0), lambda a, r: a + F.size(r["part"])).alias("n_tokens"),
        )
    )


def chunk_sentences(df: DataFrame, column: str) -> DataFrame:
    kept = [c for c in df.columns if c != column]
    pieces = F.filter(F.split(F.col(column), SENTENCE_END), lambda s: s != "")
    return df.select(*kept, F.posexplode(pieces).alias("chunk_index", "chunk"))


def _by_offsets(df: DataFrame, key: str, column: str, cut: Callable[[str], Iterable[tuple]], more: str = "") -> DataFrame:
    """Chunks that ``cut`` makes of each text, one Arrow pass without a shuffle."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, chunk_index long, chunk string{more}"

    names = [key, "chunk_index", "chunk", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.columns
            owner, chunks = [], []
            for row, text in enumerate(texts.to_pylist()):
                made = [(i, *c) for i, c in enumerate(cut(text))] if text else []
                owner += [row] * len(made)
                chunks += made
                if len(chunks) >= CHUNKS_PER_BATCH:
                    yield _batch(keys, owner, chunks, names)
                    owner, chunks = [], []
            if chunks:
                yield _batch(keys, owner, chunks, names)

    return df.select(key, column).mapInArrow(run, schema)


def _batch(keys: pa.Array, owner: list[int], chunks: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = [keys.take(pa.array(owner, pa.int64())), *map(pa.array, zip(*chunks))]
    return pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])


def chunk_chars(
    df: DataFrame,
    key: str,
    column: str,
    size: int = config.CHAR_CHUNK_SIZE,
    overlap: int = config.CHAR_CHUNK_OVERLAP,
    separator: str = "\n",
) -> DataFrame:
    """Chunks by characters: pieces at the separator, packed in order up to ``size``.

    A piece longer than ``size`` is cut into sliding windows first. A piece keeps the separator that
    followed it. Null and empty texts have no chunks.
    """

    def cut(text: str):
        for pieces in split.window_spans(text, size, overlap, separator):
            chunk = "".join([text[low:high] for low, high in pieces])
            yield chunk, len(chunk)

    return _by_offsets(df, key, column, cut, ", n_chars long")


def chunk_recursive(
    df: DataFrame,
    key: str,
    column: str,
    size: int = config.CHAR_CHUNK_SIZE,
    overlap: int = config.CHAR_CHUNK_OVERLAP,
    separators: Sequence[str] = ("\n\n", "\n", " "),
) -> DataFrame:
    """key, chunk_index, chunk: at most ``size`` characters, split at the widest separator that does.

    A piece that is too long is split at the next separator: paragraphs, lines,
    words, at last characters. Pieces are packed in order, and each chunk starts
    with the last whole pieces of the one before, up to ``overlap`` characters.
    Null and empty texts have no chunks.
    """

    def cut(text: str):
        return ((text[low:high],) for low, high in split.recursive_spans(text, size, overlap, separators))

    return _by_offsets(df, key, column, cut)


def register_chunker(
    spark: SparkSession, name: str, splitter: Callable[[str], Iterable[str | tuple[str, int | None]]]
) -> None:
    """Make a user's splitter a table function of the session, under ``name``.

    ``splitter`` gets one whole text and yields its chunks, or chunks with their token counts. In SQL:
    ``SELECT d.id, c.* FROM docs d, LATERAL name(d.text) c``; in ``chunk``: ``strategy=name``.
    """

    class Chunker:
        def eval(self, text: str):
            if text is not None:
                for index, made in enumerate(splitter(text)):
                    chunk, count = (made, None) if isinstance(made, str) else made
                    yield index, chunk, count

    hook = F.udtf(Chunker, returnType="chunk_index int, chunk string, n_tokens int", useArrow=True)
    spark.udtf.register(name, hook)
    _chunkers.setdefault(spark.sparkContext.applicationId, set()).add(name)


def _by_table_function(df: DataFrame, column: str, name: str) -> DataFrame:
    spark = df.sparkSession
    kept = [f"d.`{c}`" for c in df.columns if c != column]
    sql = f"SELECT {', '.join([*kept, 'c.*'])} FROM {{docs}} d, LATERAL {name}(d.`{column}`) c"
    return spark.sql(sql, docs=df)


def chunk(df: DataFrame, column: str, strategy: str = "tokens", **options) -> DataFrame:
    """Chunk one text per row by tokens, by sentences, not at all, or by a registered splitter."""
    if strategy == "tokens":
        return chunk_tokens(df, column, **options)
    if strategy == "sentence":
        return chunk_sentences(df, column)
    if strategy == "none":
        return df.withColumnRenamed(column, "chunk").withColumn("chunk_index", F.lit(0))
    if strategy in _chunkers.get(df.sparkSession.sparkContext.applicationId, ()):
        return _by_table_function(df, column, strategy)
    raise ValueError(f"unknown chunk strategy: {strategy}")


def text_units(documents: DataFrame, size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP) -> DataFrame:
    """Base text units: one document's chunks, with stable ids."""
    parts = chunk_tokens(documents.select("id", "text"), "text", size, overlap)
    unit = F.md5(F.concat_ws("\u0001", "id", F.col("chunk_index").cast("string"), "chunk"))
    return parts.filter(F.col("chunk").isNotNull()).select(
        unit.alias("id"),
        unit.alias("chunk_id"),
        F.array("id").alias("document_ids"),
        "chunk",
        "n_tokens",
    )
