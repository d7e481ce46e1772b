"""Similarity search: exact by matrix product in the tasks, approximate by hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.operators import order
from kgspark.session import cut

QUERY_BLOCK = 2_000
# Scores a task holds at once.
SCORE_CELLS = 1_000_000
# Scores are compared to so many digits, so that equal vectors tie however they were multiplied.
DIGITS = 12


def units(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; rows of zeros stay."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1.0, length)


def similarity_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, to: str = "score") -> DataFrame:
    """query_id, id, score, position: the k most similar vectors by cosine, smaller id on a tie.

    ``vectors`` holds id, vector; ``queries`` query_id, vector. Queries are
    sent to the tasks in blocks of bounded size; every partition of vectors
    keeps its own k best, so the shuffle carries k rows per query and partition.
    """
    queries = cut(queries.select("query_id", "vector"))
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    best = None
    for b in range(blocks):
        mine = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        part = _block_topk(vectors, mine, k)
        best = part if best is None else best.unionByName(part)
    return order.top_k_per_group(best, ["query_id"], [("score", "desc"), ("id", "asc")], k, "position").select(
        "query_id", "id", F.col("score").alias(to), "position"
    )


def _block_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    rows = queries.collect()  # about QUERY_BLOCK rows
    ids = [r["query_id"] for r in rows]
    matrix = np.array([r["vector"] for r in rows], dtype=np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast(units(matrix) if len(rows) else matrix)
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", vectors.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        # the best of the partition so far: query, id, score
        held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for frame in frames:
            if frame.empty or not len(q):
                continue
            step = max(k + 1, SCORE_CELLS // len(q))
            for at in range(0, len(frame), step):
                part = frame.iloc[at : at + step]
                scores = np.round(q @ units(np.stack(part["vector"].to_numpy()).astype(np.float64)).T, DIGITS)
                if scores.shape[1] > k:
                    bar = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
                    if held is not None:
                        # what is not above the worst of k held ones is no better; equal ones may have a smaller id
                        bar = np.maximum(bar, _worst(held, len(q), k))
                    qi, vi = np.nonzero(scores >= bar)
                else:
                    qi, vi = np.nonzero(np.ones_like(scores, dtype=bool))
                new = (qi, part["id"].to_numpy()[vi], scores[qi, vi])
                held = new if held is None else tuple(np.concatenate([a, b]) for a, b in zip(held, new))
                held = _best(*held, k)
        if held is not None:
            yield pd.DataFrame({"query_id": [ids[i] for i in held[0]], "id": held[1], "score": held[2]})

    return vectors.select("id", "vector").mapInPandas(run, schema)


def _best(query: np.ndarray, key: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, smaller key on a tie."""
    by = np.lexsort((key, -score, query))
    query, key, score = query[by], key[by], score[by]
    if not len(query):
        return query, key, score
    first = np.r_[True, query[1:] != query[:-1]]
    place = np.arange(len(query)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return query[place < k], key[place < k], score[place < k]


def _worst(held: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, k: int) -> np.ndarray:
    """The k-th score held of each of n queries, as a column; none where fewer are held."""
    known = ~np.isnan(held[2])
    lowest = np.full(n, np.inf)
    np.minimum.at(lowest, held[0][known], held[2][known])
    return np.where(np.bincount(held[0][known], minlength=n) >= k, lowest, -np.inf)[:, None]


def filter_by_id(vectors: DataFrame, include: DataFrame) -> DataFrame:
    return vectors.join(include.select("id"), "id", "left_semi")


def similarity_topk_lsh(
    vectors: DataFrame, queries: DataFrame, k: int = 10, radius: float = 1.0, tables: int = 5, width: float = 0.5, seed: int = 7
) -> DataFrame:
    """Approximate variant: only vectors that share a hash bucket with the query are ranked.

    Vectors are scaled to length 1 first, so Euclidean distance orders as cosine does. Unit vectors fall
    into few buckets, so pairs that share one are no rows: queries go to the tasks in blocks as in
    ``similarity_topk``, and a partition of vectors hands on its own k best of each.
    """

    def unit(df, key):
        norm = F.sqrt(F.aggregate(F.col("vector"), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        scaled = F.transform("vector", lambda x: x.cast("double") / F.col("__norm"))
        # a row listed twice is one
        once = df.withColumn("__norm", norm).filter("__norm > 0").select(key, scaled.alias("vector")).distinct()
        return once.select(key, "vector", array_to_vector("vector").alias("features"))

    lsh = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=seed
    )
    v = unit(vectors, "id")
    model = lsh.fit(v)
    buckets = F.array(*[vector_to_array(F.col("hashes")[i])[0] for i in range(tables)]).alias("buckets")
    hashed = model.transform(v).select("id", "vector", buckets)
    asked = cut(model.transform(unit(queries, "query_id")).select("query_id", "vector", buckets))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    best = None
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        part = _block_lsh(hashed, mine, k, radius)
        best = part if best is None else best.unionByName(part)
    return order.top_k_per_group(best, ["query_id"], [("score", "desc"), ("id", "asc")], k, "position")


# Products of unit vectors and exact distances differ by less.
SLACK = 1e-9
# Pairs whose exact distance is worked out at once.
PAIRS = 50_000


def _block_lsh(vectors: DataFrame, queries: DataFrame, k: int, radius: float) -> DataFrame:
    """The k nearest of each partition for a block of queries, among those with a bucket in common."""
    rows = queries.collect()  # about QUERY_BLOCK rows
    ids = [r["query_id"] for r in rows]
    matrix = np.array([r["vector"] for r in rows], dtype=np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((matrix, np.array([r["buckets"] for r in rows])))
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", vectors.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    least = 1 - radius * radius / 2 - SLACK

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, in_q = shared.value
        held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for frame in frames:
            if frame.empty or not len(q):
                continue
            step = max(k + 1, SCORE_CELLS // len(q))
            for at in range(0, len(frame), step):
                part = frame.iloc[at : at + step]
                v, in_v = (np.stack(part[c].to_numpy()).astype(np.float64) for c in ("vector", "buckets"))
                meet = np.zeros((len(q), len(v)), dtype=bool)
                for i in range(in_v.shape[1]):
                    meet |= in_q[:, i, None] == in_v[None, :, i]
                scores = np.where(meet, q @ v.T, -np.inf)
                bar = np.full((len(q), 1), least)
                if scores.shape[1] > k:
                    bar = np.maximum(bar, -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k] - SLACK)
                if held is not None:
                    bar = np.maximum(bar, _worst(held, len(q), k) - SLACK)
                qi, vi = np.nonzero(scores >= bar)
                key = part["id"].to_numpy()
                for first in range(0, len(qi), PAIRS):
                    a, b = qi[first : first + PAIRS], vi[first : first + PAIRS]
                    # added up from the first place to the last, as Spark's own distance is
                    distance = np.sqrt(np.add.accumulate((q[a] - v[b]) ** 2, axis=1)[:, -1])
                    near = distance < radius
                    new = (a[near], key[b[near]], (1 - distance * distance / 2)[near])
                    held = new if held is None else tuple(np.concatenate([x, y]) for x, y in zip(held, new))
                    held = _best(*held, k)
        if held is not None:
            yield pd.DataFrame({"query_id": [ids[i] for i in held[0]], "id": held[1], "score": held[2]})

    return vectors.select("id", "vector", "buckets").mapInPandas(run, schema)


def context_for(hits: DataFrame, documents: DataFrame, key: str, text: str) -> DataFrame:
    """query_id, context: the texts of the hits in order, blank lines between (k of them)."""
    joined = hits.join(documents.select(F.col(key).alias("id"), F.col(text).alias("__t")), "id")
    rows = F.sort_array(F.collect_list(F.struct("position", "__t")))
    return joined.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["__t"]), "\n\n").alias("context"))


def project_2d(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, x, y: the two main components; rows without a vector are left out."""
    from pyspark.ml.feature import PCA

    ready = df.filter(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="xy").fit(ready)
    xy = vector_to_array("xy")
    return model.transform(ready).select(key, xy[0].alias("x"), xy[1].alias("y"))


