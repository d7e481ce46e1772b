"""Inverted-file index: vectors in lists by their nearest centre, in Parquet partitioned by list.

Centres are fitted on a bounded sample; every vector is listed. A search reads the lists whose centres
are nearest to its queries and ranks what is in them by exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.operators import order
from kgspark.session import cut
from kgspark.vector.topk import DIGITS, _best, similarity_topk, units

# Vectors that the centres are fitted on.
SAMPLE_ROWS = 50_000
# Centres are sent to every task: at most so many.
MOST_LISTS = 4_096
# Vectors and queries that one task compares at a time.
BLOCK_VECTORS, BLOCK_QUERIES = 20_000, 1_000


@dataclass
class Index:
    """A written index: its folder, its centres (unit vectors) and the rows of each list."""

    path: str
    centres: np.ndarray
    sizes: dict[int, int]


def _nearest(centres: np.ndarray, vectors: pd.Series, n: int) -> list[list[int]]:
    scores = units(np.stack(vectors.to_numpy()).astype(np.float64)) @ centres.T
    return np.argsort(-scores, axis=1, kind="stable")[:, :n].tolist()


def _listed(df: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """``df`` (its first column, vector) with the ``n`` nearest lists of each row, a row for each, ``place`` from 0."""
    shared = df.sparkSession.sparkContext.broadcast(centres)
    key = df.columns[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(lists=_nearest(shared.value, frame["vector"], n))

    schema = T.StructType([*df.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))])
    return df.mapInPandas(run, schema).select(key, "vector", F.posexplode("lists").alias("place", "list"))


def build(vectors: DataFrame, path: str, lists: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Index:
    """Index ``vectors`` (id, vector) under ``path``; rows without a vector or of length 0 are left out.

    The centres come from about ``sample_rows`` vectors, drawn by a hash of their ids; ``lists``
    defaults to the root of the number of vectors. Files of a list are split by size where one holds
    a large share of all vectors.
    """
    spark = vectors.sparkSession
    length = F.aggregate(F.col("vector"), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    usable = vectors.select("id", "vector").filter(F.col("vector").isNotNull()).filter(length > 0)
    rows = usable.count()
    if not rows:
        return Index(path, np.zeros((0, 0)), {})
    lists = min(MOST_LISTS, lists or max(1, round(math.sqrt(rows))))
    scaled = F.transform("vector", lambda x: x.cast("double") / F.sqrt(length))
    share = min(1.0, sample_rows / rows)
    drawn = usable.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    # copies of one vector would take several centres
    sample = drawn.select(scaled.alias("unit")).distinct().select(array_to_vector("unit").alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(sample)
    centres = units(np.array(model.clusterCenters()))
    placed = _listed(usable, centres, 1).drop("place")
    placed.hint("rebalance", "list").write.partitionBy("list").parquet(path)
    sizes = {r["list"]: r["count"] for r in load(spark, path, vectors).groupBy("list").count().collect()}
    return Index(path, centres, sizes)


def load(spark: SparkSession, path: str, vectors: DataFrame) -> DataFrame:
    schema = T.StructType([vectors.schema["id"], vectors.schema["vector"], T.StructField("list", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)


def probes_for(index: Index, vectors: DataFrame, k: int = 10, target: float = 0.9, sample_rows: int = 500, seed: int = 11) -> int:
    """The fewest probes that find ``target`` of the exact neighbours of a sample of the vectors.

    About ``sample_rows`` of them are compared with all vectors; how many probes are needed depends on
    how well the data falls into lists, so it is measured and not guessed. The target is raised by
    three standard errors of the sample.
    """
    rows = sum(index.sizes.values())
    if not rows:
        return 1
    usable = vectors.select("id", "vector").filter(F.col("vector").isNotNull())
    part = min(1.0, sample_rows / rows)
    sample = cut(usable.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(part * (1 << 20))).withColumnRenamed("id", "query_id"))
    near = similarity_topk(usable, sample, k).select("query_id", "id")
    ranked = _listed(sample, index.centres, len(index.centres)).select("query_id", "place", "list")
    lists = load(vectors.sparkSession, index.path, vectors).select("id", "list")
    found = near.join(lists, "id").join(ranked, ["query_id", "list"]).groupBy("place").count().collect()
    at = np.zeros(len(index.centres), np.int64)
    for r in found:
        at[r["place"]] = r["count"]
    total = max(1, at.sum())
    wanted = min(1.0, target + 3 * math.sqrt(target * (1 - target) / total))
    return int(np.searchsorted(np.cumsum(at), wanted * total)) + 1


def search(index: Index, vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
    """query_id, id, score, position: the ``k`` most similar vectors in the ``probes`` nearest lists of each query.

    Only probed lists are read. Lists and the queries on them meet in blocks, so a list that holds a
    large share of all vectors, or that many queries probe, is shared by many tasks; each block keeps
    the ``k`` best of its queries. Equal scores go to the smaller id. Queries without a vector have no rows.
    """
    spark = queries.sparkSession
    id_field, query_field = vectors.schema["id"], queries.schema["query_id"]
    out = T.StructType(
        [T.StructField("query_id", query_field.dataType), T.StructField("id", id_field.dataType), T.StructField("score", T.DoubleType())]
    )
    if not index.sizes:
        return spark.createDataFrame([], out).withColumn("position", F.lit(0))
    asked = queries.select("query_id", "vector").filter(F.col("vector").isNotNull())
    probing = cut(_listed(asked, index.centres, probes))
    # at most one row per centre
    asks = {r["list"]: r["count"] for r in probing.groupBy("list").count().collect() if r["list"] in index.sizes}
    grid = [(n, -(-index.sizes[n] // BLOCK_VECTORS), -(-asks[n] // BLOCK_QUERIES)) for n in asks]
    blocks = F.broadcast(spark.createDataFrame(grid, "list int, vblocks int, qblocks int"))

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Each row in its own block, once per block of the other side."""
        mine = F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other)
        return df.join(blocks, "list").select(key, "vector", "list", mine, every)

    held = load(spark, index.path, vectors).filter(F.col("list").isin(list(asks)))
    left = dealt(held, "id", "vblock", "qblock").groupBy("list", "vblock", "qblock")
    right = dealt(probing, "query_id", "qblock", "vblock").groupBy("list", "vblock", "qblock")

    def compare(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(asked):
            return pd.DataFrame({"query_id": asked["query_id"][:0], "id": found["id"][:0], "score": np.zeros(0)})
        a, b = (units(np.stack(x["vector"].to_numpy()).astype(np.float64)) for x in (asked, found))
        scores = np.round(a @ b.T, DIGITS)
        if scores.shape[1] > k:
            qi, vi = np.nonzero(scores >= -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k])
        else:
            qi, vi = np.nonzero(np.ones_like(scores, dtype=bool))
        qi, ids, best = _best(qi, found["id"].to_numpy()[vi], scores[qi, vi], k)
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[qi], "id": ids, "score": best})

    near = left.cogroup(right).applyInPandas(compare, out)
    return order.top_k_per_group(near, ["query_id"], [("score", "desc"), ("id", "asc")], k, "position").select("query_id", "id", "score", "position")
