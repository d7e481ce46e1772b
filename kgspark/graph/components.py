"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.graph.numbers import dictionary, encoded
from kgspark.session import stored as cut  # sizes that are known keep plans of the rounds short


def contract(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """One round over edges(a, b) of 64-bit ids: (id, rep) of all of them, and the edges left.

    Every id points at the neighbour of the lowest hash, itself included, and takes over where that
    one points. What points alike becomes one id; edges inside it go, parallel ones become one. Hashes
    change with ``turn``, so that no order of ids is slow: an id stays on its own only if its hash is
    the lowest around it.
    """

    def ranked(c: str) -> Column:
        return F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("hash"), F.col(c).alias("id"))

    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select(F.col("a").alias("id"), F.least(ranked("a"), "m")["id"].alias("rep"))
    onward = near.select(F.col("id").alias("rep"), F.col("rep").alias("next"))
    # read by both joins below and again on the way back
    reps = cut(near.join(onward, "rep").select("id", F.col("next").alias("rep")))
    left = edges
    for column in ("a", "b"):
        left = left.join(reps.select(F.col("id").alias(column), "rep"), column).drop(column).withColumnRenamed("rep", column)
    left = left.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return reps, cut(left)


def components_of(edges: DataFrame) -> DataFrame:
    """id, root (the smallest id of the component) of the ids in edges(a, b), loops left out.

    Rounds of contraction until no edge is left; each takes a share of the ids away, so the work of
    all of them is in proportion to the first. The ids are then followed through the rounds, from the last to the first.
    """
    pairs = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = cut(pairs)
    rounds = []
    while not left.isEmpty():
        reps, left = contract(left, len(rounds))
        rounds.append(reps)
    ends = pairs.limit(0).select(F.col("a").alias("id"), F.col("b").alias("root"))
    for reps in reversed(rounds):
        onward = ends.select(F.col("id").alias("rep"), "root")
        # an id without edges in the round after is the end of its way
        ends = reps.join(onward, "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
    ends = cut(ends)
    lowest = ends.groupBy("root").agg(F.min("id").alias("low"))
    return ends.join(lowest, "root").select("id", F.col("low").alias("root"))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """title, component (the smallest title of the component).

    Titles that are not 64-bit numbers become such first; all rounds are on these. A null title is a
    component of its own.
    """
    if edges.schema["source"].dataType == T.LongType():
        return _of_numbers(edges, nodes)
    titles = edges.select(F.explode(F.array("source", "target")).alias("title"))
    if nodes is not None:
        titles = titles.unionByName(nodes.select("title"))
    ids = dictionary(titles)
    pairs = encoded(edges.select("source", "target"), ids).toDF("a", "b")
    placed = ids.join(components_of(pairs), "id", "left").select("title", F.coalesce("root", "id").alias("root"))
    names = ids.select(F.col("id").alias("root"), F.col("title").alias("component"))
    return placed.join(names, "root").select("title", "component")


def _of_numbers(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    pairs = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    everyone = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    if nodes is not None:
        everyone = everyone.unionByName(nodes.select(F.col("title").alias("id")))
    placed = everyone.distinct().join(components_of(pairs), "id", "left")
    return placed.select(F.col("id").alias("title"), F.coalesce("root", "id").alias("component"))


def largest_component(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes of the biggest component; the smaller name wins a tie."""
    members = connected_components(edges, nodes)
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.orderBy(F.desc("n"), "component").limit(1).select("component")
    return members.join(F.broadcast(best), "component", "left_semi").select("title")  # one row
