"""The linked output tables, built from nodes, edges, memberships and links.

Inputs, all long:
  nodes(title, type, description)            edges(source, target, weight, description)
  node_units(title, text_unit_id)            edge_units(source, target, text_unit_id)
  membership(level, title, community)
Lists are cut into pages (see ``ordered.collect_pages``), since a community or
an entity may touch a third of all text units.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark import config
from kgspark.graph import degree as deg
from kgspark.operators import ordered
from kgspark.session import discard, stored
from kgspark.vector.topk import project_2d


def entity_id(title):
    return F.md5(title)


def relationship_id(source, target):
    return F.md5(F.concat_ws("\u0001", source, target))


def level_nodes(nodes: DataFrame, membership: DataFrame, edges: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """Node attributes at every level, with degree and, if given, a graph vector."""
    out = nodes.join(membership.select("level", "title", "community"), "title", "left")
    out = out.withColumn("level", F.coalesce("level", F.lit(0)))
    out = out.join(deg.node_degree(edges), "title", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    if embeddings is not None:
        out = out.join(embeddings.select("title", "graph_embedding"), "title", "left")
    return out


def level_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges repeated for every level in use."""
    levels = membership.select("level").distinct().agg(F.sort_array(F.collect_list("level")).alias("__levels"))
    # one row with a handful of levels
    return edges.join(F.broadcast(levels)).select(*edges.columns, F.explode("__levels").alias("level"))


def nodes_table(nodes: DataFrame, membership: DataFrame, edges: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """Nodes per level with ids, sizes and positions; positions are those of level 0."""
    human = ordered.row_numbers(nodes.select("title"), "__h", [], ["title"])
    out = level_nodes(nodes, membership, edges).join(human, "title")
    if layout is None:
        out = out.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    else:
        out = out.join(layout.select("title", "x", "y"), "title", "left").na.fill(0.0, ["x", "y"])
    return out.select(
        "level",
        "title",
        "type",
        "description",
        "community",
        "degree",
        (F.col("__h") - 1).alias("human_readable_id"),
        entity_id(F.col("title")).alias("id"),
        F.col("degree").alias("size"),
        entity_id(F.col("title")).alias("top_level_node_id"),
        "x",
        "y",
    )


LAYOUTS = ("zero", "components")


def layout_of(vectors: DataFrame | None, strategy: str = "zero") -> DataFrame | None:
    """title, x, y by the named strategy for ``nodes_table``: none at all, or the two main components of vectors(title, vector)."""
    if strategy not in LAYOUTS:
        raise ValueError(f"unknown layout strategy: {strategy}")
    return None if strategy == "zero" else project_2d(vectors, "title", "vector")


def entities_table(nodes: DataFrame, node_units: DataFrame) -> DataFrame:
    """One entity per name, with its text units in pages."""
    units = node_units.filter(F.col("text_unit_id").isNotNull()).distinct()
    pages = ordered.collect_pages(units, F.col("text_unit_id"), "text_unit_ids", ["title"], ["text_unit_id"])
    human = ordered.row_numbers(nodes.filter(F.col("title").isNotNull()).select("title").distinct(), "__h", [], ["title"])
    base = nodes.filter(F.col("title").isNotNull()).join(human, "title")
    return base.join(pages, "title", "left").select(
        entity_id(F.col("title")).alias("id"),
        F.col("title").alias("name"),
        "type",
        "description",
        (F.col("__h") - 1).alias("human_readable_id"),
        F.concat_ws(":", "title", "description").alias("name_description"),
        F.coalesce("page", F.lit(0).cast("long")).alias("page"),
        "text_unit_ids",
    )


def with_embeddings(entities: DataFrame, vectors: DataFrame) -> DataFrame:
    """Entities with ``description_embedding`` from vectors(id, vector); an entity without one is left out."""
    known = vectors.filter(F.col("vector").isNotNull()).select("id", F.col("vector").alias("description_embedding"))
    return entities.join(known, "id")


def relationships_table(edges: DataFrame, edge_units: DataFrame) -> DataFrame:
    """Edges with combined degree, text ids and their text units in pages."""
    ranked = deg.edge_combined_degree(edges, deg.node_degree(edges))
    human = ordered.row_numbers(edges.select("source", "target"), "__h", [], ["source", "target"])
    keys = ["source", "target"]
    pages = ordered.set_pages(edge_units, ["text_unit_id"], lambda u: u, "text_unit_ids", keys)
    return ranked.join(human, keys).join(pages, keys, "left").select(
        *keys,
        "weight",
        "description",
        F.coalesce("page", F.lit(0).cast("long")).alias("page"),
        "text_unit_ids",
        relationship_id(F.col("source"), F.col("target")).alias("id"),
        (F.col("__h") - 1).cast("string").alias("human_readable_id"),
        "source_degree",
        "target_degree",
        "rank",
    )


def community_links(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """level, community, source, target: every edge with an end in the community, once."""
    m = membership.filter(F.col("community").isNotNull()).select("level", "title", "community")
    ends = edges.select("source", "target", F.explode(F.array_distinct(F.array("source", "target"))).alias("title"))
    return ends.join(m, "title").select("level", "community", "source", "target").distinct()


def communities_table(edges: DataFrame, edge_units: DataFrame, membership: DataFrame, page_rows: int | None = None) -> DataFrame:
    """Communities with the ids of their relationships and text units, in pages."""
    links = stored(community_links(edges, membership))
    # the bytes of an md5 are half of its text, and in the same order
    related = links.select("level", "community", F.unhex(relationship_id(F.col("source"), F.col("target"))).alias("value"))
    units = links.join(edge_units, ["source", "target"]).select("level", "community", F.col("text_unit_id").cast("binary").alias("value")).distinct()
    both = stored(related.withColumn("kind", F.lit("r")).unionByName(units.withColumn("kind", F.lit("u"))))
    discard(links)
    numbered = ordered.row_numbers(both, "__rn", ["level", "community", "kind"], ["value"])

    paged = numbered.withColumn("page", F.floor((F.col("__rn") - 1) / (page_rows or config.PAGE_ROWS)).cast("long"))

    def listed(kind, text):
        return F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("value")))), text)

    return (
        paged.groupBy("level", "community", "page")
        .agg(
            listed("r", lambda v: F.lower(F.hex(v))).alias("relationship_ids"),
            listed("u", lambda v: v.cast("string")).alias("text_unit_ids"),
        )
        .select(
            F.col("community").alias("id"),
            F.concat(F.lit("Community "), F.col("community")).alias("title"),
            "level",
            F.col("community").alias("raw_community"),
            "page",
            "relationship_ids",
            "text_unit_ids",
        )
    )


def unit_entities(node_units: DataFrame, page_rows: int | None = None) -> DataFrame:
    """text unit → ids of its entities, in pages."""
    pages = ordered.set_pages(node_units, ["title"], entity_id, "entity_ids", ["text_unit_id"], page_rows)
    return pages.withColumnRenamed("text_unit_id", "id")


def unit_relationships(edge_units: DataFrame, page_rows: int | None = None) -> DataFrame:
    """text unit → ids of its relationships, in pages."""
    pages = ordered.set_pages(edge_units, ["source", "target"], relationship_id, "relationship_ids", ["text_unit_id"], page_rows)
    return pages.withColumnRenamed("text_unit_id", "id")


def final_text_units(units: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Text units with both id lists, a row for every page that either list has; a unit without lists has page 0."""
    e = entities.select("id", "page", "entity_ids", F.lit(None).cast("array<string>").alias("relationship_ids"))
    r = relationships.select("id", "page", F.lit(None).cast("array<string>").alias("entity_ids"), "relationship_ids")
    # one row of each kind per page at most
    lists = e.unionByName(r).groupBy("id", "page").agg(
        F.max("entity_ids").alias("entity_ids"), F.max("relationship_ids").alias("relationship_ids")
    )
    return units.join(lists, "id", "left").select(
        "id",
        F.coalesce("page", F.lit(0).cast("long")).alias("page"),
        F.col("chunk").alias("text"),
        "n_tokens",
        "document_ids",
        "entity_ids",
        "relationship_ids",
    )


def final_documents(documents: DataFrame, units: DataFrame) -> DataFrame:
    """Documents with the ids of their text units, in pages; a document without units stays."""
    pairs = units.select(F.explode("document_ids").alias("doc"), F.col("id").alias("u"))
    pages = ordered.collect_pages(pairs, F.col("u"), "text_unit_ids", ["doc"], ["u"])
    return documents.join(pages, F.col("id") == F.col("doc"), "left").select(
        "id", "title", F.col("text").alias("raw_content"), F.coalesce("page", F.lit(0).cast("long")).alias("page"), "text_unit_ids"
    )


def entity_communities(membership: DataFrame) -> DataFrame:
    """Communities of an entity from level 0 down (one per level, so a short list) and the first of them."""
    pairs = F.sort_array(F.collect_list(F.struct("level", "community")))
    out = membership.filter(F.col("community").isNotNull()).groupBy("title").agg(pairs.alias("__p"))
    return out.select(
        "title",
        F.transform("__p", lambda p: p["community"]).alias("communities"),
        F.element_at("__p", 1)["community"].alias("first_community"),
    )
