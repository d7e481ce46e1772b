"""Queries of graph operators and of the linked output tables.

Two graphs are used: the term graph of ``documents`` and the trade graph, in
which customers and suppliers are nodes, orders are text units, and region,
nation and nation with segment are communities of levels 0, 1 and 2.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import strings
from kgspark.graph import communities as comm
from kgspark.graph import components, degree, merge, tables
from kgspark.graph.hierarchy import community_hierarchy as restore_hierarchy
from kgspark.model import records
from kgspark.operators import order
from kgspark.plans.registry import query
from kgspark.plans.texts import MENTIONS_SQL, mention_records
from kgspark.plans.verbs import TRADE_EDGES_SQL, trade_edges
from kgspark.session import cut, stored
from kgspark.vector import topk

# ---------------------------------------------------------------- trade graph

NODES_SQL = """
SELECT c_name AS title, 'CUSTOMER' AS type, 'balance ' || round(c_acctbal)::BIGINT AS description, c_nationkey AS nation, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_name, 'SUPPLIER', CASE WHEN s_acctbal > 0 THEN 'balance ' || round(s_acctbal)::BIGINT END, s_nationkey, 'SUPPLIER' FROM supplier
"""
MEMBERS_SQL = f"""
SELECT unnest([0, 1, 2]) AS level, title, unnest([r_name, n_name, n_name || '/' || segment]) AS community
FROM ({NODES_SQL}) JOIN nation ON n_nationkey = nation JOIN region ON r_regionkey = n_regionkey
"""
UNITS_SQL = """
SELECT DISTINCT c_name AS source, s_name AS target, 'order ' || o_orderkey AS text_unit_id
FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
"""
TRADE = f"WITH e AS ({TRADE_EDGES_SQL}), n AS ({NODES_SQL}), m AS ({MEMBERS_SQL}), eu AS ({UNITS_SQL}), deg AS (SELECT title, count(*) AS degree FROM (SELECT source AS title FROM e UNION ALL SELECT target FROM e) GROUP BY 1)"
RID = "md5({0}.source || chr(1) || {0}.target)"


def trade_nodes(t):
    balance = lambda c: F.concat(F.lit("balance "), F.round(c).cast("long").cast("string"))
    return t.customer.select(
        F.col("c_name").alias("title"),
        F.lit("CUSTOMER").alias("type"),
        balance("c_acctbal").alias("description"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
    ).unionByName(
        t.supplier.select(
            F.col("s_name").alias("title"),
            F.lit("SUPPLIER").alias("type"),
            F.when(F.col("s_acctbal") > 0, balance("s_acctbal")).alias("description"),
            F.col("s_nationkey").alias("nation"),
            F.lit("SUPPLIER").alias("segment"),
        )
    )


def trade_membership(t):
    placed = trade_nodes(t).join(t.nation, F.col("n_nationkey") == F.col("nation")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    names = F.array("r_name", "n_name", F.concat_ws("/", "n_name", "segment"))
    return placed.select("title", F.posexplode(names).alias("level", "community"))


def _trade_lines(t):
    """o_orderkey, source, target, lying by order, so that no text is shuffled to find repeats within an order."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey").join(
        t.supplier.select("s_suppkey", F.col("s_name").alias("target")), F.col("l_suppkey") == F.col("s_suppkey")
    )
    return (
        t.orders.select("o_orderkey", "o_custkey")
        .join(t.customer.select("c_custkey", F.col("c_name").alias("source")), F.col("o_custkey") == F.col("c_custkey"))
        .join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
        .select("o_orderkey", "source", "target")
    )


def _order_unit():
    return F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("text_unit_id")


def trade_units(t):
    return _trade_lines(t).distinct().select("source", "target", _order_unit())


def trade_node_units(t):
    both = F.explode(F.array("source", "target"))
    return _trade_lines(t).select("o_orderkey", both.alias("title")).distinct().select("title", _order_unit())


def described(edges):
    return edges.withColumn("description", F.concat_ws(" buys from ", "source", "target"))


def described_edges(t):
    return described(trade_edges(t))


# ---------------------------------------------------------------- merging


@query(
    "missing_endpoints",
    f"""{TRADE}, c AS (SELECT * FROM n WHERE type = 'CUSTOMER')
SELECT title, type, description FROM c UNION ALL SELECT DISTINCT title, NULL, NULL FROM (SELECT source AS title FROM e UNION ALL SELECT target FROM e) WHERE title NOT IN (SELECT title FROM c)""",
)
def missing_endpoints(t):
    """Customers, and the suppliers their edges lead to."""
    known = trade_nodes(t).filter("type = 'CUSTOMER'").select("title", "type", "description")
    return merge.with_missing_endpoints(known, trade_edges(t))


@query(
    "merge_nodes",
    MENTIONS_SQL
    + """
SELECT replace(upper(term), 'ẞ', 'SS') AS title, 0::BIGINT AS page, 'TERM' AS type, string_agg(DISTINCT 'seen as ' || term, chr(10) ORDER BY 'seen as ' || term) AS description
FROM w GROUP BY 1
""",
)
def merge_nodes(t):
    mentions = stored(records.entities(mention_records(t), ["doc_id", "chunk_index"]))
    keys = ["doc_id", "chunk_index", "record"]
    return merge.merge_nodes(mentions, keys, {"*": ("replace",), "description": ("concat", "\n")})


@query(
    "merge_edges",
    MENTIONS_SQL
    + """
SELECT least(replace(upper(x), 'ẞ', 'SS'), replace(upper(y), 'ẞ', 'SS')) AS source, greatest(replace(upper(x), 'ẞ', 'SS'), replace(upper(y), 'ẞ', 'SS')) AS target, sum(1.0::DOUBLE) AS weight,
  arg_min(x || ' before ' || y, doc_id * 10000000 + chunk_index * 10000 + i) AS description
FROM pairs GROUP BY 1, 2
""",
)
def merge_edges(t):
    mentions = records.relationships(mention_records(t), ["doc_id", "chunk_index"])
    keys = ["doc_id", "chunk_index", "record"]
    return merge.merge_edges(mentions, keys, {"*": ("skip",), "weight": ("sum",)})


@query(
    "merge_operations",
    """
WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey AS s, CASE WHEN l_tax > 0.02 THEN l_quantity END AS q, 1 + l_discount AS f FROM lineitem)
SELECT l_partkey, arg_max(s, l_orderkey * 1000000 + l_linenumber * 100000 + s) AS last_supplier, arg_min(s, l_orderkey * 1000000 + l_linenumber * 100000 + s) AS first_supplier,
  sum(coalesce(q, 0)) AS total, max(coalesce(q, 0)) AS high, min(coalesce(q, 0)) AS low, round(product(coalesce(f, 1)), 5) AS factor, round(avg(q), 6) AS mean
FROM r GROUP BY 1
""",
)
def merge_operations(t):
    q = F.when(F.col("l_tax") > 0.02, F.col("l_quantity"))
    rows = t.lineitem.select(
        "l_partkey",
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        F.col("l_suppkey").alias("last_supplier"),
        F.col("l_suppkey").alias("first_supplier"),
        q.alias("total"),
        q.alias("high"),
        q.alias("low"),
        (1 + F.col("l_discount")).alias("factor"),
        q.alias("mean"),
    )
    ops = {
        "last_supplier": ("replace",),
        "first_supplier": ("skip",),
        "total": ("sum",),
        "high": ("max",),
        "low": ("min",),
        "factor": ("multiply",),
        "mean": ("average",),
    }
    out = merge.merge_rows(rows, ["l_partkey"], ops, ["l_orderkey", "l_linenumber", "l_suppkey"])
    return out.withColumns({"factor": F.round("factor", 5), "mean": F.round("mean", 6)})


@query(
    "entity_graph",
    MENTIONS_SQL
    + """
, p AS (SELECT *, least(replace(upper(x), 'ẞ', 'SS'), replace(upper(y), 'ẞ', 'SS')) AS source, greatest(replace(upper(x), 'ẞ', 'SS'), replace(upper(y), 'ẞ', 'SS')) AS target FROM pairs)
SELECT source, target, 0::BIGINT AS page, sum(1.0::DOUBLE) / count(DISTINCT doc_id * 100000 + chunk_index) AS per_chunk,
  count(DISTINCT doc_id * 100000 + chunk_index) AS n_chunks FROM p GROUP BY 1, 2
""",
)
def entity_graph(t):
    mentions = records.relationships(mention_records(t), ["doc_id", "chunk_index"])
    unit = (F.col("doc_id") * 100000 + F.col("chunk_index")).cast("string")
    keys = ["doc_id", "chunk_index", "record"]
    ops = {"*": ("skip",), "weight": ("sum",), "source_id": ("concat", ",")}
    merged = merge.merge_edges(stored(mentions.withColumn("source_id", unit)), keys, ops)
    n = F.size(F.split("source_id", ","))
    return merged.select("source", "target", "page", (F.col("weight") / n).alias("per_chunk"), n.cast("long").alias("n_chunks"))


def term_edges(t):
    """Weighted edges of the term graph over full-size chunks."""
    mentions = records.relationships(mention_records(t, 1200, 100), ["doc_id", "chunk_index"])
    return mentions.groupBy("source", "target").agg(F.sum("weight").alias("weight"))


@query(
    "entity_graph_top",
    MENTIONS_SQL.replace("range(0, len(tk), 100)", "range(0, len(tk), 1100)").replace("s // 100", "s // 1100").replace("s + 120]", "s + 1200]")
    + """
, e AS (SELECT DISTINCT least(replace(upper(x), 'ẞ', 'SS'), replace(upper(y), 'ẞ', 'SS')) AS source, greatest(replace(upper(x), 'ẞ', 'SS'), replace(upper(y), 'ẞ', 'SS')) AS target FROM pairs)
SELECT title, count(*) AS degree FROM (SELECT source AS title FROM e UNION ALL SELECT target FROM e) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20
""",
)
def entity_graph_top(t):
    return order.top_k(degree.node_degree(term_edges(t)), [("degree", "desc"), ("title", "asc")], 20)


# ---------------------------------------------------------------- degrees and components


@query("node_degree", f"{TRADE} SELECT title, degree FROM deg")
def node_degree(t):
    return degree.node_degree(trade_edges(t))


@query(
    "edge_combined_degree",
    f"""{TRADE} SELECT source, target, weight, a.degree AS source_degree, b.degree AS target_degree, a.degree + b.degree AS rank
FROM e JOIN deg a ON a.title = source JOIN deg b ON b.title = target""",
)
def edge_combined_degree(t):
    edges = trade_edges(t)
    return degree.edge_combined_degree(edges, degree.node_degree(edges))


@query(
    "k_degree_subgraph",
    """
WITH e AS (SELECT DISTINCT 'd' || doc_id AS source, 't' || md5(text) AS target FROM documents),
d AS (SELECT title, count(*) AS degree FROM (SELECT source AS title FROM e UNION ALL SELECT target FROM e) GROUP BY 1)
SELECT source, target FROM (SELECT source, target FROM e UNION ALL SELECT DISTINCT 'd' || doc_id, 's' || source FROM documents) x
WHERE source IN (SELECT source FROM e) AND target IN (
  SELECT target FROM (SELECT target, count(*) AS n FROM (SELECT source, target FROM e UNION ALL SELECT DISTINCT 'd' || doc_id, 's' || source FROM documents) GROUP BY 1) WHERE n >= 2)
""",
)
def k_degree_subgraph(t):
    return degree.k_degree_subgraph(document_edges(t), 2)


def document_edges(t):
    """Documents to the hash of their text and to their source."""
    doc = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source")
    same = t.documents.select(doc, F.concat(F.lit("t"), F.md5("text")).alias("target"))
    return same.unionByName(t.documents.select(doc, F.concat(F.lit("s"), F.col("source")).alias("target")).distinct())


def forest(t):
    """Customers and suppliers under nations and regions, and documents under their text."""
    key = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    pair = lambda df, a, b: df.select(a.alias("source"), b.alias("target"))
    return (
        pair(t.customer, key("c", "c_custkey"), key("n", "c_nationkey"))
        .unionByName(pair(t.supplier, key("s", "s_suppkey"), key("n", "s_nationkey")))
        .unionByName(pair(t.nation, key("n", "n_nationkey"), key("r", "n_regionkey")))
        .unionByName(pair(t.documents, key("d", "doc_id"), F.concat(F.lit("t"), F.md5("text"))))
    )


@query(
    "connected_components",
    """
WITH c AS (SELECT 'c' || c_custkey AS title, n_regionkey AS g FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 's' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'n' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT DISTINCT 'r' || n_regionkey, n_regionkey FROM nation),
d AS (SELECT 'd' || doc_id AS title, md5(text) AS g FROM documents UNION ALL SELECT DISTINCT 't' || md5(text), md5(text) FROM documents)
SELECT title, min(title) OVER (PARTITION BY g) AS component FROM c UNION ALL SELECT title, min(title) OVER (PARTITION BY g) FROM d
""",
)
def connected_components(t):
    return components.connected_components(forest(t))


@query(
    "largest_component",
    """
WITH c AS (SELECT 'c' || c_custkey AS title, n_regionkey AS g FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 's' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'n' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT DISTINCT 'r' || n_regionkey, n_regionkey FROM nation),
s AS (SELECT g, count(*) AS n, min(title) AS low FROM c GROUP BY 1)
SELECT title FROM c WHERE g = (SELECT g FROM s ORDER BY n DESC, low LIMIT 1)
""",
)
def largest_component(t):
    return components.largest_component(forest(t))


# ---------------------------------------------------------------- communities


@query(
    "stable_edges",
    """
SELECT least(a, b) AS source, greatest(a, b) AS target, sum(w) AS weight FROM (
  SELECT upper('part ' || l_partkey) AS a, upper('supp ' || l_suppkey) AS b, l_quantity AS w FROM lineitem
  UNION ALL SELECT upper('supp ' || l_suppkey), upper('part ' || l_partkey), 1 FROM lineitem) GROUP BY 1, 2
""",
)
def stable_edges(t):
    part = strings.normalize_name(F.concat(F.lit(" part "), F.col("l_partkey").cast("string")))
    supp = strings.normalize_name(F.concat(F.lit("supp "), F.col("l_suppkey").cast("string"), F.lit(" ")))
    there = t.lineitem.select(part.alias("source"), supp.alias("target"), F.col("l_quantity").alias("weight"))
    back = t.lineitem.select(supp.alias("source"), part.alias("target"), F.lit(1.0).alias("weight"))
    return comm.stable_edges(there.unionByName(back))


def _propagation_sql(rounds: int) -> str:
    parts = [
        f"WITH e AS ({TRADE_EDGES_SQL}), b AS (SELECT source AS title, target AS other, weight FROM e UNION ALL SELECT target, source, weight FROM e)",
        "l0 AS (SELECT DISTINCT title, title AS label FROM b)",
    ]
    for i in range(rounds):
        parts.append(
            f"l{i + 1} AS (SELECT title, label FROM (SELECT b.title, l.label, row_number() OVER (PARTITION BY b.title "
            f"ORDER BY sum(weight) DESC, l.label) AS rn FROM b JOIN l{i} l ON l.title = b.other GROUP BY 1, 2) WHERE rn = 1)"
        )
    return ", ".join(parts) + f" SELECT title, label FROM l{rounds}"


@query("label_propagation", _propagation_sql(3))
def label_propagation(t):
    return comm.label_propagation(trade_edges(t), 3)


@query("communities_leiden")
def communities_leiden(t):
    return comm.hierarchical_communities(term_edges(t))


@query("communities_unique", "SELECT 0::BIGINT AS at_two_levels, 0::BIGINT AS at_no_parent, 0::BIGINT AS disconnected, true AS better")
def communities_unique(t):
    """Faults of the hierarchy: a community at two levels, members outside the parent, parts without a path.

    And whether its first level has at least the modularity of label propagation on the same nodes.
    """
    edges = cut(term_edges(t))
    found = cut(comm.detect(edges))
    twice = found.groupBy("community").agg(F.count_distinct("level").alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("at_two_levels"))
    above = found.select(F.col("title"), F.col("community").alias("parent"))
    outside = found.filter("level > 0").join(above, ["title", "parent"], "left_anti").agg(F.count(F.lit(1)).alias("at_no_parent"))
    s = found.select("level", F.col("title").alias("source"), "community")
    e = comm.stable_edges(edges).join(s, "source").join(s.withColumnRenamed("source", "target"), ["level", "community", "target"])
    tag = lambda c: F.concat_ws("\u0001", "level", "community", c)
    parts = components.connected_components(e.select(tag("source").alias("source"), tag("target").alias("target")), found.select(tag("title").alias("title")))
    per = parts.groupBy(F.substring_index("title", "\u0001", 2).alias("c")).agg(F.count_distinct("component").alias("n"))
    split = per.filter("n > 1").agg(F.count(F.lit(1)).alias("disconnected"))
    stable = cut(comm.stable_edges(edges))
    first = found.filter("level = 0").select("title", "community")
    flat = comm.label_propagation(edges).withColumnRenamed("label", "community").join(first.select("title"), "title", "left_semi")
    own = comm.modularity(stable, first)
    better = own.join(F.broadcast(comm.modularity(stable, flat).withColumnRenamed("modularity", "other"))).select(  # one row each
        (F.col("modularity") >= F.col("other")).alias("better")
    )
    return twice.join(F.broadcast(outside)).join(F.broadcast(split)).join(F.broadcast(better))  # one row each


@query(
    "community_hierarchy",
    f"""{TRADE}, sized AS (SELECT level, community, count(*) AS n FROM m GROUP BY 1, 2)
SELECT p.community, p.level, c.community AS sub_community, s.n AS sub_community_size
FROM m p JOIN m c ON c.title = p.title AND c.level = p.level + 1 JOIN sized s ON s.level = c.level AND s.community = c.community
GROUP BY ALL HAVING count(*) = s.n""",
)
def community_hierarchy(t):
    return restore_hierarchy(trade_membership(t))


@query(
    "entity_communities",
    f"{TRADE} SELECT title, string_agg(community, ';' ORDER BY level) AS communities, arg_min(community, level) AS first_community FROM m GROUP BY 1",
)
def entity_communities(t):
    out = tables.entity_communities(trade_membership(t))
    return out.select("title", F.array_join("communities", ";").alias("communities"), "first_community")


# ---------------------------------------------------------------- output tables


@query(
    "level_nodes",
    f"""{TRADE} SELECT title, type, description, level, community, coalesce(degree, 0) AS degree FROM n JOIN m USING (title) LEFT JOIN deg USING (title)""",
)
def level_nodes(t):
    nodes = trade_nodes(t).select("title", "type", "description")
    return tables.level_nodes(nodes, trade_membership(t), trade_edges(t))


@query("level_edges", f"{TRADE} SELECT source, target, weight, unnest([0, 1, 2]) AS level FROM e")
def level_edges(t):
    return tables.level_edges(trade_edges(t), trade_membership(t))


@query(
    "communities_table",
    f"""{TRADE},
links AS (SELECT DISTINCT level, community, source, target FROM m JOIN (SELECT source, target, unnest([source, target]) AS title FROM e) USING (title)),
r AS (SELECT level, community, {RID.format('links')} AS v FROM links),
u AS (SELECT DISTINCT level, community, text_unit_id AS v FROM links JOIN eu USING (source, target)),
x AS (SELECT level, community, 'r' AS k, v, row_number() OVER (PARTITION BY level, community ORDER BY v) AS rn FROM r
  UNION ALL SELECT level, community, 'u', v, row_number() OVER (PARTITION BY level, community ORDER BY v) FROM u)
SELECT community AS id, 'Community ' || community AS title, level, community AS raw_community, (rn - 1) // 5000 AS page,
  count(*) FILTER (k = 'r') AS n_relationships, md5(coalesce(string_agg(v, ',' ORDER BY v) FILTER (k = 'r'), '')) AS relationships_md5,
  count(*) FILTER (k = 'u') AS n_text_units, md5(coalesce(string_agg(v, ',' ORDER BY v) FILTER (k = 'u'), '')) AS text_units_md5
FROM x GROUP BY ALL""",
)
def communities_table(t):
    out = tables.communities_table(trade_edges(t), stored(trade_units(t)), trade_membership(t), page_rows=5000)
    listed = lambda c: F.md5(F.array_join(c, ","))
    return out.select(
        "id",
        "title",
        "level",
        "raw_community",
        "page",
        F.size("relationship_ids").cast("long").alias("n_relationships"),
        listed("relationship_ids").alias("relationships_md5"),
        F.size("text_unit_ids").cast("long").alias("n_text_units"),
        listed("text_unit_ids").alias("text_units_md5"),
    )


@query(
    "entities_table",
    f"""{TRADE}, nu AS (SELECT DISTINCT unnest([source, target]) AS title, text_unit_id FROM eu)
SELECT md5(title) AS id, title AS name, type, description, row_number() OVER (ORDER BY title) - 1 AS human_readable_id,
  concat_ws(':', title, description) AS name_description, 0::BIGINT AS page, u AS text_unit_ids
FROM n LEFT JOIN (SELECT title, string_agg(text_unit_id, ',' ORDER BY text_unit_id) AS u FROM nu GROUP BY 1) USING (title)""",
)
def entities_table(t):
    out = tables.entities_table(trade_nodes(t).select("title", "type", "description"), trade_node_units(t))
    return out.withColumn("text_unit_ids", F.array_join("text_unit_ids", ","))


@query(
    "nodes_table",
    f"""{TRADE} SELECT level, title, type, description, community, coalesce(degree, 0) AS degree, dense_rank() OVER (ORDER BY title) - 1 AS human_readable_id,
  md5(title) AS id, coalesce(degree, 0) AS size, md5(title) AS top_level_node_id, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y
FROM n JOIN m USING (title) LEFT JOIN deg USING (title)""",
)
def nodes_table(t):
    return tables.nodes_table(trade_nodes(t).select("title", "type", "description"), trade_membership(t), trade_edges(t))


@query("projection_spread", "SELECT count(*) AS n, true AS centred, true AS first_is_wider FROM embeddings")
def projection_spread(t):
    """All vectors are placed, and the first component varies most."""
    xy = cut(topk.project_2d(t.embeddings, "vec_id", "embedding"))
    return xy.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.abs(F.corr("x", "y")) < 1e-6, F.lit(False)).alias("centred"),
        (F.var_samp("x") >= F.var_samp("y")).alias("first_is_wider"),
    )


@query(
    "nodes_layout",
    f"""{TRADE} SELECT level, title, community, x, y FROM (SELECT n.title, m.level, m.community, length(n.title)::DOUBLE AS x,
  CASE WHEN type = 'CUSTOMER' THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM n JOIN m USING (title))""",
)
def nodes_layout(t):
    """Positions given from outside, for some of the nodes; the others lie at the origin's line."""
    nodes = trade_nodes(t).select("title", "type", "description")
    layout = nodes.select("title", F.length("title").cast("double").alias("x"), F.when(F.col("type") == "CUSTOMER", 1.0).alias("y"))
    out = tables.nodes_table(nodes, trade_membership(t), trade_edges(t), layout)
    return out.select("level", "title", "community", "x", "y")


@query(
    "level_nodes_vectors",
    f"{TRADE} SELECT level, title, community, CASE WHEN type = 'SUPPLIER' THEN length(title)::DOUBLE END AS first_value FROM n JOIN m USING (title)",
)
def level_nodes_vectors(t):
    """Graph vectors joined to the nodes that have one."""
    nodes = trade_nodes(t).select("title", "type", "description")
    vectors = nodes.filter("type = 'SUPPLIER'").select("title", F.array(F.length("title").cast("double")).alias("graph_embedding"))
    out = tables.level_nodes(nodes, trade_membership(t), trade_edges(t), vectors)
    return out.select("level", "title", "community", F.get("graph_embedding", F.lit(0)).alias("first_value"))


@query(
    "entities_embedded",
    f"""{TRADE} SELECT md5(title) AS id, title AS name, length(concat_ws(':', title, description))::DOUBLE AS first_value FROM n WHERE description IS NOT NULL""",
)
def entities_embedded(t):
    """Entities with the vector of their text; those without one are left out."""
    nodes = trade_nodes(t).select("title", "type", "description")
    made = tables.entities_table(nodes, trade_node_units(t))
    vectors = nodes.filter("description IS NOT NULL").select(
        tables.entity_id(F.col("title")).alias("id"), F.array(F.length(F.concat_ws(":", "title", "description")).cast("double")).alias("vector")
    )
    out = tables.with_embeddings(made, vectors)
    return out.select("id", "name", F.get("description_embedding", F.lit(0)).alias("first_value"))


@query("project_2d")
def project_2d(t):
    return topk.project_2d(t.embeddings, "vec_id", "embedding")


@query(
    "relationships_table",
    f"""{TRADE}, u AS (SELECT source, target, string_agg(text_unit_id, ',' ORDER BY text_unit_id) AS ids FROM eu GROUP BY 1, 2)
SELECT source, target, weight, source || ' buys from ' || target AS description, 0::BIGINT AS page, ids AS text_unit_ids, {RID.format('e')} AS id,
  (row_number() OVER (ORDER BY source, target) - 1)::VARCHAR AS human_readable_id, a.degree AS source_degree, b.degree AS target_degree, a.degree + b.degree AS rank
FROM e JOIN u USING (source, target) JOIN deg a ON a.title = source JOIN deg b ON b.title = target""",
)
def relationships_table(t):
    out = tables.relationships_table(stored(described_edges(t)), stored(trade_units(t)))
    return out.withColumn("text_unit_ids", F.array_join("text_unit_ids", ","))


@query(
    "text_unit_entities",
    f"""{TRADE} SELECT text_unit_id AS id, 0::BIGINT AS page, string_agg(i, ',' ORDER BY i) AS entity_ids FROM (
  SELECT DISTINCT text_unit_id, md5(unnest([source, target])) AS i FROM eu) GROUP BY 1""",
)
def text_unit_entities(t):
    return tables.unit_entities(stored(trade_node_units(t))).withColumn("entity_ids", F.array_join("entity_ids", ","))


@query(
    "text_unit_relationships",
    f"""{TRADE} SELECT text_unit_id AS id, 0::BIGINT AS page, string_agg(i, ',' ORDER BY i) AS relationship_ids FROM (
  SELECT DISTINCT text_unit_id, {RID.format('eu')} AS i FROM eu) GROUP BY 1""",
)
def text_unit_relationships(t):
    return tables.unit_relationships(trade_units(t)).withColumn("relationship_ids", F.array_join("relationship_ids", ","))


@query(
    "final_text_units",
    f"""{TRADE}, a AS (SELECT id, string_agg(i, ',' ORDER BY i) AS entity_ids FROM (SELECT DISTINCT text_unit_id AS id, md5(unnest([source, target])) AS i FROM eu) GROUP BY 1),
b AS (SELECT id, string_agg(i, ',' ORDER BY i) AS relationship_ids FROM (SELECT DISTINCT text_unit_id AS id, {RID.format('eu')} AS i FROM eu) GROUP BY 1)
SELECT 'order ' || o_orderkey AS id, 0::BIGINT AS page, o_orderpriority AS text, 2 AS n_tokens, 'customer ' || o_custkey AS document_ids, entity_ids, relationship_ids
FROM orders LEFT JOIN a ON a.id = 'order ' || o_orderkey LEFT JOIN b ON b.id = 'order ' || o_orderkey""",
)
def final_text_units(t, page_rows=None):
    units, edge_units = trade_text_units(t), stored(trade_units(t))
    node_units = edge_units.select("text_unit_id", F.explode(F.array("source", "target")).alias("title"))
    out = tables.final_text_units(
        units, tables.unit_entities(node_units, page_rows), tables.unit_relationships(edge_units, page_rows)
    )
    return out.withColumns({c: F.array_join(c, ",") for c in ("document_ids", "entity_ids", "relationship_ids")})


def _in_pages(ids: str) -> str:
    return f"SELECT id, (n - 1) // 2 AS page, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM ({ids})) GROUP BY 1, 2"


@query(
    "final_text_units_paged",
    f"""{TRADE}, a AS ({_in_pages("SELECT DISTINCT text_unit_id AS id, md5(unnest([source, target])) AS i FROM eu")}),
b AS ({_in_pages(f"SELECT DISTINCT text_unit_id AS id, {RID.format('eu')} AS i FROM eu")}),
p AS (SELECT id, page FROM a UNION SELECT id, page FROM b)
SELECT 'order ' || o_orderkey AS id, coalesce(p.page, 0)::BIGINT AS page, o_orderpriority AS text, 2 AS n_tokens,
  'customer ' || o_custkey AS document_ids, a.ids AS entity_ids, b.ids AS relationship_ids
FROM orders LEFT JOIN p ON p.id = 'order ' || o_orderkey LEFT JOIN a ON a.id = p.id AND a.page = p.page LEFT JOIN b ON b.id = p.id AND b.page = p.page""",
)
def final_text_units_paged(t):
    # pages of two ids, so that most units have several
    return final_text_units(t, 2)


def trade_text_units(t):
    """Orders as text units of their customers."""
    return t.orders.select(
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("id"),
        F.col("o_orderpriority").alias("chunk"),
        F.lit(2).alias("n_tokens"),
        F.array(F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))).alias("document_ids"),
    )


@query(
    "documents_final",
    """
WITH p AS (SELECT 'customer ' || o_custkey AS id, 'order ' || o_orderkey AS u FROM orders)
SELECT 'customer ' || c_custkey AS id, c_name AS title, c_mktsegment AS raw_content, 0::BIGINT AS page, ids AS text_unit_ids
FROM customer LEFT JOIN (SELECT id, string_agg(u, ',' ORDER BY u) AS ids FROM p GROUP BY 1) x ON x.id = 'customer ' || c_custkey
""",
)
def documents_final(t):
    docs = t.customer.select(
        F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("text"), F.col("c_name").alias("title")
    )
    out = tables.final_documents(docs, trade_text_units(t))
    return out.withColumn("text_unit_ids", F.array_join("text_unit_ids", ","))
