"""Queries of sources, column verbs and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import strings
from kgspark.operators import columns, filters
from kgspark.plans.registry import query
from kgspark.sources import documents, tables
from kgspark.session import scratch_path

TRADE_EDGES_SQL = """
SELECT c_name AS source, s_name AS target, count(*)::DOUBLE AS weight
FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
"""


@query("scan_parquet", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def scan_parquet(t):
    return t.orders.filter("o_totalprice > 400000").select("o_orderkey", "o_custkey", "o_totalprice")


@query("stage_resume", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
def stage_resume(t):
    root = scratch_path(t.spark, "stage")
    make = lambda: t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    tables.stage(t.spark, root, "supplier_counts", make)
    # the second call finds the finished stage and reads it
    return tables.stage(t.spark, root, "supplier_counts", make)


@query("documents_table", "SELECT md5(text) AS id, text, 'document ' || doc_id AS title FROM documents")
def documents_table(t):
    return documents.documents_table(t.documents, "text", F.concat(F.lit("document "), F.col("doc_id").cast("string")))


@query(
    "page_links",
    r"""
SELECT page_id, (i - 1)::INTEGER AS position, links[i] AS href
FROM (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1) AS links FROM pages),
     LATERAL (SELECT unnest(range(1, len(links) + 1)) AS i)
""",
)
def page_links(t):
    return documents.page_links(t.pages)


@query(
    "page_text",
    r"""
WITH plain AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(html,
    '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<!--.*?-->', ' ', 'gs'), '<[^>]+>', ' ', 'g') AS s FROM pages),
unescaped AS (
  SELECT page_id, url, replace(replace(replace(replace(replace(replace(s,
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS s FROM plain)
SELECT page_id, url, regexp_replace(regexp_replace(s, '\s+', ' ', 'g'), '^ | $', '', 'g') AS text FROM unescaped
""",
)
def page_text(t):
    return documents.page_text(t.pages)


@query(
    "docs_top_k_per_source",
    """
SELECT source, doc_id, text, position FROM (
  SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INTEGER AS position FROM documents)
WHERE position <= 5
""",
)
def docs_top_k_per_source(t):
    docs = t.documents.select("source", "doc_id", "text")
    return documents.top_k_per_source(docs, "source", "doc_id", 5).select("source", "doc_id", "text", "position")


@query(
    "docs_combine",
    """
WITH u AS (
  SELECT md5(text) AS id, text, 'document ' || lpad(doc_id::VARCHAR, 12, '0') AS title FROM documents
  UNION ALL SELECT md5(text), text, 'item ' || lpad(item_id::VARCHAR, 12, '0') FROM benchmark)
SELECT id, text, title FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY title) AS rn FROM u) WHERE rn = 1
""",
)
def docs_combine(t):
    numbered = lambda word, c: F.concat(F.lit(word), F.lpad(F.col(c).cast("string"), 12, "0"))
    return documents.combine(
        [
            documents.documents_table(t.documents, "text", numbered("document ", "doc_id")),
            documents.documents_table(t.benchmark, "text", numbered("item ", "item_id")),
        ]
    )


@query("select_columns", "SELECT c_custkey, c_name FROM customer")
def select_columns(t):
    return columns.select(t.customer, ["c_custkey", "c_name"])


@query("rename_columns", "SELECT s_suppkey AS id, s_name AS name, s_nationkey, s_acctbal FROM supplier")
def rename_columns(t):
    return columns.rename(t.supplier, {"s_suppkey": "id", "s_name": "name"})


@query("drop_columns", "SELECT p_partkey, p_name, p_brand, p_type FROM part")
def drop_columns(t):
    return columns.drop(t.part, ["p_size", "p_retailprice"])


@query("copy_column", "SELECT c_custkey, c_name, c_name AS label FROM customer")
def copy_column(t):
    return columns.copy(t.customer.select("c_custkey", "c_name"), "label", "c_name")


@query("fill_constant", "SELECT c_custkey, 'known' AS status FROM customer")
def fill_constant(t):
    return columns.fill(t.customer.select("c_custkey"), "status", "known")


@query(
    "unroll_array",
    """
SELECT o_orderkey, w AS part FROM (SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'P' THEN [NULL] ELSE string_split(o_orderpriority, '-') END AS parts FROM orders),
  LATERAL (SELECT unnest(parts) AS w)
""",
)
def unroll_array(t):
    empty = F.array().cast("array<string>")
    parts = F.when(F.col("o_orderstatus") == "P", empty).otherwise(F.split("o_orderpriority", "-"))
    return columns.unroll(t.orders.select("o_orderkey", parts.alias("part")), "part")


@query("zip_struct", "SELECT s_suppkey, s_suppkey::VARCHAR || '/' || s_name AS pair FROM supplier")
def zip_struct(t):
    zipped = columns.zip_struct(t.supplier.select("s_suppkey", "s_name"), "z", ["s_suppkey", "s_name"])
    return zipped.select("s_suppkey", F.concat(F.col("z.s_suppkey").cast("string"), F.lit("/"), F.col("z.s_name")).alias("pair"))


@query(
    "zip_map",
    """
SELECT p_partkey, CASE WHEN p_type = 'b' THEN p_size::VARCHAR ELSE p_brand END AS first_value, p_size::VARCHAR AS second_value,
       (CASE WHEN p_type = 'size' THEN 1 ELSE 2 END)::INTEGER AS n FROM part
""",
)
def zip_map(t):
    lists = t.part.select(
        "p_partkey",
        F.col("p_type").alias("key"),
        F.array("p_type", F.lit("size")).alias("keys"),
        F.array("p_brand", F.col("p_size").cast("string")).alias("values"),
    )
    zipped = columns.zip_map(lists, "m", "keys", "values")
    return zipped.select(
        "p_partkey", F.element_at("m", F.col("key")).alias("first_value"), F.element_at("m", "size").alias("second_value"), F.size("m").alias("n")
    )


@query("unzip_struct", "SELECT c_custkey, c_name AS name, c_acctbal AS balance FROM customer")
def unzip_struct(t):
    packed = t.customer.select("c_custkey", F.struct("c_name", "c_acctbal").alias("t"))
    return columns.unzip(packed, "t", ["name", "balance"]).drop("t")


_GAPS = "CASE WHEN p_size > 25 THEN p_brand END"


def _gappy_parts(t):
    """Parts with holes in two columns."""
    return t.part.select(
        "p_partkey",
        F.when(F.col("p_size") > 25, F.col("p_brand")).alias("a"),
        F.when(F.col("p_size") < 40, F.col("p_type")).alias("b"),
        "p_retailprice",
    )


_GAPPY = f"(SELECT p_partkey, {_GAPS} AS a, CASE WHEN p_size < 40 THEN p_type END AS b, p_retailprice FROM part)"


@query("merge_first", f"SELECT p_partkey, coalesce(a, b) AS merged FROM {_GAPPY}")
def merge_first(t):
    return columns.merge(_gappy_parts(t).drop("p_retailprice"), "merged", ["a", "b"], "first one wins")


@query("merge_last", f"SELECT p_partkey, coalesce(b, a) AS merged FROM {_GAPPY}")
def merge_last(t):
    return columns.merge(_gappy_parts(t).drop("p_retailprice"), "merged", ["a", "b"], "last one wins")


@query(
    "merge_concat",
    f"""
SELECT p_partkey, concat_ws('; ', a, b, CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR
  ELSE p_retailprice::VARCHAR END) AS merged FROM {_GAPPY}
""",
)
def merge_concat(t):
    return columns.merge(_gappy_parts(t), "merged", ["a", "b", "p_retailprice"], "concat", "; ")


@query("merge_array", f"SELECT p_partkey, concat_ws(',', a, b) AS merged FROM {_GAPPY}")
def merge_array(t):
    return columns.merge(_gappy_parts(t).drop("p_retailprice"), "merged", ["a", "b"], "array")


@query("fill_nulls", f"SELECT p_partkey, coalesce(a, 'No Description') AS a FROM {_GAPPY}")
def fill_nulls(t):
    return columns.fill_null(_gappy_parts(t).select("p_partkey", "a"), {"a": "No Description"})


@query(
    "node_details",
    """
WITH d AS (SELECT l_suppkey, count(*) AS degree FROM lineitem GROUP BY 1)
SELECT s_name AS title, concat_ws(',', s_suppkey::VARCHAR, s_name,
       CASE WHEN s_acctbal > 0 THEN 'nation ' || s_nationkey ELSE 'No Description' END, degree::VARCHAR) AS details
FROM supplier JOIN d ON l_suppkey = s_suppkey
""",
)
def node_details(t):
    degree = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("degree"))
    nodes = t.supplier.join(degree, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_suppkey").alias("human_readable_id"),
        F.col("s_name").alias("title"),
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))).alias("description"),
        "degree",
    )
    d = F.col("node_details")
    return columns.node_details(nodes).select(
        "title", strings.csv_line([d["human_readable_id"], d["title"], d["description"], d["degree"]]).alias("details")
    )


@query(
    "edge_details",
    """
SELECT concat_ws(',', o_orderkey::VARCHAR, c_name, o_orderpriority,
       CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'No Description' END, o_orderstatus) AS details
FROM orders JOIN customer ON o_custkey = c_custkey
""",
)
def edge_details(t):
    edges = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("human_readable_id"),
        F.col("c_name").alias("source"),
        F.col("o_orderpriority").alias("target"),
        F.when(F.col("o_orderstatus") == "F", F.lit("done")).alias("description"),
        F.col("o_orderstatus").alias("rank"),
    )
    d = F.col("edge_details")
    fields = ("human_readable_id", "source", "target", "description", "rank")
    return columns.edge_details(edges).select(strings.csv_line([d[f] for f in fields]).alias("details"))


@query(
    "metrics_unpivot",
    """
SELECT * FROM (SELECT l_returnflag, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount,
  round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY 1)
UNPIVOT (value FOR metric IN (quantity, discount, tax))
""",
)
def metrics_unpivot(t):
    means = t.lineitem.groupBy("l_returnflag").agg(
        F.round(F.avg("l_quantity"), 6).alias("quantity"),
        F.round(F.avg("l_discount"), 6).alias("discount"),
        F.round(F.avg("l_tax"), 6).alias("tax"),
    )
    return columns.unpivot(means, ["l_returnflag"], ["quantity", "discount", "tax"], "metric", "value")


# predicates: (name, table, column, operator, value, strategy, kept columns, SQL condition)
_FILTERS = [
    ("filter_equals", "orders", "o_orderstatus", "equals", "F", "value", ["o_orderkey", "o_orderstatus"], "o_orderstatus = 'F'"),
    ("filter_not_equals", "orders", "o_orderstatus", "is not equal", "F", "value", ["o_orderkey", "o_orderstatus"], "o_orderstatus <> 'F'"),
    ("filter_number_not_equals", "lineitem", "l_linenumber", "!=", 1, "value", ["l_orderkey", "l_linenumber"], "l_linenumber <> 1"),
    ("filter_lt", "lineitem", "l_quantity", "<", 5.0, "value", ["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity < 5"),
    ("filter_lte", "lineitem", "l_quantity", "<=", 5.0, "value", ["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity <= 5"),
    ("filter_gt", "lineitem", "l_quantity", ">", 45.0, "value", ["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity > 45"),
    ("filter_gte", "lineitem", "l_quantity", ">=", 45.0, "value", ["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity >= 45"),
    ("filter_contains", "documents", "text", "contains", "tion", "value", ["doc_id"], "contains(text, 'tion')"),
    ("filter_startswith", "part", "p_name", "starts with", "red", "value", ["p_partkey", "p_name"], "starts_with(p_name, 'red')"),
    ("filter_endswith", "part", "p_name", "ends with", "ring", "value", ["p_partkey", "p_name"], "suffix(p_name, 'ring')"),
    ("filter_regex", "customer", "c_name", "regex", "0[1-3]5", "value", ["c_custkey", "c_name"], "regexp_matches(c_name, '0[1-3]5')"),
]


def _filter_query(name, table, column, operator, value, strategy, keep, condition):
    @query(name, f"SELECT {', '.join(keep)} FROM {table} WHERE {condition}")
    def run(t):
        return filters.filter_rows(getattr(t, table), column, operator, value, strategy).select(*keep)


for _f in _FILTERS:
    _filter_query(*_f)


@query(
    "filter_equals_column",
    "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey = s_nationkey",
)
def filter_equals_column(t):
    joined = t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey"))
    return filters.filter_rows(joined, "c_nationkey", "equals", "s_nationkey", "column").select("c_custkey", "s_suppkey")


@query("filter_is_null", f"SELECT p_partkey, b FROM {_GAPPY} WHERE a IS NULL")
def filter_is_null(t):
    return filters.filter_rows(_gappy_parts(t), "a", "is empty").select("p_partkey", "b")


@query("filter_is_not_null", f"SELECT p_partkey, a FROM {_GAPPY} WHERE a IS NOT NULL")
def filter_is_not_null(t):
    return filters.filter_rows(_gappy_parts(t), "a", "is not empty").select("p_partkey", "a")


@query("filter_is_true", "SELECT doc_id, quality = 1 AS good FROM labels WHERE quality = 1")
def filter_is_true(t):
    return filters.filter_rows(t.labels.select("doc_id", (F.col("quality") == 1).alias("good")), "good", "is true")


@query("filter_is_false", "SELECT doc_id, quality = 1 AS good FROM labels WHERE quality <> 1")
def filter_is_false(t):
    return filters.filter_rows(t.labels.select("doc_id", (F.col("quality") == 1).alias("good")), "good", "is false")


@query(
    "bool_combine",
    """
WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity > 25 AS x, l_discount > 0.05 AS y, l_tax > 0.04 AS z FROM lineitem)
SELECT l_orderkey, l_linenumber, x OR y OR z AS any_of, x AND y AND z AS all_of, NOT (x OR y OR z) AS none_of,
  NOT (x AND y AND z) AS not_all, (x::INT + y::INT + z::INT) % 2 = 1 AS odd, (x::INT + y::INT + z::INT) % 2 = 0 AS even FROM b
""",
)
def bool_combine(t):
    b = [F.col("l_quantity") > 25, F.col("l_discount") > 0.05, F.col("l_tax") > 0.04]
    names = {"any_of": "or", "all_of": "and", "none_of": "nor", "not_all": "nand", "odd": "xor", "even": "xnor"}
    return t.lineitem.select("l_orderkey", "l_linenumber", *[columns.bool_combine(b, op).alias(n) for n, op in names.items()])


def trade_edges(t):
    """Customer–supplier edges with the number of lines between them."""
    return (
        t.orders.select("o_orderkey", "o_custkey")
        .join(t.customer.select("c_custkey", F.col("c_name").alias("source")), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.lineitem.select("l_orderkey", "l_suppkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.supplier.select("s_suppkey", F.col("s_name").alias("target")), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("source", "target")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )


@query(
    "edges_in_nodes",
    f"""
WITH e AS ({TRADE_EDGES_SQL}), n AS (
  SELECT c_name AS title FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT s_name FROM supplier WHERE s_acctbal > 5000)
SELECT source, target, weight FROM e WHERE source IN (SELECT title FROM n) AND target IN (SELECT title FROM n)
""",
)
def edges_in_nodes(t):
    rich = t.customer.filter("c_acctbal > 5000").select(F.col("c_name").alias("title"))
    nodes = rich.unionByName(t.supplier.filter("s_acctbal > 5000").select(F.col("s_name").alias("title")))
    return filters.edges_to_nodes(trade_edges(t), nodes)


@query(
    "claims_in_nodes",
    "SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def claims_in_nodes(t):
    return filters.claims_to_nodes(
        t.events.select("event_id", "user_id", "event_type"), t.customer.filter("c_acctbal > 0"), "user_id", "c_custkey"
    )


@query(
    "edges_no_self_loops",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey <> l_suppkey",
)
def edges_no_self_loops(t):
    return filters.without_self_loops(
        t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_partkey", "l_suppkey"
    )
