"""Queries of file sources and sinks, adapters, and the chunk dispatcher."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark import schema
from kgspark.plans.registry import query
from kgspark.session import scratch_path
from kgspark.sources import documents, files
from kgspark.text import chunk

_PART = "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double"


@query("scan_csv", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def scan_csv(t):
    """Written as CSV with a header and read back with a schema."""
    path = scratch_path(t.spark, "csv")
    files.write_csv(t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"), path)
    return files.read_csv(t.spark, path, _PART)


@query(
    "scan_csv_multiline",
    "SELECT doc_id, md5(text) AS text_md5 FROM (SELECT doc_id, replace(text, chr(13), '') AS text FROM documents WHERE text <> '')",
)
def scan_csv_multiline(t):
    """Quoted cells with line breaks and quotes."""
    path = scratch_path(t.spark, "csv")
    rows = t.documents.filter("text <> ''").select("doc_id", F.replace("text", F.lit("\r"), F.lit("")).alias("text"))
    files.write_csv(rows, path)
    read = files.read_csv(t.spark, path, "doc_id long, text string", multi_line=True)
    return read.select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "scan_csv_shards",
    "SELECT s_suppkey, s_name, (s_suppkey % 3)::INTEGER AS file_idx FROM supplier",
)
def scan_csv_shards(t):
    """Several files, told apart by the number in their name."""
    folder = scratch_path(t.spark, "shards")
    for k in range(3):
        mine = t.supplier.filter(F.col("s_suppkey") % 3 == k).select("s_suppkey", "s_name")
        files.write_csv(mine, f"{folder}/sheet_{k}.csv")
    # a written file is a folder here, so the number is in the folder's name
    return files.read_csv_shards(t.spark, folder, r"sheet_(\d+)", "s_suppkey long, s_name string")


@query("scan_json_nested", "SELECT c_custkey AS customer, o_orderkey AS id, o_orderstatus AS status FROM orders JOIN customer ON c_custkey = o_custkey")
def scan_json_nested(t):
    """JSON documents with an array of objects, one row per object."""
    path = scratch_path(t.spark, "json")
    own = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    item = F.struct(F.col("c_custkey").alias("customer"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    own.groupBy("c_custkey").agg(F.collect_list(item).alias("articles")).write.json(path)
    fields = "articles array<struct<customer:long,id:long,status:string>>"
    return files.read_nested_json(t.spark, path, "articles", fields)


@query(
    "page_links_class",
    r"""
SELECT page_id, (i - 1)::INTEGER AS position, links[i] AS href
FROM (SELECT page_id, regexp_extract_all(html, '<a href="(/[a-m][^"]*)"', 1) AS links FROM pages), LATERAL (SELECT unnest(range(1, len(links) + 1)) AS i)
""",
)
def page_links_class(t):
    """Anchors of a class only; here those whose path starts with a letter up to m are given it."""
    marked = t.pages.select("page_id", F.regexp_replace("html", r'<a (href="/[a-m])', r'<a class="wide nav" $1').alias("html"))
    return documents.page_links(marked, "nav")


@query(
    "page_links_quotes",
    r"""
SELECT page_id, (i - 1)::INTEGER AS position, links[i] AS href
FROM (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1) AS links FROM pages),
     LATERAL (SELECT unnest(range(1, len(links) + 1)) AS i)
""",
)
def page_links_quotes(t):
    """The same links from pages that quote with apostrophes and break lines inside tags."""
    odd = t.pages.select("page_id", F.regexp_replace("html", r'<a\s([^>]*?)href="([^"\']*)"', "<A\n$1HREF = '$2'").alias("html"))
    return documents.page_links(odd)


@query("chunk_none", "SELECT item_id, text AS chunk, 0 AS chunk_index FROM benchmark")
def chunk_none(t):
    return chunk.chunk(t.benchmark, "text", "none")


@query(
    "chunk_dispatch",
    r"""
WITH s AS (SELECT item_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM benchmark)
SELECT item_id, (i - 1)::INTEGER AS chunk_index, parts[i] AS chunk FROM s, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)
""",
)
def chunk_dispatch(t):
    return chunk.chunk(t.benchmark, "text", "sentence")


def _adapted(df, kind, names, strict):
    """id, how many fields are set, and the reject count of an adapter."""
    good, bad = schema.enforce_schema(df, kind, names, [], strict)
    filled = sum((F.col(f.name).isNotNull().cast("int") for f in kind.fields), F.lit(0))
    return good.select(F.lit("row").alias("kind"), filled.alias("n_fields")).unionByName(
        bad.select(F.lit("reject").alias("kind"), F.lit(0).alias("n_fields"))
    ).groupBy("kind", "n_fields").agg(F.count(F.lit(1)).alias("n"))


@query(
    "typed_adapters",
    """
SELECT 'documents' AS adapter, 'row' AS kind, 2 AS n_fields, count(*) AS n FROM documents WHERE text IS NOT NULL
UNION ALL SELECT 'text_units', 'row', 3, count(*) FROM documents WHERE n_chars <= 2147483647
UNION ALL SELECT 'covariates', 'row', 6, count(*) FROM events
UNION ALL SELECT 'relationships', 'row', 4, count(*) FROM lineitem
UNION ALL SELECT 'communities', 'row', 3, count(*) FROM nation
UNION ALL SELECT 'reports', 'row', 4, count(*) FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%'
UNION ALL SELECT 'reports', 'reject', 0, count(*) FROM orders WHERE NOT (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%')
UNION ALL SELECT 'nodes', 'row', 4, count(*) FROM supplier
""",
)
def typed_adapters(t):
    """One table through each adapter; text that is no number makes a strict report a reject."""
    mark = F.substring("o_orderpriority", 1, 1)
    sources = {
        "documents": (t.documents.select("doc_id", "text"), schema.DOCUMENTS, {"id": "doc_id"}, ["id", "text"]),
        "text_units": (
            t.documents.select("doc_id", "n_chars", F.array(F.col("doc_id")).alias("document_ids")), schema.TEXT_UNITS, {"id": "doc_id", "n_tokens": "n_chars"}, ["n_tokens"],
        ),
        "covariates": (
            t.events, schema.COVARIATES,
            {"id": "event_id", "subject_id": "user_id", "type": "event_type", "object_id": "event_id", "status": "event_type", "start_date": "ts"}, ["id"],
        ),
        "relationships": (
            t.lineitem, schema.RELATIONSHIPS, {"source": "l_suppkey", "target": "l_partkey", "weight": "l_quantity", "description": "l_returnflag"}, ["weight"],
        ),
        "communities": (t.nation, schema.COMMUNITIES, {"id": "n_nationkey", "title": "n_name", "level": "n_regionkey"}, ["level"]),
        "reports": (
            t.orders.withColumn("rank", F.when(mark < "4", mark).otherwise("low")), schema.REPORTS,
            {"id": "o_orderkey", "community": "o_custkey", "title": "o_orderpriority"}, ["rank"],
        ),
        "nodes": (t.supplier, schema.NODES, {"title": "s_name", "id": "s_suppkey", "community": "s_nationkey", "x": "s_acctbal"}, ["x"]),
    }
    out = None
    for name, (df, kind, names, strict) in sources.items():
        part = _adapted(df, kind, names, strict).select(F.lit(name).alias("adapter"), "kind", "n_fields", "n")
        out = part if out is None else out.unionByName(part)
    return out
