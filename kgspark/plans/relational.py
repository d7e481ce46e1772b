"""Queries of joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import aggregates, ids, joins, order, ordered, sets, windows
from kgspark.plans.registry import query

# ---------------------------------------------------------------- joins


def _custs(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))


def _supps(t):
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))


_C = "(SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance FROM customer)"
_S = "(SELECT s_suppkey AS id, s_nationkey AS nation, s_acctbal AS balance FROM supplier)"
_BOTH = "a.nation AS nation_1, a.balance AS balance_1, b.nation AS nation_2, b.balance AS balance_2"


@query(
    "join_inner",
    """
SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey
""",
)
def join_inner(t):
    left = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return joins.join(left, t.customer.select("c_custkey", "c_name"), ["o_custkey", "c_custkey"], "inner")


@query("join_left", f"SELECT a.id, {_BOTH} FROM {_C} a LEFT JOIN {_S} b ON a.id = b.id")
def join_left(t):
    return joins.join(_custs(t), _supps(t), ["id"], "left outer")


@query("join_right", f"SELECT b.id, {_BOTH} FROM {_C} a RIGHT JOIN (SELECT id * 20 AS id, nation, balance FROM {_S}) b ON a.id = b.id")
def join_right(t):
    return joins.join(_custs(t), _supps(t).withColumn("id", F.col("id") * 20), ["id"], "right outer")


@query(
    "join_full",
    f"SELECT coalesce(a.id, b.id) AS id, {_BOTH} FROM {_C} a FULL JOIN (SELECT id * 20 AS id, nation, balance FROM {_S}) b ON a.id = b.id",
)
def join_full(t):
    return joins.join(_custs(t), _supps(t).withColumn("id", F.col("id") * 20), ["id"], "full outer")


@query("join_cross", "SELECT s_suppkey, r_name FROM supplier, region")
def join_cross(t):
    return joins.join(t.supplier.select("s_suppkey"), t.region.select("r_name"), strategy="cross")


@query("join_anti", f"SELECT * FROM {_C} WHERE nation NOT IN (SELECT nation FROM {_S} WHERE balance > 5000)")
def join_anti(t):
    return joins.join(_custs(t), _supps(t).filter("balance > 5000"), ["nation"], "anti join")


@query("join_semi", f"SELECT * FROM {_C} WHERE nation IN (SELECT nation FROM {_S} WHERE balance > 5000)")
def join_semi(t):
    return joins.join(_custs(t), _supps(t).filter("balance > 5000"), ["nation"], "semi join")


@query(
    "join_natural",
    """
SELECT cust, o_orderkey, c_name FROM (SELECT o_custkey AS cust, o_orderkey FROM orders)
NATURAL JOIN (SELECT c_custkey AS cust, c_name FROM customer)
""",
)
def join_natural(t):
    left = t.orders.select(F.col("o_custkey").alias("cust"), "o_orderkey")
    return joins.join(left, t.customer.select(F.col("c_custkey").alias("cust"), "c_name"))


@query(
    "join_null_safe",
    """
WITH a AS (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_nationkey END AS k FROM supplier),
     b AS (SELECT CASE WHEN n_nationkey > 0 THEN n_nationkey END AS k, n_name FROM nation)
SELECT a.k, s_suppkey, n_name FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k
""",
)
def join_null_safe(t):
    a = t.supplier.select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")).alias("k"))
    b = t.nation.select(F.when(F.col("n_nationkey") > 0, F.col("n_nationkey")).alias("k"), "n_name")
    return joins.join(a, b, ["k"], "inner", null_safe=True)


@query(
    "id_set_diff",
    """
SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)
""",
)
def id_set_diff(t):
    return joins.id_difference(t.documents, t.labels, "doc_id")


# ---------------------------------------------------------------- aggregates

# lineitem with nulls in a value and in a group key
_LINES = """(SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag, l_suppkey,
  CASE WHEN l_discount > 0.02 THEN l_quantity END AS q FROM lineitem)"""


def _lines(t):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"),
        "l_suppkey",
        F.when(F.col("l_discount") > 0.02, F.col("l_quantity")).alias("q"),
    )


def _agg_query(name, operation, sql_expr, keys=("flag",), column="q", rounded=False):
    cols = ", ".join(keys)
    value = f"round({sql_expr}, 6)" if rounded else sql_expr
    where = " AND ".join(f"{k} IS NOT NULL" for k in keys)

    @query(name, f"SELECT {cols}, {value} AS result FROM {_LINES} WHERE {where} GROUP BY {cols}")
    def run(t):
        out = aggregates.aggregate(_lines(t), [{"column": column, "operation": operation, "to": "result"}], list(keys))
        return out.withColumn("result", F.round("result", 6)) if rounded else out


_agg_query("agg_count", "count", "count(q)")
_agg_query("agg_count_distinct", "distinct", "count(DISTINCT q)")
_agg_query("agg_valid", "valid", "count(q)", ("l_suppkey",))
_agg_query("agg_invalid", "invalid", "count(*) FILTER (q IS NULL)")
_agg_query("agg_sum", "sum", "coalesce(sum(q), 0)", ("l_suppkey",))
_agg_query("agg_mean", "mean", "avg(q)", ("l_suppkey",), rounded=True)
_agg_query("agg_median", "median", "median(q)", ("l_suppkey",), rounded=True)
_agg_query("agg_stddev", "stdev", "stddev_samp(q)", ("l_suppkey",), rounded=True)
_agg_query("agg_stddev_pop", "stdevp", "stddev_pop(q)", ("l_suppkey",), rounded=True)
_agg_query("agg_variance", "variance", "var_samp(q)", ("l_suppkey",), rounded=True)


@query(
    "agg_null_groups",
    """
SELECT l_suppkey, median(q) AS mid, min(q) FILTER (n = top) AS often FROM (
  SELECT l_suppkey, q, count(q) OVER (PARTITION BY l_suppkey, q) AS n FROM (SELECT l_suppkey, CASE WHEN l_suppkey % 3 > 0 THEN l_quantity END AS q FROM lineitem))
JOIN (SELECT l_suppkey, max(n) AS top FROM (SELECT l_suppkey, q, count(q) AS n FROM (
  SELECT l_suppkey, CASE WHEN l_suppkey % 3 > 0 THEN l_quantity END AS q FROM lineitem) GROUP BY 1, 2) GROUP BY 1) USING (l_suppkey) GROUP BY 1
""",
)
def agg_null_groups(t):
    """Median and mode, where every third group has nulls only."""
    rows = t.lineitem.select("l_suppkey", F.when(F.col("l_suppkey") % 3 > 0, F.col("l_quantity")).alias("q"))
    items = [{"column": "q", "operation": "median", "to": "mid"}, {"column": "q", "operation": "mode", "to": "often"}]
    return aggregates.aggregate(rows, items, ["l_suppkey"])


@query(
    "agg_product",
    """
SELECT l_orderkey, round(CASE WHEN count(*) = count(d) THEN product(d) END, 6) AS result
FROM (SELECT l_orderkey, CASE WHEN l_tax > 0.01 THEN 1 + l_discount END AS d FROM lineitem) GROUP BY 1
""",
)
def agg_product(t):
    rows = t.lineitem.select("l_orderkey", F.when(F.col("l_tax") > 0.01, 1 + F.col("l_discount")).alias("d"))
    out = aggregates.aggregate(rows, [{"column": "d", "operation": "product", "to": "result"}], ["l_orderkey"])
    return out.withColumn("result", F.round("result", 6))


@query("agg_min_max", f"SELECT flag, min(q) AS low, max(q) AS high FROM {_LINES} WHERE flag IS NOT NULL GROUP BY flag")
def agg_min_max(t):
    specs = [{"column": "q", "operation": "min", "to": "low"}, {"column": "q", "operation": "max", "to": "high"}]
    return aggregates.aggregate(_lines(t), specs, ["flag"])


@query(
    "agg_any",
    """
SELECT o_custkey, arg_min(v, o_orderkey) FILTER (v IS NOT NULL) AS result
FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS v FROM orders) GROUP BY 1
""",
)
def agg_any(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("v"))
    return aggregates.aggregate(rows, [{"column": "v", "operation": "any", "to": "result", "order": ["o_orderkey"]}], ["o_custkey"])


@query(
    "agg_mode",
    f"""
SELECT l_suppkey, q AS result FROM (
  SELECT l_suppkey, q, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, q) AS rn
  FROM {_LINES} WHERE q IS NOT NULL GROUP BY l_suppkey, q) WHERE rn = 1
""",
)
def agg_mode(t):
    return aggregates.aggregate(_lines(t), [{"column": "q", "operation": "mode", "to": "result"}], ["l_suppkey"])


_PAGE = 100


@query(
    "agg_array",
    f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM (
  SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS v FROM orders))
SELECT o_custkey, (rn - 1) // {_PAGE} AS page, string_agg(coalesce(v, 'null'), ',' ORDER BY rn) AS items, count(*) AS n FROM n GROUP BY 1, 2
""",
)
def agg_array(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("v"))
    pages = ordered.collect_pages(rows, F.col("v"), "a", ["o_custkey"], ["o_orderkey"], page_rows=_PAGE)
    return pages.select("o_custkey", "page", F.array_join("a", ",", "null").alias("items"), F.size("a").cast("long").alias("n"))


@query(
    "agg_array_distinct",
    """
WITH f AS (SELECT l_orderkey, v, min(l_linenumber::BIGINT * 1000000000 + l_partkey) AS pos FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0.02 THEN l_suppkey END AS v FROM lineitem) GROUP BY 1, 2)
SELECT l_orderkey, string_agg(coalesce(v::VARCHAR, 'null'), ',' ORDER BY pos, v) AS items FROM f GROUP BY 1
""",
)
def agg_array_distinct(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_discount") > 0.02, F.col("l_suppkey")).alias("v"))
    spec = {"column": "v", "operation": "array_agg_distinct", "to": "a", "order": ["l_linenumber", "l_partkey"]}
    out = aggregates.aggregate(rows, [spec], ["l_orderkey"])
    return out.select("l_orderkey", F.array_join(F.transform("a", lambda x: x.cast("string")), ",", "null").alias("items"))


@query(
    "agg_string_concat",
    "SELECT n_regionkey, 0::BIGINT AS page, string_agg(c_name, ' | ' ORDER BY c_custkey) AS names FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
def agg_string_concat(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "c_custkey", "c_name")
    spec = {"column": "c_name", "operation": "string_concat", "to": "names", "order": ["c_custkey"], "separator": " | "}
    return aggregates.aggregate(rows, [spec], ["n_regionkey"])


@query("agg_global", "SELECT count(o_totalprice) AS n, max(o_totalprice) AS high, count(DISTINCT o_custkey) AS customers FROM orders")
def agg_global(t):
    specs = [
        {"column": "o_totalprice", "operation": "count", "to": "n"},
        {"column": "o_totalprice", "operation": "max", "to": "high"},
        {"column": "o_custkey", "operation": "distinct", "to": "customers"},
    ]
    return aggregates.aggregate(t.orders, specs)


@query(
    "agg_multi_key",
    f"SELECT flag, l_suppkey, count(q) AS n, min(q) AS low FROM {_LINES} WHERE flag IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY 1, 2",
)
def agg_multi_key(t):
    specs = [{"column": "q", "operation": "count", "to": "n"}, {"column": "q", "operation": "min", "to": "low"}]
    return aggregates.aggregate(_lines(t), specs, ["flag", "l_suppkey"])


@query("value_counts", "SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def value_counts(t):
    return aggregates.value_counts(t.events, "event_type")


@query(
    "describe",
    """
SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max,
  round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75 FROM events
""",
)
def describe(t):
    out = aggregates.describe(t.events, "value")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})


@query(
    "outlier_count",
    "SELECT count(*) FILTER (value < 1) AS below, count(*) FILTER (value > 40) AS above, min(value) AS min, max(value) AS max FROM events",
)
def outlier_count(t):
    return aggregates.outlier_count(t.events, "value", 1.0, 40.0)


# ---------------------------------------------------------------- windows


def _window_query(name, operation, sql, column=None, keys=(), order_cols=("event_id",), rounded=False, positional=False):
    @query(name, sql)
    def run(t):
        rows = t.events.select(
            "event_id", "user_id", "ts", F.when(F.col("event_type") != "view", F.col("value")).alias("v")
        )
        out = windows.window(rows, operation, "result", order_cols, column, keys, positional)
        out = out.withColumn("result", F.round("result", 6)) if rounded else out
        return out.select("event_id", "user_id", "v", "result")


_E = "(SELECT event_id, user_id, ts, CASE WHEN event_type <> 'view' THEN value END AS v FROM events)"


def _wsql(expr):
    return f"SELECT event_id, user_id, v, {expr} AS result FROM {_E}"


_window_query("win_row_number", "row_number", _wsql("row_number() OVER (PARTITION BY user_id ORDER BY event_id)"), keys=("user_id",))
_window_query("win_row_number_global", "row_number", _wsql("row_number() OVER (ORDER BY event_id)"), keys=())
_window_query("win_rank", "rank", _wsql("rank() OVER (PARTITION BY user_id ORDER BY v NULLS LAST)"), keys=("user_id",), order_cols=("v",))
_window_query(
    "win_rank_positional",
    "rank",
    _wsql("count(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"),
    column="v",
    keys=("user_id",),
    positional=True,
)
_window_query(
    "win_percent_rank",
    "percent_rank",
    _wsql("round(percent_rank() OVER (ORDER BY v NULLS LAST), 6)"),
    order_cols=("v",),
    rounded=True,
)
_window_query("win_cume_dist", "cume_dist", _wsql("round(cume_dist() OVER (ORDER BY v NULLS LAST), 6)"), order_cols=("v",), rounded=True)
_window_query(
    "win_first_value", "first_value", _wsql("first_value(v) OVER (PARTITION BY user_id ORDER BY event_id)"), column="v", keys=("user_id",)
)
_window_query(
    "win_last_value",
    "last_value",
    _wsql("last_value(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    column="v",
    keys=("user_id",),
)
_window_query(
    "win_fill_down",
    "fill_down",
    _wsql("last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"),
    column="v",
    keys=("user_id",),
)
_window_query(
    "win_fill_up",
    "fill_up",
    _wsql("first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
    column="v",
)


@query("win_uuid", "SELECT event_id, md5(user_id::VARCHAR || chr(1) || event_id::VARCHAR) AS id FROM events")
def win_uuid(t):
    return windows.window(t.events.select("event_id", "user_id"), "uuid", "id", ["event_id"], keys=["user_id"]).select("event_id", "id")


@query("genid_increment", "SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_name) AS id FROM customer")
def genid_increment(t):
    return ids.gen_id(t.customer.select("c_custkey", "c_name"), "id", "increment", order=["c_name"])


@query("genid_md5", "SELECT p_partkey, md5(p_name || chr(1) || p_brand || chr(1) || p_size) AS id FROM part")
def genid_md5(t):
    return ids.gen_id(t.part, "id", hash=["p_name", "p_brand", "p_size"]).select("p_partkey", "id")


# ---------------------------------------------------------------- sorts and limits


@query(
    "order_by",
    """
SELECT o_orderkey, o_orderpriority, o_totalprice,
  row_number() OVER (ORDER BY o_orderpriority ASC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey) AS position FROM orders
""",
)
def order_by(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    keys = [("o_orderpriority", "asc"), ("o_totalprice", "desc"), ("o_orderkey", "asc")]
    return order.numbered(rows, keys, "position")


@query(
    "top_degree",
    "SELECT l_partkey, count(*) AS degree FROM lineitem GROUP BY 1 ORDER BY degree DESC, l_partkey LIMIT 20",
)
def top_degree(t):
    degrees = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("degree"))
    return order.top_k(degrees, [("degree", "desc"), ("l_partkey", "asc")], 20)


@query("last_row", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 1")
def last_row(t):
    return order.top_k(t.events.select("event_id", "user_id", "event_type"), [("event_id", "desc")], 1)


@query("levels_desc", "SELECT DISTINCT l_linenumber AS level FROM lineitem ORDER BY 1 DESC")
def levels_desc(t):
    return order.distinct_levels(t.lineitem.select(F.col("l_linenumber").alias("level"))).orderBy(F.col("level").desc())


@query(
    "seeded_shuffle",
    "SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '|86'), doc_id) AS position FROM documents",
)
def seeded_shuffle(t):
    keyed = order.seeded_order(t.documents.select("doc_id"), "doc_id")
    return order.numbered(keyed, [("shuffle_key", "asc"), ("doc_id", "asc")], "position").select("doc_id", "position")


# ---------------------------------------------------------------- set operations


@query(
    "union_by_name",
    """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier
""",
)
def union_by_name(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return sets.union(a, t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")))


@query(
    "dedupe_columns",
    """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1
""",
)
def dedupe_columns(t):
    return sets.dedupe(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [("o_orderkey", "asc")])


@query("dedupe_rows", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def dedupe_rows(t):
    return t.lineitem.select("l_partkey", "l_suppkey").distinct()


@query(
    "merge_shards",
    """
WITH u AS (SELECT o_orderkey AS id, 'done' AS state, 0 AS shard FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey, 'open or late', 1 FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT o_orderkey, 'any', 2 FROM orders)
SELECT id, state, row_number() OVER (ORDER BY id) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY shard) AS rn FROM u) WHERE rn = 1
""",
)
def merge_shards(t):
    part = lambda df, s: df.select(F.col("o_orderkey").alias("id"), F.lit(s).alias("state"))
    shards = [
        part(t.orders.filter("o_orderstatus = 'F'"), "done"),
        part(t.orders.filter("o_orderstatus <> 'P'"), "open or late"),
        part(t.orders, "any"),
    ]
    return order.numbered(sets.merge_shards(shards, "id"), [("id", "asc")], "position")
