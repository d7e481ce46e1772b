"""Queries of community contexts, reports, conversations, search and vectors."""

from __future__ import annotations

import collections
import hashlib

from pyspark.sql import functions as F

from kgspark import config, schema
from kgspark.context import conversation, local, mixed, reports, search
from kgspark.graph import degree
from kgspark.graph.hierarchy import community_hierarchy
from kgspark.model import offline
from kgspark.operators import ordered
from kgspark.plans.graphs import TRADE, described, described_edges, trade_membership, trade_node_units, trade_nodes
from kgspark.plans.registry import query
from kgspark.plans.texts import _TOKENS_SQL, walk_sql
from kgspark.plans.verbs import trade_edges
from kgspark.session import cut, discard, scratch_path, spread, stored
from kgspark.text import chunk
from kgspark.vector import embed, ivf, topk

# ---------------------------------------------------------------- community contexts

_N = _TOKENS_SQL  # token list of an expression
CTX = f"""{TRADE},
ed AS (SELECT row_number() OVER (ORDER BY source, target) - 1 AS edge_id, source, target, source || ' buys from ' || target AS description, a.degree + b.degree AS rank
  FROM e JOIN deg a ON a.title = source JOIN deg b ON b.title = target),
nd AS (SELECT level, community, title, dense_rank() OVER (ORDER BY title) - 1 AS hid, coalesce(description, 'No Description') AS description, coalesce(degree, 0) AS degree
  FROM n JOIN m USING (title) LEFT JOIN deg USING (title)),
tc AS (SELECT DISTINCT level, community, edge_id, source, target, x.description, rank
  FROM (SELECT *, unnest([source, target]) AS title FROM ed) x JOIN nd USING (title)),
st AS (SELECT *, row_number() OVER (PARTITION BY level, community ORDER BY rank DESC, edge_id) AS step FROM tc),
us AS (SELECT level, community, title, min(u) AS use FROM (SELECT level, community, source AS title, step * 2 AS u FROM st
  UNION ALL SELECT level, community, target, step * 2 + 1 FROM st) GROUP BY ALL),
it AS (SELECT level, community, step, step * 2 AS use, 'edge' AS kind, concat_ws(',', edge_id, source, target, description, rank) AS line FROM st
  UNION ALL SELECT level, community, use // 2, use, 'node', concat_ws(',', hid, title, description, degree) FROM us JOIN nd USING (level, community, title)),
ti AS (SELECT *, len({_N.format('line')}) AS tokens FROM it),
sz AS (SELECT level, community, sum(tokens)::BIGINT + {local.HEAD_TOKENS} AS context_size FROM ti GROUP BY ALL),
ps AS (SELECT level, community, step, sum(tokens) OVER (PARTITION BY level, community ORDER BY step) AS running
  FROM (SELECT level, community, step, sum(tokens) AS tokens FROM ti GROUP BY ALL)),
kp AS (SELECT level, community, max(step) AS last_step FROM ps WHERE running + {local.HEAD_TOKENS} <= {config.REPORT_CONTEXT_TOKENS} GROUP BY ALL),
tr AS (SELECT ti.* FROM ti JOIN kp USING (level, community) WHERE step <= last_step)
"""


def render_sql(source: str, keys: str) -> str:
    """Context text from lines of node and edge kind."""

    def part(kind):
        mark, head = local.SECTIONS[kind]
        lines = f"string_agg(line, chr(10) ORDER BY use, line) FILTER (kind = '{kind}')"
        return f"'{mark}' || chr(10) || '{head}' || chr(10) || {lines} || chr(10)"

    inner = f"SELECT DISTINCT {keys}, kind, first_value(use) OVER (PARTITION BY {keys}, kind, line ORDER BY use) AS use, line FROM {source}"
    return f"SELECT {keys}, concat_ws(chr(10), {part('report')}, {part('node')}, {part('edge')}) AS context_string FROM ({inner}) GROUP BY {keys}"


def trade_context(t):
    """(nodes per level, edges with rank) of the trade graph, as contexts want them."""
    edges = stored(trade_edges(t).select("source", "target"))
    degrees = stored(degree.node_degree(edges))
    titles = stored(trade_nodes(t).select("title", "description"))
    human = ordered.row_numbers(titles.select("title"), "__h", [], ["title"])
    about = titles.join(degrees, "title", "left").join(human, "title")
    nodes = stored(about.join(trade_membership(t), "title").select(
        "level", "community", "title", (F.col("__h") - 1).alias("human_readable_id"), "description", F.coalesce("degree", F.lit(0).cast("long")).alias("degree")
    ))
    ranked = stored(degree.edge_combined_degree(edges, degrees).select("source", "target", "rank"))
    numbered = ordered.row_numbers(ranked, "__h", [], ["source", "target"]).withColumn("human_readable_id", F.col("__h") - 1)
    # the text of an edge is its two names, so it is made when these have come to rest
    final = stored(described(numbered).select("human_readable_id", "source", "target", "description", "rank"))
    discard(edges, degrees, titles, ranked)
    return nodes, final


def trade_items(t):
    """(items, lines) of the trade graph."""
    nodes, edges = trade_context(t)
    lines = stored(local.context_lines(nodes, edges))
    return local.context_items(nodes, edges, lines), lines


def budget_items(t, max_tokens=config.REPORT_CONTEXT_TOKENS):
    """(items within a budget, lines, sizes of the whole contexts) of the trade graph."""
    nodes, edges = trade_context(t)
    lines = stored(local.context_lines(nodes, edges))
    items = stored(local.context_items(nodes, edges, lines, max_tokens=max_tokens))
    return items, lines, stored(local.full_sizes(nodes, edges, lines, max_tokens=max_tokens))


@query(
    "local_context",
    f"""{CTX}, rd AS ({render_sql('tr', 'level, community')})
SELECT level, community, context_size, context_size > {config.REPORT_CONTEXT_TOKENS} AS context_exceed_limit, md5(coalesce(context_string, '')) AS context_md5
FROM sz LEFT JOIN rd USING (level, community)""",
)
def local_context(t):
    items, lines, sizes = budget_items(t)
    out = local.local_context(items, lines, sizes=sizes)
    return out.select("level", "community", "context_size", "context_exceed_limit", F.md5("context_string").alias("context_md5"))


@query("context_lines", f"{CTX} SELECT level, community, step, kind, line FROM ti")
def context_lines(t):
    return local.with_lines(*trade_items(t)).select("level", "community", "step", "kind", "line")


@query("context_string", f"{CTX}, rd AS ({render_sql('tr', 'level, community')}) SELECT level, community, context_string FROM rd JOIN sz USING (level, community) WHERE context_size <= {config.REPORT_CONTEXT_TOKENS}")
def context_string(t):
    items, lines, sizes = budget_items(t)
    out = local.local_context(items, lines, sizes=sizes)
    return out.filter("NOT context_exceed_limit").select("level", "community", "context_string")


@query("context_trim", f"{CTX} SELECT level, community, max(step) AS last_step, sum(tokens)::BIGINT AS tokens, count(*) AS lines FROM tr GROUP BY ALL")
def context_trim(t):
    kept = local.trimmed_items(stored(trade_items(t)[0]))
    return kept.groupBy("level", "community").agg(
        F.max("step").alias("last_step"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("lines")
    )


@query("context_size", f"{CTX} SELECT level, community, context_size, context_size > 16000 AS context_exceed_limit FROM sz")
def context_size(t):
    return local.context_sizes(trade_items(t)[0])


def _stand_in_reports(t, *levels):
    """Reports of the communities of some levels except those of suppliers."""
    m = trade_membership(t).filter(F.col("level").isin(*levels)).groupBy("level", "community").agg(F.count(F.lit(1)).alias("n"))
    return m.filter(~F.col("community").endswith("SUPPLIER")).select(
        "level", "community", F.concat(F.lit("report with "), F.col("n").cast("string"), F.lit(" members")).alias("full_content")
    )


def _subs_sql(level: int, budget: int, mark: str = "") -> str:
    """Sub-communities of one level, and what is taken of each within a budget."""
    head = local.HEAD_TOKENS + local.REPORT_HEAD_TOKENS
    return f"""
rp{mark} AS (SELECT level, community, 'report with ' || count(*) || ' members' AS full_content FROM m WHERE level = {level + 1} AND community NOT LIKE '%SUPPLIER' GROUP BY 1, 2),
hi{mark} AS (SELECT DISTINCT p.community, c.community AS sub_community FROM m p JOIN m c ON c.title = p.title AND p.level = {level} AND c.level = {level + 1}),
sb{mark} AS (SELECT h.community, h.sub_community, context_size AS local_size, len({_N.format("h.sub_community || ',' || full_content")})::BIGINT AS report_size, full_content
  FROM hi{mark} h JOIN sz ON sz.level = {level + 1} AND sz.community = h.sub_community LEFT JOIN rp{mark} r ON r.community = h.sub_community),
o{mark} AS (SELECT *, row_number() OVER w AS k, sum(coalesce(report_size, 0)) OVER w AS rs,
    sum(CASE WHEN report_size IS NULL THEN 0 ELSE local_size END) OVER (PARTITION BY community) AS lt,
    sum(CASE WHEN report_size IS NULL THEN 0 ELSE local_size END) OVER w AS ls,
    sum(CASE WHEN report_size IS NULL THEN local_size ELSE 0 END) OVER (PARTITION BY community) AS ta
  FROM sb{mark} WINDOW w AS (PARTITION BY community ORDER BY local_size DESC, sub_community ROWS UNBOUNDED PRECEDING)),
c{mark} AS (SELECT community, min(k) FILTER (report_size IS NOT NULL AND rs + lt - ls + ta + {head} <= {budget}) AS ck FROM o{mark} GROUP BY 1),
ch{mark} AS (SELECT o.*, CASE WHEN ck IS NOT NULL THEN CASE WHEN report_size IS NOT NULL AND k <= ck THEN 'report' ELSE 'local' END
  WHEN report_size IS NOT NULL AND rs + {local.REPORT_HEAD_TOKENS + 1} <= {budget} THEN 'report' ELSE 'drop' END AS how FROM o{mark} o JOIN c{mark} USING (community)),
ml{mark} AS (SELECT community, k AS use, 'report' AS kind, sub_community || ',' || full_content AS line FROM ch{mark} WHERE how = 'report'
  UNION ALL SELECT h.community, ti.use, kind, line FROM ch{mark} h JOIN ti ON ti.level = {level + 1} AND ti.community = h.sub_community WHERE how = 'local')
"""


_MIX = _subs_sql(1, 6000)


@query("sub_contexts", f"{CTX}, {_MIX} SELECT community, sub_community, local_size, report_size, full_content FROM sb")
def sub_contexts(t):
    return _subs(t, local.context_sizes(trade_items(t)[0])).drop("report_line")


def _subs(t, sizes):
    hierarchy = community_hierarchy(trade_membership(t))
    return mixed.sub_contexts(hierarchy, sizes, _stand_in_reports(t, 2), 1)


@query("mixed_choice", f"{CTX}, {_MIX} SELECT community, sub_community, k, how FROM ch")
def mixed_choice(t):
    subs = _subs(t, local.context_sizes(trade_items(t)[0]))
    return mixed.mixed_choice(subs, 6000).select("community", "sub_community", "k", F.col("use").alias("how"))


@query(
    "mixed_context",
    f"{CTX}, {_MIX}, rd AS ({render_sql('ml', 'community')}) SELECT community, md5(context_string) AS context_md5 FROM rd",
)
def mixed_context(t):
    items, lines, sizes = budget_items(t, 6000)
    subs = _subs(t, sizes)
    return mixed.mixed_context(subs, items, lines, 1, 6000).select("community", F.md5("context_string").alias("context_md5"))


# small enough that the upper levels are mixed
LEVEL_TOKENS = 6000


@query(
    "level_contexts",
    f"""{CTX.replace(str(config.REPORT_CONTEXT_TOKENS), str(LEVEL_TOKENS))}, {_subs_sql(0, LEVEL_TOKENS, '0')}, {_subs_sql(1, LEVEL_TOKENS, '1')},
rd AS ({render_sql('tr', 'level, community')}), rd0 AS ({render_sql('ml0', 'community')}), rd1 AS ({render_sql('ml1', 'community')}),
mx AS (SELECT 0 AS level, * FROM rd0 UNION ALL SELECT 1, * FROM rd1)
SELECT level, community, md5(coalesce(CASE WHEN context_size > {LEVEL_TOKENS} THEN mx.context_string END, rd.context_string, '')) AS context_md5,
  context_size > {LEVEL_TOKENS} AND mx.context_string IS NOT NULL AS mixed
FROM sz LEFT JOIN rd USING (level, community) LEFT JOIN mx USING (level, community)""",
)
def level_contexts(t):
    """All levels, each with the reports of the levels below."""
    items, lines, sizes = budget_items(t, LEVEL_TOKENS)
    hierarchy, reported = cut(community_hierarchy(trade_membership(t))), cut(_stand_in_reports(t, 1, 2))
    out = None
    for level in (2, 1, 0):
        at = mixed.level_contexts(items, lines, sizes, hierarchy, reported, level, LEVEL_TOKENS)
        part = at.select(F.lit(level).alias("level"), "community", F.md5("context_string").alias("context_md5"), "mixed")
        out = part if out is None else out.unionByName(part)
    return out


def _report_answers(t):
    """Answers for customers: readable with object or text findings, or not readable."""
    name = F.col("c_name")
    good = F.concat(
        F.lit('```json\n{"title": "'), name, F.lit('", "summary": "sum", "rating": 7.5, "rating_explanation": "why",\n"findings": [{"summary": "first", "explanation": "more"}, "only text",]}\n```')
    )
    bare = F.concat(F.lit('{"summary": "of '), name, F.lit('", "rating": "high"}'))
    output = F.when(F.col("c_mktsegment") == "BUILDING", "no report").when(F.col("c_mktsegment") == "MACHINERY", bare).otherwise(good)
    return t.customer.select(F.lit(1).alias("level"), F.col("c_custkey").cast("string").alias("community"), output.alias("output"))


_REPORTS_SQL = """
SELECT 1 AS level, c_custkey::VARCHAR AS community, CASE WHEN bare THEN 'Community Report: ' || c_custkey ELSE c_name END AS title,
  CASE WHEN bare THEN 'of ' || c_name ELSE 'sum' END AS summary, CASE WHEN bare THEN -1.0 ELSE 7.5 END::DOUBLE AS rank,
  CASE WHEN bare THEN '' ELSE 'why' END AS rank_explanation, CASE WHEN bare THEN 0 ELSE 2 END AS n_findings, bare
FROM (SELECT *, c_mktsegment = 'MACHINERY' AS bare FROM customer WHERE c_mktsegment <> 'BUILDING')
"""


@query("report_rows", f"SELECT level, community, title, summary, rank, rank_explanation, n_findings::INTEGER AS n_findings, md5('1' || chr(1) || community) AS id FROM ({_REPORTS_SQL})")
def report_rows(t):
    out = reports.report_rows(_report_answers(t))
    n = F.when(F.col("findings").isNull(), 0).otherwise(F.size("findings"))
    return out.select("level", "community", "title", "summary", "rank", "rank_explanation", n.alias("n_findings"), "id")


@query(
    "report_text",
    f"""SELECT community, '# ' || title || chr(10) || chr(10) || summary || chr(10) || chr(10) || CASE WHEN bare THEN '' ELSE
 '## first' || chr(10) || chr(10) || 'more' || chr(10) || chr(10) || '## only text' || chr(10) || chr(10) END AS full_content FROM ({_REPORTS_SQL})""",
)
def report_text(t):
    return reports.report_rows(_report_answers(t)).select("community", "full_content")


def _report_fn(texts, attempt):
    return offline.report(texts)


@query("report_rejects", f"{TRADE} SELECT DISTINCT level, community FROM m WHERE community IS NOT NULL")
def report_rejects(t):
    """With a model that never answers, every community is a reject."""
    nodes, edges = trade_context(t)[:2]
    made = reports.community_reports(nodes, edges, lambda texts, attempt: ["no" for _ in texts], attempts=1)
    return reports.report_rejects(nodes, made).select("level", "community")


@query("community_reports")
def community_reports(t):
    return reports.community_reports(*trade_context(t), _report_fn).drop("findings")


# ---------------------------------------------------------------- conversations


@query("conv_roles", "SELECT role, count(*) AS n FROM conversations GROUP BY 1")
def conv_roles(t):
    return conversation.checked_roles(t.conversations).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


_QA = """
o AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS qa_id FROM conversations),
qa AS (SELECT conv_id, qa_id, max(text) FILTER (role = 'user') AS question, string_agg(text, chr(10) ORDER BY turn) FILTER (role <> 'user') AS answer
  FROM o WHERE qa_id > 0 GROUP BY 1, 2)
"""


@query("qa_turns", f"WITH {_QA} SELECT conv_id, qa_id, question, answer FROM qa")
def qa_turns(t):
    return conversation.qa_turns(t.conversations)


@query(
    "last_user_turns",
    """
SELECT conv_id, turn, text, position FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INTEGER AS position
  FROM conversations WHERE role = 'user') WHERE position <= 2
""",
)
def last_user_turns(t):
    return conversation.last_user_turns(t.conversations, 2).select("conv_id", "turn", "text", "position")


def _conv_sql(with_answers: bool, recent: bool, turns: int | None, tokens: int) -> str:
    quoted = lambda c: f"CASE WHEN regexp_matches({c}, '[|\"\\r\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"
    line = f"'user|' || {quoted('question')}"
    if with_answers:
        line += f" || CASE WHEN answer IS NULL THEN '' ELSE chr(10) || 'assistant|' || {quoted('answer')} END"
    cut_off = f"WHERE rn <= {turns}" if turns else ""
    return f"""WITH {_QA},
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY qa_id {'DESC' if recent else 'ASC'}) AS rn FROM qa),
l AS (SELECT conv_id, rn, {line} AS lines FROM r {cut_off}),
s AS (SELECT conv_id, rn, lines, sum(len({_N.format('lines')})) OVER (PARTITION BY conv_id ORDER BY rn) AS total FROM l)
SELECT conv_id, '-----Conversation History-----' || chr(10) || 'turn|content' || chr(10) || string_agg(lines, chr(10) ORDER BY rn) || chr(10) AS context,
  count(*)::INTEGER AS qa_turns FROM s WHERE total + 4 <= {tokens} GROUP BY 1"""


@query("conv_context", _conv_sql(False, True, 5, 8000))
def conv_context(t):
    return conversation.conversation_context(t.conversations)


@query("conv_budget", _conv_sql(True, False, None, 120))
def conv_budget(t):
    return conversation.conversation_context(t.conversations, False, None, 120, False)


# ---------------------------------------------------------------- search


def _trade_reports(t):
    """A report per community of the trade graph, ranked by its members."""
    sized = trade_membership(t).groupBy("level", "community").agg(F.count(F.lit(1)).alias("n"))
    return sized.select(
        "level", "community", F.concat(F.lit("About "), F.col("community")).alias("title"), F.col("n").cast("double").alias("rank")
    )


_RP = "rp AS (SELECT level, community, 'About ' || community AS title, count(*)::DOUBLE AS rank FROM m GROUP BY 1, 2)"


def _sparse_membership(t):
    """Memberships in which suppliers stop at level 1."""
    return trade_membership(t).filter((F.col("level") < 2) | ~F.col("community").endswith("SUPPLIER"))


_SM = "sm AS (SELECT * FROM m WHERE level < 2 OR community NOT LIKE '%SUPPLIER')"


@query(
    "reports_in_scope",
    f"""{TRADE}, {_RP}, {_SM}, d AS (SELECT title, arg_max(community, level) AS community, max(level) AS level FROM sm WHERE level <= 2 GROUP BY 1)
SELECT level, community, title, rank FROM rp WHERE level <= 2 AND (level, community) IN (SELECT level, community FROM d)""",
)
def reports_in_scope(t):
    return search.reports_in_scope(_trade_reports(t), _sparse_membership(t), 2).select("level", "community", "title", "rank")


@query(
    "entities_in_scope",
    f"""{TRADE}, {_SM} SELECT n.title AS name, coalesce(degree, 0) AS rank, arg_max(community, level) AS community, any_value(type) AS type
FROM n JOIN sm USING (title) LEFT JOIN deg USING (title) WHERE level <= 2 GROUP BY 1, 2""",
)
def entities_in_scope(t):
    nodes = _sparse_membership(t).join(degree.node_degree(described_edges(t)), "title", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    return search.entities_in_scope(nodes, trade_nodes(t).select(F.col("title").alias("name"), "type"), 2).select("name", "rank", "community", "type")


@query(
    "typed_adapter",
    """
SELECT 'ok' AS part, p_partkey::VARCHAR AS id, p_name AS name, CASE WHEN p_size > 10 THEN p_size::BIGINT END AS human_readable_id, p_brand AS brand
FROM part WHERE p_size > 10 UNION ALL SELECT 'reject', p_partkey::VARCHAR, p_name, NULL, p_brand FROM part WHERE p_size <= 10
""",
)
def typed_adapter(t):
    raw = t.part.select("p_partkey", "p_name", "p_brand", F.when(F.col("p_size") > 10, F.col("p_size").cast("string")).otherwise("small").alias("short"))
    names = {"id": "p_partkey", "name": "p_name", "human_readable_id": "short"}
    rows, rejects = schema.enforce_schema(raw, schema.ENTITIES, names, ["p_brand"], ["human_readable_id"])
    good = rows.select(F.lit("ok").alias("part"), "id", "name", "human_readable_id", F.col("attributes")["p_brand"].alias("brand"))
    bad = rejects.select(
        F.lit("reject").alias("part"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"),
        F.lit(None).cast("long").alias("human_readable_id"), F.col("p_brand").alias("brand"),
    )
    return good.unionByName(bad)


@query(
    "community_weights",
    f"""{TRADE}, nu AS (SELECT DISTINCT unnest([source, target]) AS title, text_unit_id FROM eu),
w AS (SELECT community, count(DISTINCT text_unit_id) AS weight FROM m JOIN nu USING (title) GROUP BY 1)
SELECT community, round(weight / max(weight) OVER (), 9) AS weight FROM w""",
)
def community_weights(t):
    links = trade_membership(t).join(trade_node_units(t), "title").select("community", "text_unit_id")
    return search.community_weights(links).withColumn("weight", F.round("weight", 9))


@query(
    "report_select",
    """SELECT doc_id, md5(doc_id::VARCHAR || '|86') AS shuffle_key FROM labels WHERE quality >= 1""",
)
def report_select(t):
    ranked = t.labels.select("doc_id", F.when(F.col("toxic") == 0, F.col("quality")).otherwise(F.col("quality")).alias("rank"))
    return search.select_reports(ranked, 0, key="doc_id").select("doc_id", "shuffle_key")


_REPORT_ITEMS = f"""
SELECT *, row_number() OVER (PARTITION BY source ORDER BY sk, id) AS rn FROM (
  SELECT source, doc_id::VARCHAR AS id, md5(doc_id::VARCHAR || '|86') AS sk, n_chars AS weight, 1 + doc_id % 3 AS rank,
    concat_ws('|', doc_id, 'document ' || doc_id, n_chars, text, 1 + doc_id % 3) AS line,
    len({_N.format("concat_ws('|', doc_id, 'document ' || doc_id, n_chars, text, 1 + doc_id % 3) || chr(10)")}) AS n FROM documents)
"""


@query(
    "report_batches",
    walk_sql(_REPORT_ITEMS, "source", 3000, 3)
    + """SELECT source, batch, count(*)::INTEGER AS n_reports, md5('-----Reports-----' || chr(10) || 'id|title|occurrence weight|content|rank' || chr(10)
  || string_agg(line, chr(10) ORDER BY weight DESC, rank DESC, id) || chr(10)) AS context_md5 FROM walk JOIN items USING (source, rn) GROUP BY 1, 2""",
)
def report_batches(t):
    docs = t.documents.select(
        "source",
        F.col("doc_id").alias("id"),
        F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("title"),
        F.col("n_chars").alias("weight"),
        (1 + F.col("doc_id") % 3).alias("rank"),
        F.col("text").alias("content"),
    )
    chosen = search.select_reports(docs)
    out = search.report_batches(chosen, ["source"], max_tokens=3000)
    return out.select("source", "batch", "n_reports", F.md5("context").alias("context_md5"))


@query(
    "map_points",
    """
SELECT event_id, i AS point, CASE WHEN i = 0 THEN event_type ELSE 'more' END AS answer, CASE WHEN i = 0 THEN (props::JSON->>'k')::INTEGER ELSE 7 END AS score
FROM events, (SELECT unnest([0, 1]) AS i) WHERE event_type <> 'error' UNION ALL SELECT event_id, 0, '', 0 FROM events WHERE event_type = 'error'
""",
)
def map_points(t):
    good = F.concat(
        F.lit('So: {"points": [{"description": "'), F.col("event_type"), F.lit('", "score": '), F.get_json_object("props", "$.k"), F.lit('}, {"description": "more", "score": 7}]} ok')
    )
    answers = t.events.select("event_id", F.when(F.col("event_type") == "error", "sorry").otherwise(good).alias("output"))
    return search.map_points(answers, ["event_id"])


@query(
    "reduce_points",
    f"""
WITH p AS (SELECT user_id, event_id % 7 AS analyst, event_id AS point, event_type AS answer, (props::JSON->>'k')::INTEGER AS score FROM events),
x AS (SELECT *, '----Analyst ' || (analyst + 1) || '----' || chr(10) || 'Importance Score: ' || score || chr(10) || answer AS txt FROM p WHERE score > 0),
s AS (SELECT *, sum(len({_N.format('txt')})) OVER (PARTITION BY user_id ORDER BY score DESC, analyst, point ROWS UNBOUNDED PRECEDING) AS total FROM x)
SELECT user_id, string_agg(txt, chr(10) || chr(10) ORDER BY score DESC, analyst, point) AS report_data, count(*)::INTEGER AS n_points FROM s WHERE total <= 60 GROUP BY 1
""",
)
def reduce_points(t):
    points = t.events.select(
        "user_id",
        (F.col("event_id") % 7).alias("analyst"),
        F.col("event_id").alias("point"),
        F.col("event_type").alias("answer"),
        F.get_json_object("props", "$.k").cast("int").alias("score"),
    )
    return search.reduce_points(points, ["user_id"], 60)


@query("global_search")
def global_search(t):
    docs = t.documents.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("title"),
        F.col("n_chars").alias("weight"),
        F.lit(1).alias("rank"),
        F.col("text").alias("content"),
    )
    asked = t.events.select(F.col("event_type").alias("question_id"), F.concat(F.lit("What about "), F.col("event_type"), F.lit("?")).alias("question")).distinct()
    return search.global_search(asked, search.select_reports(docs), offline.points, offline.summarize)


# ---------------------------------------------------------------- vectors


@query(
    "embed_average",
    """
WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2)
SELECT label, (i - 1)::INTEGER AS position, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS value FROM c
""",
)
def embed_average(t):
    out = embed.average_vectors(t.embeddings, ["label"], "embedding", "v")
    return out.select("label", F.posexplode("v").alias("position", "value")).withColumn("value", F.round("value", 6))


@query(
    "embed_batches",
    walk_sql(
        f"SELECT source, doc_id, (s // 200)::INTEGER AS chunk_index, len(tk[s + 1 : s + 200]) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id, s) AS rn "
        f"FROM (SELECT source, doc_id, tk, unnest(range(0, len(tk), 200)) AS s FROM (SELECT source, doc_id, {_N.format('text')} AS tk FROM documents))",
        "source", 1500, 0, 16,
    )
    + "SELECT source, doc_id, chunk_index, n::INTEGER AS n_tokens, batch FROM walk JOIN items USING (source, rn)",
)
def embed_batches(t):
    pieces = chunk.chunk_tokens(spread(t.documents.select("source", "doc_id", "text")), "text", 200, 0)
    return embed.embed_batches(pieces, ["source"], ["doc_id", "chunk_index"], 16, 1500).drop("chunk")


@query("vector_table", "SELECT vec_id::VARCHAR AS id, 'vector ' || vec_id AS text, len(embedding)::INTEGER AS size, label::VARCHAR AS label FROM embeddings")
def vector_table(t):
    named = t.embeddings.withColumn("text", F.concat(F.lit("vector "), F.col("vec_id").cast("string")))
    out = embed.vector_table(named, "vec_id", "text", "embedding", ["label"])
    return out.select("id", "text", F.size("vector").alias("size"), F.col("attributes")["label"].alias("label"))


# Searches ask with every row whose id is divisible by 50, against all rows.
_ASKED = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0)"


def _asked(t):
    return t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _topk_sql(asked: str, source: str, vector: str) -> str:
    return f"""WITH {asked},
s AS (SELECT query_id, {source}.id AS id, round(list_cosine_similarity(q.v, {vector}), {topk.DIGITS}) AS score FROM q, {source})
SELECT query_id, id, round(score, 6) AS score, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS position FROM s) WHERE position <= 10"""


_ALL = "(SELECT vec_id AS id, embedding::DOUBLE[] AS w FROM embeddings)"


@query("vector_topk", _topk_sql(f"{_ASKED}, e AS {_ALL}", "e", "e.w"))
def vector_topk(t):
    return topk.similarity_topk(_vectors(t), _asked(t), 10).withColumn("score", F.round("score", 6))


@query("vector_topk_filtered", _topk_sql(f"{_ASKED}, e AS (SELECT * FROM {_ALL} WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1))", "e", "e.w"))
def vector_topk_filtered(t):
    wanted = t.labels.filter("quality = 1").select(F.col("doc_id").alias("id"))
    return topk.similarity_topk(topk.filter_by_id(_vectors(t), wanted), _asked(t), 10).withColumn("score", F.round("score", 6))


_RECALL_SQL = "SELECT true AS enough, count(*) AS queries FROM embeddings WHERE vec_id % 50 = 0"


def _recall(t, near):
    """Whether ``near`` holds nine tenths of the exact neighbours, over all queries."""
    exact = topk.similarity_topk(_vectors(t), _asked(t), 10).select("query_id", "id")
    both = exact.join(near.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg((F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"), F.count_distinct("query_id").alias("queries"))


def _lsh(t):
    return topk.similarity_topk_lsh(_vectors(t), _asked(t), 10, radius=1.4, width=1.0)


@query("vector_lsh_recall", _RECALL_SQL)
def vector_lsh_recall(t):
    return _recall(t, _lsh(t))


@query("vector_topk_lsh")
def vector_topk_lsh(t):
    return _lsh(t)


def _ivf(t):
    spark = t.embeddings.sparkSession
    index = ivf.build(_vectors(t), scratch_path(spark, "vector-index"))
    return ivf.search(index, _vectors(t), _asked(t), 10, ivf.probes_for(index, _vectors(t), 10))


@query("vector_ivf_topk")
def vector_ivf_topk(t):
    """An index of all vectors, with as many lists asked as a sample needs."""
    return _ivf(t)


@query("vector_ivf_recall", _RECALL_SQL)
def vector_ivf_recall(t):
    return _recall(t, _ivf(t))


def letter_counts(texts: list[str]) -> list[list[float]]:
    """A stand-in embedder: how many words of a text have each first letter of their md5."""
    out = []
    for text in texts:
        counts = collections.Counter(hashlib.md5(w.encode()).hexdigest()[0] for w in text.split(" ") if w)
        out.append([float(counts[d]) for d in "0123456789abcdef"])
    return out


def _letters_sql(table: str, key: str, name: str) -> str:
    # an embedder gets each text as tokens, joined again
    words = "list_filter(string_split(text, ' '), lambda w: w <> '')"
    counts = ", ".join(f"len(list_filter(m, lambda x: x = '{d}'))::DOUBLE" for d in "0123456789abcdef")
    return f"""{name} AS (SELECT {key} AS id, [{counts}] AS w FROM (SELECT {key}, list_transform({words}, lambda w: substr(md5(w), 1, 1)) AS m FROM {table}
  WHERE len({_N.format('text')}) > 0))"""


WHOLE_TEXT = 1 << 30


@query("text_topk", _topk_sql(f"{_letters_sql('documents', 'doc_id', 'd')}, {_letters_sql('benchmark', 'item_id', 'b')}, q AS (SELECT id AS query_id, w AS v FROM b)", "d", "d.w"))
def text_topk(t):
    """Texts by text: every benchmark item against all documents, each text in one snippet."""
    parts = lambda df, key: embed.text_embed(spread(df), key, "text", letter_counts, "vector", max_tokens=WHOLE_TEXT).filter("vector IS NOT NULL")
    vectors = parts(t.documents.select(F.col("doc_id").alias("id"), "text"), "id")
    asked = parts(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), "query_id")
    return topk.similarity_topk(vectors, asked, 10).withColumn("score", F.round("score", 6))


@query(
    "rag_context",
    f"""WITH {_ASKED}, s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(v, embedding::DOUBLE[]), {topk.DIGITS}) AS score FROM q, embeddings),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM s)
SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY position) AS context FROM h JOIN documents ON doc_id = id WHERE position <= 10 GROUP BY 1""",
)
def rag_context(t):
    hits = topk.similarity_topk(_vectors(t), _asked(t), 10)
    return topk.context_for(hits, t.documents, "doc_id", "text")


@query(
    "context_claims",
    f"""{CTX} SELECT level, community, step, kind, line FROM ti UNION ALL
SELECT level, community, use // 2, 'claim', concat_ws(',', s_suppkey, s_name, 'ACCOUNT', CASE WHEN s_acctbal > 0 THEN 'IN CREDIT' ELSE 'IN DEBT' END, 'No Description')
FROM us JOIN nd USING (level, community, title) JOIN supplier ON s_name = title""",
)
def context_claims(t):
    """Context lines with claims on the suppliers; a claim comes with the first edge that uses its subject."""
    nodes, edges = trade_context(t)
    claims = t.supplier.select(
        F.col("s_suppkey").alias("human_readable_id"),
        F.col("s_name").alias("subject_id"),
        F.lit("ACCOUNT").alias("type"),
        F.when(F.col("s_acctbal") > 0, "IN CREDIT").otherwise("IN DEBT").alias("status"),
        F.lit(None).cast("string").alias("description"),
    )
    lines = stored(local.context_lines(nodes, edges, claims))
    items = local.context_items(nodes, edges, lines, claims)
    return local.with_lines(items, lines).select("level", "community", "step", "kind", "line")


def _count_marks(prompts):
    return [f'{{"points": [{{"description": "{p.count("MARK")} marks", "score": 50}}]}}' for p in prompts]


def _first_point(prompts):
    return [p.split("Importance Score: 50\n")[1].split("\n")[0] for p in prompts]


@query(
    "search_conversation",
    "SELECT conv_id AS question_id, count(*) || ' marks' AS response, 2::BIGINT AS model_calls FROM conversations GROUP BY 1",
)
def search_conversation(t):
    """Every question sees the turns of its own conversation."""
    told = t.conversations.groupBy("conv_id").agg(F.repeat(F.lit("MARK "), F.count(F.lit(1)).cast("int")).alias("context"))
    asked = told.select(F.col("conv_id").alias("question_id"), F.lit("What now?").alias("question"), "conv_id")
    regions = t.region.select(
        F.col("r_regionkey").alias("id"), F.col("r_name").alias("title"), F.lit(1).alias("weight"), F.lit(1).alias("rank"), F.col("r_name").alias("content")
    )
    out = search.global_search(asked, search.select_reports(regions), _count_marks, _first_point, conversation=told)
    return out.select("question_id", "response", "model_calls")
