"""Queries of conversion, scalar functions, tokens, chunks, budgets and extraction records."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from kgspark import config
from kgspark.functions import convert, jsontext, numbers, strings
from kgspark.functions import tokens as tok
from kgspark.model import apply, gleaning, offline, prompts, records
from kgspark.plans.registry import query
from kgspark.session import spread
from kgspark.sources import documents
from kgspark.text import budget, chunk

# ---------------------------------------------------------------- conversion


@query(
    "convert_bool",
    "SELECT o_orderkey, lower(v) = 'true' AS b FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'TRUE' WHEN 'O' THEN 'true' ELSE 'no' END AS v FROM orders)",
)
def convert_bool(t):
    v = F.when(F.col("o_orderstatus") == "F", "TRUE").when(F.col("o_orderstatus") == "O", "true").otherwise("no")
    return convert.convert(t.orders.select("o_orderkey", v.alias("v")), "v", "b", "boolean").drop("v")


@query(
    "convert_int",
    """
SELECT o_orderkey, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN v::BIGINT END AS i
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE '-' || o_custkey END AS v FROM orders)
""",
)
def convert_int(t):
    v = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(F.concat(F.lit("-"), F.col("o_custkey").cast("string")))
    return convert.convert(t.orders.select("o_orderkey", v.alias("v")), "v", "i", "integer").drop("v")


@query(
    "convert_int_radix",
    """
SELECT c_custkey, ('0x' || left(md5(c_name), 8))::BIGINT AS hex,
  CASE WHEN regexp_full_match(c_custkey::VARCHAR, '[0-7]+') THEN list_sum(list_transform(range(len(c_custkey::VARCHAR)),
    lambda i: substr(c_custkey::VARCHAR, len(c_custkey::VARCHAR) - i, 1)::BIGINT * power(8, i)::BIGINT))::BIGINT END AS oct
FROM customer
""",
)
def convert_int_radix(t):
    rows = t.customer.select(
        "c_custkey",
        F.concat(F.lit("0x"), F.substring(F.md5("c_name"), 1, 8)).alias("h"),
        F.col("c_custkey").cast("string").alias("o"),
    )
    # the prefix in the column says 16
    hexed = convert.convert(rows, "h", "hex", "integer", radix=None)
    return convert.convert(hexed, "o", "oct", "integer", radix=8).drop("h", "o")


@query(
    "convert_float",
    "SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS f FROM events",
)
def convert_float(t):
    v = F.when(F.col("event_type") == "view", F.col("event_type")).otherwise(F.col("value").cast("string"))
    return convert.convert(t.events.select("event_id", v.alias("v")), "v", "f", "decimal").drop("v")


@query(
    "convert_string",
    """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS done,
  coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_custkey::VARCHAR END, '') AS cust FROM orders
""",
)
def convert_string(t):
    rows = t.orders.select(
        "o_orderkey",
        F.col("o_orderdate").alias("d"),
        (F.col("o_orderstatus") == "F").alias("b"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("n"),
    )
    out = convert.convert(rows, "d", "day", "string")
    out = convert.convert(out, "b", "done", "string")
    return convert.convert(out, "n", "cust", "string").select("o_orderkey", "day", "done", "cust")


@query(
    "convert_date",
    """
SELECT event_id, strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%d %H:%M:%S.%g') AS from_ms,
  strftime(CASE WHEN event_type <> 'view' THEN date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS from_text FROM events
""",
)
def convert_date(t):
    rows = t.events.select(
        "event_id",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        F.when(F.col("event_type") == "view", "no date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("text"),
    )
    out = convert.convert(convert.convert(rows, "ms", "a", "date"), "text", "b", "date")
    return out.select(
        "event_id", F.date_format("a", "yyyy-MM-dd HH:mm:ss.SSS").alias("from_ms"), F.date_format("b", "yyyy-MM-dd HH:mm:ss").alias("from_text")
    )


@query(
    "convert_array",
    """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE len(string_split(o_orderpriority, '-')) END::INTEGER AS n,
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE replace(o_orderpriority, '-', '/') END AS joined, o_custkey::VARCHAR AS wrapped FROM orders
""",
)
def convert_array(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("v"), "o_custkey")
    out = convert.convert(rows, "v", "a", "array", delimiter="-")
    out = convert.convert(out, "o_custkey", "w", "array")
    return out.select(
        "o_orderkey", F.size("a").alias("n"), F.array_join("a", "/").alias("joined"), F.element_at("w", 1).cast("string").alias("wrapped")
    )


@query(
    "text_split",
    """
SELECT doc_id, CASE WHEN s = '' THEN 0 ELSE len(string_split(s, '. ')) END::INTEGER AS n,
  CASE WHEN s = '' THEN NULL ELSE string_split(s, '. ')[1] END AS first_part
FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN '' ELSE text END AS s FROM documents)
""",
)
def text_split(t):
    s = F.when(F.col("lang") == "de", "").otherwise(F.col("text"))
    parts = t.documents.select("doc_id", convert.text_split(s, ". ").alias("p"))
    return parts.select("doc_id", F.size("p").alias("n"), F.get("p", F.lit(0)).alias("first_part"))


# ---------------------------------------------------------------- scalar text functions

_UNESCAPE_SQL = """regexp_replace(replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
  '&#39;', ''''), '&nbsp;', chr(160)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;?', '&', 'g')"""


@query(
    "clean_str",
    r"SELECT page_id, regexp_replace(" + _UNESCAPE_SQL.format(r"regexp_replace(html, '^\s+|\s+$', '', 'g')") + r", '[\x00-\x1f\x7f-\x9f]', '', 'g') AS clean FROM pages",
)
def clean_str(t):
    return t.pages.select("page_id", strings.clean_str(F.col("html")).alias("clean"))


@query("normalize_name", "SELECT page_id, " + _UNESCAPE_SQL.format(r"upper(regexp_replace(url, '^\s+|\s+$', '', 'g'))") + " AS name FROM pages")
def normalize_name(t):
    return t.pages.select("page_id", strings.normalize_name(F.col("url")).alias("name"))


@query("strip_symbols", r"SELECT doc_id, regexp_replace(text, '[^a-zA-Z0-9\s]', '', 'g') AS plain FROM documents")
def strip_symbols(t):
    return t.documents.select("doc_id", strings.strip_symbols(F.col("text")).alias("plain"))


@query("clean_documents", r"SELECT doc_id, regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^ | $', '', 'g') AS text FROM documents")
def clean_documents(t):
    return documents.clean(t.documents.select("doc_id", "text"), "text")


# what people paste: letters taken apart, and some without an ASCII letter
_PASTED = "text || ' E' || chr(769) || 'te' || chr(769) || '  ' || chr(223) || ' ' || chr(8364)"


@query("clean_documents_composed", rf"SELECT doc_id, regexp_replace(regexp_replace(lower(nfc_normalize({_PASTED})), '\s+', ' ', 'g'), '^ | $', '', 'g') AS text FROM documents")
def clean_documents_composed(t):
    pasted = t.documents.select("doc_id", F.concat("text", F.lit(" E\u0301te\u0301  \u00df \u20ac")).alias("text"))
    return documents.clean(pasted, "text", compose_unicode=True)


@query(
    "clean_documents_ascii",
    rf"SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(strip_accents({_PASTED}), '[^\x00-\x7f]', '', 'g')), '\s+', ' ', 'g'), '^ | $', '', 'g') AS text FROM documents",
)
def clean_documents_ascii(t):
    pasted = t.documents.select("doc_id", F.concat("text", F.lit(" E\u0301te\u0301  \u00df \u20ac")).alias("text"))
    return documents.clean(pasted, "text", ascii_only=True)


@query("strip_citations", "SELECT doc_id, text || '. Done.' AS answer FROM documents")
def strip_citations(t):
    cited = F.concat(F.col("text"), F.lit("[Data: Reports (1, 2, +more)]. Done.[Data: Reports (7)]"))
    return t.documents.select("doc_id", strings.strip_citations(cited).alias("answer"))


@query("render_prompt", "SELECT conv_id, turn, 'user' AS role, 'Say it as ' || role || ': ' || text AS content FROM conversations")
def render_prompt(t):
    filled = prompts.render("Say it as {role}: {text}", {"role": F.col("role"), "text": F.col("text")})
    sent = prompts.messages(F.lit("You answer."), None, filled)
    return t.conversations.select("conv_id", "turn", F.element_at(sent, -1).alias("m")).select("conv_id", "turn", "m.role", "m.content")


@query(
    "messages_history",
    """
WITH h AS (SELECT conv_id, turn, text, lag(role, 2) OVER w AS r2, lag(text, 2) OVER w AS t2, lag(role) OVER w AS r1, lag(text) OVER w AS t1
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, 2 + (r2 IS NOT NULL)::INTEGER + (r1 IS NOT NULL)::INTEGER AS n,
  concat_ws(chr(10), 'system: You answer.', r2 || ': ' || t2, r1 || ': ' || t1, 'user: ' || text) AS sent FROM h
""",
)
def messages_history(t):
    """Each turn as a question, with the two turns before it as history."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = [F.struct(F.lag("role", n).over(w).alias("role"), F.lag("text", n).over(w).alias("content")) for n in (2, 1)]
    told = t.conversations.select("conv_id", "turn", "text", F.array(*before).alias("before"))
    history = F.filter("before", lambda m: m["role"].isNotNull())
    sent = prompts.messages(F.lit("You answer."), history, F.col("text"))
    lines = F.array_join(F.transform(sent, lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n")
    return told.select("conv_id", "turn", F.size(sent).alias("n"), lines.alias("sent"))


@query("flags_to_text", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s = '' THEN 'none of them' ELSE s END AS flags FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(', ', CASE WHEN l_discount > 0 THEN 'discount' END, CASE WHEN l_tax > 0 THEN 'tax' END,
    CASE WHEN l_quantity - 40 > 0 THEN 'bulk' END) AS s FROM lineitem)
""")
def flags_to_text(t):
    flags = {"discount": F.col("l_discount"), "tax": F.col("l_tax"), "bulk": F.col("l_quantity") - 40}
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", strings.flags_to_text(flags, "none of them").alias("flags"))


_REPORT_SQL = """regexp_replace(concat_ws(chr(10), 'CUSTOMER: ' || c_name || '.', 'SEGMENT: ' || c_mktsegment || '.',
  CASE WHEN c_acctbal > 0 THEN 'NATION: ' || c_nationkey || '.' END), '[^0-9A-Za-z.\\s:'']', '', 'g')""".replace("\\\\", "\\")


def _customer_report():
    fields = {
        "CUSTOMER": F.col("c_name"),
        "SEGMENT": F.col("c_mktsegment"),
        "NATION": F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")),
    }
    return strings.report_clean(strings.field_lines(fields))


@query("row_to_report", f"SELECT c_custkey, {_REPORT_SQL} AS report, CASE WHEN c_acctbal > 0 THEN 'Female' ELSE 'Male' END AS word FROM customer")
def row_to_report(t):
    code = F.when(F.col("c_acctbal") > 0, "F").otherwise("M")
    return t.customer.select("c_custkey", _customer_report().alias("report"), strings.gender_word(code).alias("word"))


@query(
    "render_csv",
    """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',', l_linenumber::VARCHAR, l_partkey::VARCHAR,
    CASE WHEN l_returnflag = 'R' THEN '"back, again"' WHEN l_returnflag = 'A' THEN '"so ' || repeat(chr(34), 2) || 'called' || repeat(chr(34), 3) ELSE 'N' END) || chr(10) AS line FROM lineitem)
SELECT l_orderkey, 'line,part,note' || chr(10) || string_agg(line, '' ORDER BY l_linenumber, l_partkey, line) AS csv FROM l GROUP BY 1
""",
)
def render_csv(t):
    note = F.when(F.col("l_returnflag") == "R", "back, again").when(F.col("l_returnflag") == "A", 'so "called"').otherwise("N")
    row = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), note.alias("note"))
    # the quoted notes sort before the bare one, as their lines do
    key = F.struct("l_linenumber", "l_partkey", F.when(note == "N", 1).otherwise(0).alias("q"), row.alias("row"))
    orders = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(key)).alias("r"))
    rows = F.transform("r", lambda r: r["row"])
    return orders.select("l_orderkey", strings.render_csv(rows, ["line", "part", "note"]).alias("csv"))


@query(
    "parse_range",
    """
SELECT p_partkey, p_size::DOUBLE AS lo, (1000 + p_size)::DOUBLE AS hi FROM part WHERE p_size % 2 = 0
UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_size % 2 = 1
""",
)
def parse_range(t):
    text = F.when(
        F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("-1,"), F.lpad(F.col("p_size").cast("string"), 3, "0"))
    ).otherwise("about as usual")
    lo, hi = jsontext.parse_range(text)
    return t.part.select("p_partkey", lo.alias("lo"), hi.alias("hi"))


@query(
    "row_mean",
    """
SELECT event_id, round(list_avg(list_filter([value, CASE WHEN event_type = 'click' THEN user_id::DOUBLE END, event_id::DOUBLE], lambda x: x IS NOT NULL)), 6) AS mean FROM events
""",
)
def row_mean(t):
    cols = [F.col("value"), F.when(F.col("event_type") == "click", F.col("user_id")), F.col("event_id")]
    return t.events.select("event_id", F.round(numbers.row_mean(cols), 6).alias("mean"))


@query("temp_fix", "SELECT event_id, round(CASE WHEN value > 45 THEN (value - 32) * 5 / 9 ELSE value END, 6) AS celsius FROM events")
def temp_fix(t):
    return t.events.select("event_id", F.round(numbers.celsius(F.col("value")), 6).alias("celsius"))


@query("hill_curve", "SELECT event_id, round(power(value, 2.8) / (power(value, 2.8) + power(26.6, 2.8)) * 100, 6) AS saturation FROM events")
def hill_curve(t):
    return t.events.select("event_id", F.round(numbers.oxygen_saturation(F.col("value")), 6).alias("saturation"))


@query("parse_feature_list", "SELECT p_partkey, 2 AS n, lower(p_brand) || ';' || lower(p_type) AS features FROM part")
def parse_feature_list(t):
    text = F.concat(F.lit("['Augmented_"), F.col("p_brand"), F.lit("', '"), F.col("p_type"), F.lit("']"))
    parts = t.part.select("p_partkey", jsontext.feature_list(text).alias("f"))
    return parts.select("p_partkey", F.size("f").alias("n"), F.array_join("f", ";").alias("features"))


# ---------------------------------------------------------------- JSON in answers


@query("json_substring", """SELECT event_id, props AS object, props::JSON->>'k' AS k FROM events""")
def json_substring(t):
    answer = F.concat(F.lit("Here it is:\n"), F.col("props"), F.lit("\nHope it helps"))
    found = jsontext.object_substring(answer)
    return t.events.select("event_id", found.alias("object"), F.get_json_object(found, "$.k").alias("k"))


@query(
    "json_substring_single",
    """
SELECT event_id, CASE WHEN event_type <> 'view' THEN props END AS single, props AS first_flat, props AS last_flat FROM events
""",
)
def json_substring_single(t):
    twice = F.concat(F.col("props"), F.lit(" or "), F.col("props"))
    answer = F.when(F.col("event_type") == "view", twice).otherwise(F.concat(F.lit("so "), F.col("props")))
    return t.events.select(
        "event_id",
        jsontext.single_object(answer).alias("single"),
        jsontext.first_flat_object(answer).alias("first_flat"),
        jsontext.last_flat_object(answer).alias("last_flat"),
    )


@query(
    "json_balanced",
    """
SELECT event_id, '{"a": ' || props || ', "b": {}}' AS first_object, CASE WHEN event_type = 'view' THEN props ELSE '{"z": 1}' END AS last_object FROM events
""",
)
def json_balanced(t):
    answer = F.concat(
        F.lit('} text { {"a": '), F.col("props"), F.lit(', "b": {}} and '), F.when(F.col("event_type") == "view", F.col("props")).otherwise(F.lit('{"z": 1}')), F.lit(" end {")
    )
    return t.events.select("event_id", jsontext.balanced(answer).alias("o")).select("event_id", "o.first_object", "o.last_object")


@query(
    "json_repair",
    """
SELECT event_id, (props::JSON->>'k')::BIGINT AS k, 2 AS n, event_type AS second_name FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, NULL, NULL, NULL FROM events WHERE event_type = 'error'
""",
)
def json_repair(t):
    k = F.get_json_object("props", "$.k")
    broken = F.concat(
        F.lit("Sure!\n```json\n{\n \"k\": "), k, F.lit(',\n "items": [{"name": "one"}, {"name": "'), F.col("event_type"), F.lit('"\n ],\n}\n```\nDone.')
    )
    answer = F.when(F.col("event_type") == "error", "no object at all").otherwise(broken)
    r = jsontext.parse(jsontext.repair(answer), "k bigint, items array<struct<name:string>>")
    return t.events.select("event_id", r.alias("r")).select(
        "event_id", "r.k", F.when(F.col("r").isNotNull(), F.size("r.items")).alias("n"), F.col("r.items")[1]["name"].alias("second_name")
    )


@query(
    "json_repair_nested",
    """SELECT event_id, user_id, event_type AS first_name, 'x,y' AS tags, 'last' AS second_name FROM events""",
)
def json_repair_nested(t):
    """A list left open inside an item, an item left open inside a list, and an object that never ends."""
    answer = F.concat(
        F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "items": [{"name": "'), "event_type",
        F.lit('", "tags": ["x", "y",}, {"name": "last", "tags": []\n ],\n "more": {"a": [1, 2'),
    )
    r = jsontext.parse(jsontext.repair(answer), "user bigint, items array<struct<name:string,tags:array<string>>>")
    items = F.col("r.items")
    return t.events.select("event_id", r.alias("r")).select(
        "event_id", F.col("r.user").alias("user_id"), items[0]["name"].alias("first_name"),
        F.array_join(items[0]["tags"], ",").alias("tags"), items[1]["name"].alias("second_name"),
    )


@query(
    "json_latest_key",
    """
SELECT event_id, (props::JSON->>'k')::DOUBLE + 1000 AS k, event_type = 'click' AS clicked, event_type AS kind FROM events
""",
)
def json_latest_key(t):
    k = F.get_json_object("props", "$.k")
    head = F.concat(F.lit('{"k": '), k, F.lit(', "clicked": '), (F.col("event_type") == "click").cast("string"), F.lit(', "k": '), (k.cast("int") + 1000).cast("string"))
    # every second answer lacks its closing mark and is read pair by pair
    tail = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(', "kind": "'), F.col("event_type"), F.lit('"}'))).otherwise(
        F.concat(F.lit(', "kind": '), F.col("event_type"), F.lit("\n}"))
    )
    m = jsontext.latest_keys(F.concat(head, tail))
    get = lambda key: F.try_element_at(F.col("m"), F.lit(key))
    return t.events.select("event_id", m.alias("m")).select(
        "event_id",
        jsontext.typed(get("k"), "numerical").alias("k"),
        jsontext.typed(get("clicked"), "boolean").alias("clicked"),
        get("kind").alias("kind"),
    )


@query("map_pick_keys", "SELECT event_id, 2 AS n, event_type AS kind, (props::JSON->>'k') AS k FROM events")
def map_pick_keys(t):
    m = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"), F.lit("other"), F.lit("x"))
    picked = jsontext.pick_keys(m, F.array(F.lit("kind"), F.lit("k"), F.lit("absent")))
    return t.events.select("event_id", picked.alias("m")).select(
        "event_id", F.size("m").alias("n"), F.element_at("m", "kind").alias("kind"), F.element_at("m", "k").alias("k")
    )


@query("json_validate", "SELECT event_id, event_type IN ('click', 'view') AS ok FROM events")
def json_validate(t):
    full = F.concat(F.lit('{"title": "'), F.col("event_type"), F.lit('", "summary": "s", "rating": 5, "rating_explanation": "e", "findings": []}'))
    short = F.lit('{"title": "t", "summary": "s", "rating": 5}')
    wrong = F.lit('{"title": "t", "summary": "s", "rating": "high", "rating_explanation": "e", "findings": []}')
    answer = F.when(F.col("event_type").isin("click", "view"), full).when(F.col("event_type") == "error", wrong).when(
        F.col("event_type") == "signup", F.lit("[1, 2]")
    ).otherwise(short)
    return t.events.select("event_id", jsontext.report_is_valid(answer).alias("ok"))


# ---------------------------------------------------------------- tokens, chunks, budgets

_TOKENS_SQL = r"regexp_extract_all({0}, '\s*\S+|\s+$')"


@query("token_count", f"SELECT doc_id, len({_TOKENS_SQL.format('text')})::INTEGER AS n_tokens FROM documents")
def token_count(t):
    return t.documents.select("doc_id", tok.count(F.col("text")).alias("n_tokens"))


@query("token_roundtrip", "SELECT doc_id, text FROM documents")
def token_roundtrip(t):
    return t.documents.select("doc_id", tok.join(tok.tokens(F.col("text"))).alias("text"))


_SIZE, _OVERLAP = 120, 20
_CHUNKS_SQL = f"""
WITH d AS (SELECT doc_id, {_TOKENS_SQL.format('text')} AS tk FROM documents),
c AS (SELECT doc_id, tk, unnest(range(0, len(tk), {_SIZE - _OVERLAP})) AS s FROM d)
SELECT doc_id, (s // {_SIZE - _OVERLAP})::INTEGER AS chunk_index, array_to_string(tk[s + 1 : s + {_SIZE}], '') AS chunk,
  len(tk[s + 1 : s + {_SIZE}])::INTEGER AS n_tokens FROM c
"""


@query("chunk_tokens", _CHUNKS_SQL)
def chunk_tokens(t):
    return chunk.chunk_tokens(t.documents.select("doc_id", "text"), "text", _SIZE, _OVERLAP)


@query(
    "chunk_group",
    f"""
WITH tk AS (SELECT source, doc_id, unnest({_TOKENS_SQL.format('text')}) AS tok, generate_subscripts({_TOKENS_SQL.format('text')}, 1) AS i FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS pos FROM tk),
k AS (SELECT source, doc_id, tok, pos, unnest(range(greatest(0, (pos - {config.CHUNK_SIZE}) // {config.CHUNK_SIZE - config.CHUNK_OVERLAP}),
  pos // {config.CHUNK_SIZE - config.CHUNK_OVERLAP} + 1)) AS k FROM p)
SELECT source, k AS chunk_index, string_agg(DISTINCT lpad(doc_id::VARCHAR, 9, '0'), ',' ORDER BY lpad(doc_id::VARCHAR, 9, '0')) AS ids,
  md5(string_agg(tok, '' ORDER BY pos)) AS chunk_md5, count(*)::INTEGER AS n_tokens
FROM k WHERE pos >= k * {config.CHUNK_SIZE - config.CHUNK_OVERLAP} AND pos < k * {config.CHUNK_SIZE - config.CHUNK_OVERLAP} + {config.CHUNK_SIZE} GROUP BY 1, 2
""",
)
def chunk_group(t):
    out = chunk.chunk_group(t.documents, ["source"], ["doc_id"], "doc_id", "text")
    ids = F.transform("document_ids", lambda d: F.lpad(d.cast("string"), 9, "0"))
    return out.select("source", "chunk_index", F.array_join(ids, ",").alias("ids"), F.md5("chunk").alias("chunk_md5"), "n_tokens")


@query(
    "chunk_sentences",
    r"""
WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM documents)
SELECT doc_id, (i - 1)::INTEGER AS chunk_index, parts[i] AS chunk FROM s, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)
""",
)
def chunk_sentences(t):
    return chunk.chunk_sentences(t.documents.select("doc_id", "text"), "text")


RECURSIVE_SIZE, RECURSIVE_OVERLAP = 300, 60


@query(
    "chunk_recursive",
    f"""
WITH RECURSIVE paras AS (
  SELECT doc_id, i, CASE WHEN i < len(w) THEN w[i] || chr(10) || chr(10) ELSE w[i] END AS p
  FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS w FROM documents), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
lines AS (
  SELECT doc_id, i, 0 AS j, p FROM paras WHERE length(p) <= {RECURSIVE_SIZE - RECURSIVE_OVERLAP}
  UNION ALL SELECT doc_id, i, j, CASE WHEN j < len(w) THEN w[j] || chr(10) ELSE w[j] END FROM
    (SELECT doc_id, i, string_split(p, chr(10)) AS w FROM paras WHERE length(p) > {RECURSIVE_SIZE - RECURSIVE_OVERLAP}), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS j)),
pieces AS (
  SELECT doc_id, i, j, 0 AS k, p FROM lines WHERE length(p) <= {RECURSIVE_SIZE - RECURSIVE_OVERLAP}
  UNION ALL SELECT doc_id, i, j, k, CASE WHEN k < len(w) THEN w[k] || ' ' ELSE w[k] END FROM
    (SELECT doc_id, i, j, string_split(p, ' ') AS w FROM lines WHERE length(p) > {RECURSIVE_SIZE - RECURSIVE_OVERLAP}), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k)),
n AS (SELECT doc_id, p, length(p) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY i, j, k) AS rn FROM pieces WHERE p <> ''),
walk AS (
  SELECT doc_id, rn, 0::BIGINT AS b, len AS fill FROM n WHERE rn = 1
  UNION ALL SELECT n.doc_id, n.rn, CASE WHEN w.fill + n.len > {RECURSIVE_SIZE - RECURSIVE_OVERLAP} THEN w.b + 1 ELSE w.b END,
    CASE WHEN w.fill + n.len > {RECURSIVE_SIZE - RECURSIVE_OVERLAP} THEN n.len ELSE w.fill + n.len END
  FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.rn = w.rn + 1),
placed AS (SELECT doc_id, b, rn, p, len, sum(len) OVER (PARTITION BY doc_id, b ORDER BY rn DESC) AS back, max(b) OVER (PARTITION BY doc_id) AS top FROM walk JOIN n USING (doc_id, rn)),
every AS (SELECT doc_id, b, rn, p FROM placed UNION ALL SELECT doc_id, b + 1, rn, p FROM placed WHERE back <= {RECURSIVE_OVERLAP} AND b < top)
SELECT doc_id, b AS chunk_index, string_agg(p, '' ORDER BY rn) AS chunk FROM every GROUP BY 1, 2
""",
)
def chunk_recursive(t):
    return chunk.chunk_recursive(spread(t.documents.select("doc_id", "text")), "doc_id", "text", RECURSIVE_SIZE, RECURSIVE_OVERLAP)


WINDOW_WORDS, WINDOW_STEP = 80, 60


def word_windows(text: str):
    """A user's splitter: windows of words, with their counts."""
    words = re.findall(r"[^ \t\n\r]+", text)
    for start in range(0, len(words), WINDOW_STEP):
        window = words[start : start + WINDOW_WORDS]
        yield " ".join(window), len(window)


@query(
    "chunk_udtf",
    rf"""
WITH w AS (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, source, w, unnest(range(0, len(w), {WINDOW_STEP})) AS s FROM w)
SELECT doc_id, source, (s // {WINDOW_STEP})::INTEGER AS chunk_index, array_to_string(w[s + 1 : s + {WINDOW_WORDS}], ' ') AS chunk,
  len(w[s + 1 : s + {WINDOW_WORDS}])::INTEGER AS n_tokens FROM c
""",
)
def chunk_udtf(t):
    docs = spread(t.documents.select("doc_id", "source", "text"))
    chunk.register_chunker(docs.sparkSession, "word_windows", word_windows)
    return chunk.chunk(docs, "text", "word_windows")


CHUNK_CHARS_SQL = f"""
WITH RECURSIVE lines AS (
  SELECT doc_id, i, CASE WHEN i < len(w) THEN w[i] || chr(10) ELSE w[i] END AS p
  FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
pieces AS (
  SELECT doc_id, i, 0 AS j, p FROM lines WHERE length(p) <= {config.CHAR_CHUNK_SIZE}
  UNION ALL SELECT doc_id, i, j, substr(p, j + 1, {config.CHAR_CHUNK_SIZE}) FROM lines,
    LATERAL (SELECT unnest(range(0, length(p), {config.CHAR_CHUNK_SIZE - config.CHAR_CHUNK_OVERLAP})) AS j) WHERE length(p) > {config.CHAR_CHUNK_SIZE}),
n AS (SELECT doc_id, p, length(p) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS rn FROM pieces WHERE p <> ''),
walk AS (
  SELECT doc_id, rn, 0::BIGINT AS b, len AS fill FROM n WHERE rn = 1
  UNION ALL SELECT n.doc_id, n.rn, CASE WHEN w.fill + n.len > {config.CHAR_CHUNK_SIZE} THEN w.b + 1 ELSE w.b END,
    CASE WHEN w.fill + n.len > {config.CHAR_CHUNK_SIZE} THEN n.len ELSE w.fill + n.len END
  FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.rn = w.rn + 1)
SELECT doc_id, b AS chunk_index, string_agg(p, '' ORDER BY rn) AS chunk, sum(len)::BIGINT AS n_chars FROM walk JOIN n USING (doc_id, rn) GROUP BY 1, 2
"""


@query(
    "chunk_chars",
    CHUNK_CHARS_SQL,
)
def chunk_chars(t):
    return chunk.chunk_chars(spread(t.documents.select("doc_id", "text")), "doc_id", "text")


@query(
    "text_units",
    f"""
WITH u AS (SELECT DISTINCT md5(text) AS doc, text FROM documents),
d AS (SELECT doc, {_TOKENS_SQL.format('text')} AS tk FROM u),
c AS (SELECT doc, tk, unnest(range(0, len(tk), {config.CHUNK_SIZE - config.CHUNK_OVERLAP})) AS s FROM d),
x AS (SELECT doc, s // {config.CHUNK_SIZE - config.CHUNK_OVERLAP} AS k, array_to_string(tk[s + 1 : s + {config.CHUNK_SIZE}], '') AS chunk,
  len(tk[s + 1 : s + {config.CHUNK_SIZE}])::INTEGER AS n_tokens FROM c)
SELECT md5(doc || chr(1) || k || chr(1) || chunk) AS id, doc AS document, md5(chunk) AS chunk_md5, n_tokens FROM x
""",
)
def text_units(t):
    docs = documents.documents_table(t.documents, "text", F.col("source")).dropDuplicates(["id"])
    units = chunk.text_units(docs)
    return units.select("id", F.element_at("document_ids", 1).alias("document"), F.md5("chunk").alias("chunk_md5"), "n_tokens")


_DOC_TOKENS = f"(SELECT doc_id, source, len({_TOKENS_SQL.format('text')}) AS n FROM documents)"


@query(
    "budget_prefix",
    f"""
SELECT source, doc_id, n AS n_tokens, running_tokens FROM (
  SELECT source, doc_id, n, sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running_tokens FROM {_DOC_TOKENS})
WHERE running_tokens <= 4000
""",
)
def budget_prefix(t):
    docs = t.documents.select("source", "doc_id", tok.count(F.col("text")).cast("long").alias("n_tokens"))
    return budget.prefix(docs, ["source"], ["doc_id"], F.col("n_tokens"), 4000)


def walk_sql(items: str, key: str, limit: int, head: int = 0, max_items: int | None = None) -> str:
    """Greedy packing in SQL: items(key, rn, n) to walk(key, rn, batch)."""
    full = f"w.fill + i.n > {limit}" + (f" OR w.cnt >= {max_items}" if max_items else "")
    return f"""
WITH RECURSIVE items AS ({items}),
walk AS (
  SELECT {key}, rn, 0::BIGINT AS batch, n + {head} AS fill, 1 AS cnt FROM items WHERE rn = 1
  UNION ALL SELECT i.{key}, i.rn, CASE WHEN {full} THEN w.batch + 1 ELSE w.batch END,
    CASE WHEN {full} THEN {head} + i.n ELSE w.fill + i.n END, CASE WHEN {full} THEN 1 ELSE w.cnt + 1 END
  FROM walk w JOIN items i ON i.{key} = w.{key} AND i.rn = w.rn + 1)
"""


@query(
    "budget_batches",
    walk_sql(f"SELECT source, doc_id, n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM {_DOC_TOKENS}", "source", 1500)
    + "SELECT source, doc_id, n AS n_tokens, batch FROM walk JOIN items USING (source, rn)",
)
def budget_batches(t):
    docs = t.documents.select("source", "doc_id", tok.count(F.col("text")).cast("long").alias("n_tokens"))
    return budget.pack(docs, ["source"], ["doc_id"], "n_tokens", 1500)


# ---------------------------------------------------------------- prompted extraction


@query(
    "model_map",
    """
SELECT doc_id, CASE WHEN len(l) = 1 THEN l[1] ELSE l[1] || ' and ' || (len(l) - 1) || ' more' END AS output
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
""",
)
def model_map(t):
    return apply.model_map(t.documents, offline.summarize, "text", ["doc_id"])


def _fail_first(texts, attempt):
    """Answers that are only valid from the second attempt on for longer texts."""
    return ["bad" if attempt == 1 and len(x) > 1000 else f"ok {len(x)}" for x in texts]


@query("model_retry", "SELECT doc_id, CASE WHEN length(text) > 1000 THEN 2 ELSE 1 END::INTEGER AS attempt, 'ok ' || length(text) AS output FROM documents")
def model_retry(t):
    done, _ = apply.model_retry(t.documents.select("doc_id", "text"), _fail_first, "text", "doc_id", lambda c: c.startswith("ok"), 3)
    return done


MENTIONS_SQL = f"""
WITH chunks AS ({_CHUNKS_SQL}),
w AS (SELECT doc_id, chunk_index, unnest(regexp_extract_all(chunk, '\\p{{L}}{{9,}}')) AS term,
  generate_subscripts(regexp_extract_all(chunk, '\\p{{L}}{{9,}}'), 1) AS i FROM chunks),
pairs AS (SELECT a.doc_id, a.chunk_index, a.i, a.term AS x, b.term AS y FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.chunk_index = b.chunk_index AND b.i = a.i + 1
  WHERE replace(upper(a.term), 'ẞ', 'SS') <> replace(upper(b.term), 'ẞ', 'SS'))
"""


def mention_records(t, size=_SIZE, overlap=_OVERLAP):
    """Extraction records of all documents: chunk, answer, parse."""
    chunks = chunk.chunk_tokens(spread(t.documents.select("doc_id", "text")), "text", size, overlap)
    answers = offline.answer_extraction(chunks, "chunk", ["doc_id", "chunk_index"])
    return records.parse_records(answers, "output", ["doc_id", "chunk_index"])


@query(
    "parse_records",
    MENTIONS_SQL
    + """
SELECT doc_id, chunk_index, 'entity' AS kind, replace(upper(term), 'ẞ', 'SS') AS title, 'TERM' AS type, NULL AS source, NULL AS target, 'seen as ' || term AS description, NULL AS weight FROM w
UNION ALL SELECT doc_id, chunk_index, 'relationship', NULL, NULL, replace(upper(x), 'ẞ', 'SS'), replace(upper(y), 'ẞ', 'SS'), x || ' before ' || y, 1.0::DOUBLE FROM pairs
""",
)
def parse_records(t):
    return mention_records(t).drop("record")


@query(
    "extract_graph",
    MENTIONS_SQL
    + """
, e AS (SELECT doc_id, chunk_index, count(*) AS entities FROM w GROUP BY 1, 2), r AS (SELECT doc_id, chunk_index, count(*) AS relationships FROM pairs GROUP BY 1, 2)
SELECT doc_id, chunk_index, entities, coalesce(relationships, 0) AS relationships FROM e LEFT JOIN r USING (doc_id, chunk_index)
""",
)
def extract_graph(t):
    return mention_records(t).groupBy("doc_id", "chunk_index").agg(
        F.count_if(F.col("kind") == "entity").alias("entities"), F.count_if(F.col("kind") == "relationship").alias("relationships")
    )


@query(
    "cooccurrence_graph",
    MENTIONS_SQL + "SELECT least(replace(upper(x), 'ẞ', 'SS'), replace(upper(y), 'ẞ', 'SS')) AS source, greatest(replace(upper(x), 'ẞ', 'SS'), replace(upper(y), 'ẞ', 'SS')) AS target, count(*) AS n FROM pairs GROUP BY 1, 2",
)
def cooccurrence_graph(t):
    edges = records.relationships(mention_records(t), ["doc_id", "chunk_index"])
    return edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@query("summarize_lines", """
WITH l AS (SELECT DISTINCT source, lang || ' ' || n_chars AS line FROM documents),
s AS (SELECT source, list(line ORDER BY line) AS lines FROM l GROUP BY 1)
SELECT source, CASE WHEN len(lines) = 1 THEN lines[1] ELSE lines[1] || ' and ' || (len(lines) - 1) || ' more' END AS summary FROM s
""")
def summarize_lines(t):
    from kgspark.model.summarize import summarize_lines as run

    lines = t.documents.select("source", F.concat_ws(" ", "lang", F.col("n_chars").cast("string")).alias("line"))
    return run(lines, "source", "line", offline.summarize)


@query(
    "questions",
    """
SELECT e.topic, r_regionkey AS question_no, 'How often is ' || e.topic || ' seen in ' || r_name || '?' AS question
FROM (SELECT DISTINCT event_type AS topic FROM events) e, region
""",
)
def questions(t):
    templates = t.region.select("r_regionkey", F.concat(F.lit("How often is {topic} seen in "), "r_name", F.lit("?")).alias("template"))
    topics = t.events.select(F.col("event_type").alias("topic")).distinct()
    return prompts.questions(topics, "topic", templates, "r_regionkey", "template")


@query(
    "prior_knowledge",
    "SELECT conv_id, 0::BIGINT AS page, string_agg(text, chr(10) ORDER BY turn) AS prior_knowledge FROM conversations WHERE role = 'assistant' GROUP BY 1",
)
def prior_knowledge(t):
    answers = t.conversations.filter("role = 'assistant'")
    return prompts.prior_knowledge(answers, "conv_id", "turn", "text")




def _glean(prompts, r):
    return [f'("entity"<|>"ROUND {r} OF {p.count(" ")}"<|>"TERM"<|>"seen")' for p in prompts]


def _more(prompts, r):
    return ["yes" if p.count(" ") % 3 >= r else "no" for p in prompts]


_BLANKS = "(length({0}) - length(replace({0}, ' ', '')))"


@query(
    "extract_gleaning",
    f"""
WITH a AS (SELECT item_id, text, '("entity"<|>"ROUND 0 OF ' || {_BLANKS.format('text')} || '"<|>"TERM"<|>"seen")' AS o, 1 AS n FROM benchmark),
b AS (SELECT *, {_BLANKS.format('text')} + {_BLANKS.format('o')} AS seen FROM a),
c AS (SELECT *, (seen + {_BLANKS.format("'Are records still missing? Answer YES or NO.'")}) % 3 >= 1 AS go1,
  o || '##' || '("entity"<|>"ROUND 1 OF ' || (seen + {_BLANKS.format("'Some records are still missing. Write the missing ones only, in the same format.'")}) || '"<|>"TERM"<|>"seen")' AS o1 FROM b),
d AS (SELECT *, {_BLANKS.format('text')} + {_BLANKS.format('o1')} AS seen1 FROM c),
e AS (SELECT *, go1 AND (seen1 + {_BLANKS.format("'Are records still missing? Answer YES or NO.'")}) % 3 >= 2 AS go2,
  o1 || '##' || '("entity"<|>"ROUND 2 OF ' || (seen1 + {_BLANKS.format("'Some records are still missing. Write the missing ones only, in the same format.'")}) || '"<|>"TERM"<|>"seen")' AS o2 FROM d)
SELECT item_id, CASE WHEN go2 THEN o2 WHEN go1 THEN o1 ELSE o END AS output, CASE WHEN go2 THEN 3 WHEN go1 THEN 2 ELSE 1 END AS n_rounds FROM e
""",
)
def extract_gleaning(t):
    return gleaning.extract_with_gleaning(t.benchmark, "item_id", "text", _glean, 2, _more)
