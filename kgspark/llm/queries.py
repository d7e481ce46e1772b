"""Registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.common import table
from kgspark.llm.decontaminate import contaminated
from kgspark.llm.exact_dedup import exact_duplicates
from kgspark.llm import language_id, license_scan, packing, secret_scan
from kgspark.llm.line_dedup import drop_repeated_lines
from kgspark.llm.ngram_join import near_duplicates
from kgspark.llm.periodic_runs import periodic_runs
from kgspark.llm.phrase_mining import collocations
from kgspark.llm.sharding import SHARDS, TABLE_SIZE, lookup_table, place
from kgspark.llm.site_style_tree import extract_main_text
from kgspark.llm.url_filter import judge_urls

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


KEY = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op4_line_dedup",
    f"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents),
    keyed AS (SELECT *, {KEY.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
    often AS (
        SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
        GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    marked AS (
        SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.keeper AS dropped
        FROM keyed k LEFT JOIN often o ON k.key = o.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query(
    "op5_decontamination",
    r"""
    WITH doc_words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
    item_words AS (
        SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
    doc_sh AS (
        SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5
            THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM doc_words)),
    item_sh AS (
        SELECT DISTINCT item_id, s FROM (SELECT item_id, unnest(CASE WHEN len(w) >= 5
            THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM item_words)),
    sizes AS (SELECT item_id, count(*) AS n_item FROM item_sh GROUP BY item_id)
    SELECT d.doc_id, i.item_id, count(*) AS n_shared, any_value(z.n_item) AS n_item
    FROM doc_sh d JOIN item_sh i ON d.s = i.s JOIN sizes z ON z.item_id = i.item_id
    GROUP BY d.doc_id, i.item_id HAVING count(*) * 100 >= any_value(z.n_item) * 80
    """,
)
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(
    "op6_exact_dedup",
    f"""
    WITH norm AS (SELECT doc_id, {KEY.format("coalesce(text, '')")} AS text FROM documents),
    groups AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY text)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
    FROM norm JOIN groups USING (text)
    """,
)
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SHARD_NAMES = [f"shard-{k:03d}" for k in range(SHARDS)]


@query(
    "op7_sharding",
    f"""
    WITH owners AS (
        SELECT unnest(range(0, {TABLE_SIZE})) AS slot,
               unnest(string_split('{",".join(map(str, lookup_table(SHARD_NAMES)))}', ','))::INT AS owner)
    SELECT doc_id, slot, 'shard-' || lpad(owner::VARCHAR, 3, '0') AS shard
    FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {TABLE_SIZE} AS slot FROM documents) d
    JOIN owners USING (slot)
    """,
)
def sharding(spark: SparkSession, folder: str) -> DataFrame:
    return place(table(spark, folder, "documents").select("doc_id"), "doc_id", SHARD_NAMES)


@query("op8_packing")
def packed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query("op10_language_id")
def language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.fit(docs)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == language_id.HELD_OUT, F.lit(False))
    judged = language_id.with_language(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score", "language.bits_per_byte")


WORDS = f"list_filter(regexp_split_to_array({KEY.format('text')}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


@query(
    "op1_ngram_join",
    f"""
    WITH RECURSIVE words AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
    sh AS (
        SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3
            THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)),
    sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    pairs AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
        FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * common >= 90 * (x.n + y.n - common)),
    reach AS (
        SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    lowest AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
    degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.low, d.doc_id)) AS component_id,
           coalesce(g.n, 0) AS n_links
    FROM documents d LEFT JOIN sizes n USING (doc_id) LEFT JOIN lowest l ON l.a = d.doc_id LEFT JOIN degree g ON g.a = d.doc_id
    """,
)
def ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), words=3, percent=90)


def _span_text(kinds: str) -> str:
    return f"array_join(transform(filter(secrets, s -> s.kind IN ({kinds})), s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


BASE_KINDS = "'assign', 'access', 'hex'"


@query("op2_secret_scan")
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs, secret_scan.fit(docs))
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(secrets, s -> s.kind = '{k}')) AS long)").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(F.expr(_span_text(BASE_KINDS)).cast("binary"), 256).alias("base_sha256"),
        F.expr(_span_text(BASE_KINDS + ", 'model'")).alias("spans"),
    )


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _chance_sql(order: int) -> str:
    """Smoothed chances of one order, over those of the order below."""
    own, head = f"substr(gram, {3 - order})", f"substr(own, 1, {order})"
    lower, join = ("1.0 / 42", "") if not order else ("q.p", f"JOIN p{order - 1} q ON q.k = s.k AND q.own = substr(s.own, 2)")
    return f"""s{order} AS (SELECT k, {own} AS own, sum(n) AS n FROM sides GROUP BY 1, 2),
    h{order} AS (SELECT k, {head} AS head, sum(n) AS total, sum((n > 0)::INT) AS kinds FROM s{order} GROUP BY 1, 2),
    p{order} AS (SELECT s.k, s.own, CASE WHEN total = 0 THEN {lower} ELSE (s.n + kinds * {lower}) / (total + kinds) END AS p
        FROM s{order} s JOIN h{order} h ON h.k = s.k AND h.head = {head.replace("own", "s.own")} {join})"""


@query(
    "op9_url_filter",
    rf"""
    WITH cut AS (SELECT page_id, url, strpos(coalesce(url, ''), '://') AS mark FROM pages),
    rest AS (
        SELECT page_id, url, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS tail,
               CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE url END AS body FROM cut),
    parts AS (
        SELECT page_id, url, body, {KEY.format("regexp_extract(tail, '^([^/?#]*)', 1)")} AS host,
               regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    rules(rule_host, rule_path, say) AS (VALUES {", ".join(map(str, URL_RULES))}),
    ruled AS (
        SELECT p.*, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
               arg_max(say, length(rule_host || rule_path)) AS label
        FROM parts p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        GROUP BY ALL),
    urls AS (
        SELECT DISTINCT url, label, ('0x' || substr(md5(url), 1, 8))::BIGINT % 5 AS fold,
               '^^' || regexp_replace(regexp_replace({KEY.format("body")}, '[0-9]', '0', 'g'), '[^a-z0\-._/?=&%#:~+]', '*', 'g') || '$' AS t
        FROM ruled WHERE url IS NOT NULL),
    grams AS (SELECT url, label, fold, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS gram FROM urls),
    sides AS (
        SELECT gram, 'a' AS k, count(*) FILTER (fold <> 0 AND label = 'allow') AS n FROM grams GROUP BY 1
        UNION ALL SELECT gram, 'b', count(*) FILTER (fold <> 0 AND label = 'block') FROM grams GROUP BY 1),
    {_chance_sql(0)},
    {_chance_sql(1)},
    {_chance_sql(2)},
    model AS (SELECT x.own AS gram, ln(x.p) - ln(y.p) AS gain FROM p2 x JOIN p2 y ON x.own = y.own WHERE x.k = 'a' AND y.k = 'b'),
    scores AS (SELECT url, sum(gain) / count(*) AS score FROM grams JOIN model USING (gram) GROUP BY 1),
    steps AS (
        SELECT round(greatest(least(score, 8), -8) * 100)::BIGINT AS step, count(*) FILTER (label = 'allow') AS good,
               count(*) FILTER (label = 'block') AS bad
        FROM urls JOIN scores USING (url) WHERE fold = 0 AND label IS NOT NULL GROUP BY 1),
    sums AS (
        SELECT step, sum(good) OVER (ORDER BY step) - good AS lost, sum(bad) OVER (ORDER BY step) - bad AS caught,
               sum(good) OVER () AS goods, sum(bad) OVER () AS bads FROM steps),
    least_score AS (SELECT (step - 0.5) / 100 AS least FROM sums ORDER BY 1 - lost / goods + caught / bads DESC, step LIMIT 1)
    SELECT page_id, host, path, rule, coalesce(label, CASE WHEN score >= least THEN 'allow' ELSE 'block' END) AS verdict,
           round(score, 6) AS score
    FROM ruled LEFT JOIN scores USING (url), least_score
    """,
)
def urls(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), URL_RULES).withColumn("score", F.round("score", 6))


@query("op3_license_scan")
def licenses(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return license_scan.find_licenses(docs, license_scan.fit(docs))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` with the words of every tenth hash of an id made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    planted = F.expr(
        """array_join(transform(w, (x, i) -> element_at(w, cast(if(i < a, i, a + (i - a) % p) AS int) + 1)), ' ')"""
    )
    return (
        docs.withColumn("h", h)
        # the words are made for the planted texts alone
        .withColumn("w", F.when(F.col("h") % 10 == 0, words))
        .withColumn("a", F.expr("CASE WHEN size(w) > 0 THEN (h div 10) % size(w) END"))
        .withColumn("p", F.expr("1 + (size(w) - a) div (3 + (h div 10) % 8)"))
        .select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))
    )


@query("op11_periodic_runs")
def runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(with_planted_periods(table(spark, folder, "documents")))
    longest = F.expr(
        """reduce(runs, cast(null AS struct<start:bigint,length:bigint,period:bigint>),
        (best, r) -> if(best IS NULL OR r.length > best.length, r, best))"""
    )
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "longest.start",
        "longest.length",
        "longest.period",
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def _grams_sql(size: int) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    return f"SELECT lang, {size} AS size, unnest(list_transform(range(1, len(w) - {size - 2}), lambda i: {gram})) AS phrase FROM words"


@query(
    "op12_phrase_mining",
    rf"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({KEY.format("coalesce(text, '')")}, '[.,;:!?
-
]')) AS piece FROM documents),
    words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda w: w <> '') AS w FROM pieces),
    grams AS ({_grams_sql(1)} UNION ALL {_grams_sql(2)} UNION ALL {_grams_sql(3)}),
    f AS (SELECT lang, phrase, any_value(size) AS size, count(*) AS a FROM grams GROUP BY lang, phrase),
    totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
    candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
    longer AS (
        SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM candidates WHERE size = 3),
    covered AS (SELECT lang, phrase, max(a) AS most FROM longer GROUP BY lang, phrase),
    kept AS (
        SELECT c.* FROM candidates c LEFT JOIN covered v ON v.lang = c.lang AND v.phrase = c.phrase
        WHERE most IS NULL OR 100 * most < 50 * a),
    cuts AS (
        SELECT lang, phrase, a, 1 AS k, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM kept
        UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM kept WHERE size = 3),
    scored AS (
        SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, (1000000::HUGEINT * c.a * c.a // (l.a::HUGEINT * r.a))::BIGINT AS score
        FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = x JOIN f r ON r.lang = c.lang AND r.phrase = y),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
)
def phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


@query("op13_html_extraction")
def articles(spark: SparkSession, folder: str) -> DataFrame:
    found = extract_main_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
