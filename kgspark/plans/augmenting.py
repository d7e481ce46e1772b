"""Queries of table augmentation: specifications, prompts, answer checks, wide rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.augment import job, rows, spec
from kgspark.plans.registry import query
from kgspark.plans.texts import _REPORT_SQL, _customer_report
from kgspark.session import scratch_path
from kgspark.sources import tables

SPEC = {"Open Order": "boolean", "Order Value": "numerical", "Rush": "boolean"}


def _spec_answers(t):
    """Feature answers per event: a number feature per type and one whose type differs by user."""
    kind = F.when(F.col("user_id") % 3 == 0, "boolean").otherwise("numerical")
    text = F.concat(
        F.lit('```json\n{"'), F.initcap("event_type"), F.lit(' Rate": "numerical", "Risk  of '), F.col("event_type"), F.lit('": "'), kind, F.lit('", "Note": "text",}\n```')
    )
    return t.events.select("event_id", text.alias("output"))


_SPECS = """(
SELECT event_id, upper(event_type[1]) || event_type[2:] || ' Rate' AS feature, 'numerical' AS dtype FROM events
UNION ALL SELECT event_id, 'Risk  of ' || event_type, CASE WHEN user_id % 3 = 0 THEN 'boolean' ELSE 'numerical' END FROM events)"""


@query("keyword_spec", f"SELECT event_id, feature, dtype FROM {_SPECS}")
def keyword_spec(t):
    return spec.keyword_spec(_spec_answers(t), ["event_id"], "output")


_MERGED = f"""(SELECT feature, dtype, mentions FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, dtype) AS rn,
  sum(n) OVER (PARTITION BY feature)::BIGINT AS mentions FROM (
  SELECT regexp_replace(lower(trim(feature)), '\\s+', ' ', 'g') AS feature, dtype, count(*) AS n FROM {_SPECS} GROUP BY 1, 2)) WHERE rn = 1)"""


@query("merge_specs", f"SELECT feature, dtype, mentions FROM {_MERGED}")
def merge_specs(t):
    return spec.merge_specs(spec.keyword_spec(_spec_answers(t), ["event_id"], "output"))


@query("existing_features", f"SELECT event_id, feature, dtype FROM {_SPECS} WHERE lower(feature) IN ('click rate', 'view rate')")
def existing_features(t):
    return spec.existing_features(spec.keyword_spec(_spec_answers(t), ["event_id"], "output"), ["Click Rate", " view  rate", "value"])


@query(
    "feature_ranges",
    f"""
WITH r AS (SELECT event_type || ' rate' AS feature, min(user_id)::DOUBLE AS lo, (max(user_id) + 1000)::DOUBLE AS hi FROM events GROUP BY 1)
SELECT feature, dtype, lo, hi FROM {_MERGED} LEFT JOIN r USING (feature) WHERE dtype = 'numerical'
""",
)
def feature_ranges(t):
    merged = spec.merge_specs(spec.keyword_spec(_spec_answers(t), ["event_id"], "output"))
    ranges = t.events.groupBy(F.concat(F.col("event_type"), F.lit(" rate")).alias("feature")).agg(
        F.concat(F.min("user_id").cast("string"), F.lit(" - "), F.format_number((F.max("user_id") + 1000).cast("double"), 0)).alias("range_text")
    )
    return spec.feature_ranges(merged, ranges).select("feature", "dtype", "lo", "hi")


@query(
    "feature_range_kinds",
    f"""
WITH r AS (SELECT event_type || ' rate' AS feature, min(user_id)::DOUBLE AS healthy_lo, (max(user_id) + 1000)::DOUBLE AS healthy_hi,
  CASE WHEN event_type <> 'view' THEN 0.5 END AS possible_lo, CASE WHEN event_type <> 'view' THEN max(user_id) + 2000.0 END::DOUBLE AS possible_hi FROM events GROUP BY event_type)
SELECT feature, dtype, healthy_lo, healthy_hi, possible_lo::DOUBLE AS possible_lo, possible_hi FROM {_MERGED} LEFT JOIN r USING (feature) WHERE dtype = 'numerical'
""",
)
def feature_range_kinds(t):
    merged = spec.merge_specs(spec.keyword_spec(_spec_answers(t), ["event_id"], "output"))
    sized = t.events.groupBy("event_type").agg(F.min("user_id").alias("lo"), F.max("user_id").alias("hi"))
    said = lambda kind, low, high: F.struct(F.lit(kind).alias("kind"), F.concat(low, F.lit(" to "), F.format_number(high.cast("double"), 0)).alias("range_text"))
    healthy = said("healthy", F.col("lo").cast("string"), F.col("hi") + 1000)
    possible = said("possible", F.when(F.col("event_type") == "view", "unknown").otherwise("0.5"), F.col("hi") + 2000)
    ranges = sized.select(F.concat("event_type", F.lit(" rate")).alias("feature"), F.inline(F.array(healthy, possible)))
    return spec.feature_range_kinds(merged, ranges).select("feature", "dtype", "healthy_lo", "healthy_hi", "possible_lo", "possible_hi")


@query(
    "row_prompts",
    f"""
SELECT c_custkey, '## Report' || chr(10) || {_REPORT_SQL} || chr(10) || chr(10) || '## Data types' || chr(10)
  || '{{"Open Order":"boolean","Order Value":"numerical","Rush":"boolean"}}' || chr(10) || chr(10) || '## Ranges' || chr(10)
  || '{{"Order Value":"0-500000"}}' || chr(10) || chr(10) || 'Give a value for every feature as one JSON object.' AS prompt FROM customer
""",
)
def row_prompts(t):
    out = rows.row_prompts(t.customer, _customer_report(), SPEC, {"Order Value": "0-500000"})
    return out.select("c_custkey", "prompt")


def _answers(t):
    """Model-like answers per order: complete, with missing or unknown keys, with placeholders, or unreadable."""
    value = F.col("o_custkey").cast("string")
    full = F.concat(F.lit('{"Open Order": '), (F.col("o_orderstatus") == "O").cast("string"), F.lit(', "Order Value": '), value, F.lit(', "Rush": true, "Colour": "red"}'))
    short = F.concat(F.lit('{"Order Value": '), value, F.lit("}"))
    types = F.lit('{"Open Order": "boolean", "Order Value": "numerical", "Rush": "boolean"}')
    n = F.col("o_orderkey") % 5
    output = (
        F.when(n == 0, F.lit("I cannot say."))
        .when(n == 1, F.concat(F.lit("Sure: "), short))
        .when(n == 2, F.concat(F.lit("As in "), types, F.lit(" this is "), full))
        .when(n == 3, F.concat(F.lit("Types: "), types))
        .otherwise(F.concat(F.lit("Here: "), full, F.lit(" done")))
    )
    return t.orders.select("o_orderkey", "o_orderstatus", output.alias("output"))


@query("missing_keys", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN 'Open Order,Rush' ELSE '' END AS missing,
  CASE WHEN o_orderkey % 5 IN (2, 4) THEN 'Colour' ELSE '' END AS extra FROM orders WHERE o_orderkey % 5 NOT IN (0, 3)
""")
def missing_keys(t):
    read = rows.read_answer(_answers(t)).filter("values IS NOT NULL")
    return read.select(
        "o_orderkey",
        F.array_join(rows.missing_keys(F.col("values"), list(SPEC)), ",").alias("missing"),
        F.array_join(rows.extra_keys(F.col("values"), list(SPEC)), ",").alias("extra"),
    )


@query("map_update", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS a, 'kept' AS b, CASE WHEN o_orderstatus = 'F' THEN 'added' END AS c FROM orders
""")
def map_update(t):
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("kept"))
    new = F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.lit("added"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    m = t.orders.select("o_orderkey", rows.update(old, new).alias("m"))
    return m.select("o_orderkey", *[F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"])


@query("placeholder_check", "SELECT o_orderkey, o_orderkey % 5 IN (0, 3) AS rejected FROM orders")
def placeholder_check(t):
    return rows.read_answer(_answers(t)).select("o_orderkey", F.col("values").isNull().alias("rejected"))


def _ask_again(gaps):
    """A second answer that knows one of the missing features."""
    return gaps.select("o_orderkey", F.create_map(F.lit("Open Order"), F.lit("false"), F.lit("Rush"), F.lit("false")).alias("values"))


@query("augment_wide", """
SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 1 THEN false ELSE o_orderstatus = 'O' END AS "Augmented_Open Order",
  o_custkey::DOUBLE AS "Augmented_Order Value", o_orderkey % 5 <> 1 AS "Augmented_Rush" FROM orders WHERE o_orderkey % 5 NOT IN (0, 3)
""")
def augment_wide(t):
    read = rows.read_answer(_answers(t))
    whole, _ = rows.complete(read, "o_orderkey", list(SPEC), _ask_again)
    return rows.wide(whole.drop("output"), SPEC)


@query("augment_rejects", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN 'missing: Open Order, Rush' ELSE 'no object' END AS reason FROM orders WHERE o_orderkey % 5 IN (0, 1, 3)
""")
def augment_rejects(t):
    _, rejects = rows.complete(rows.read_answer(_answers(t)), "o_orderkey", list(SPEC))
    return rejects


@query("failure_counts", "SELECT 'once' AS run, count(*) AS total, count(*) FILTER (o_orderkey % 5 IN (0, 1, 3)) AS failed FROM orders")
def failure_counts(t):
    whole, _ = rows.complete(rows.read_answer(_answers(t)), "o_orderkey", list(SPEC))
    return rows.failure_counts(t.orders, whole, "o_orderkey", "once")


@query("augment_resume", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 5 IN (0, 1, 3)")
def augment_resume(t):
    root = scratch_path(t.spark, "augmented")
    whole, _ = rows.complete(rows.read_answer(_answers(t)), "o_orderkey", list(SPEC))
    tables.save(rows.wide(whole.drop("output"), SPEC).select("o_orderkey"), root, "done")
    # a restarted run asks only for what is not there yet
    return rows.remaining(t.orders.select("o_orderkey", "o_orderstatus"), tables.load(t.spark, root, "done"), "o_orderkey")


@query("map_rename_keys", "SELECT p_partkey, p_brand AS brand, p_type AS kind FROM part")
def map_rename_keys(t):
    m = F.create_map(F.lit("brand (name)"), F.col("p_brand"), F.lit("kind"), F.col("p_type"))
    renamed = t.part.select("p_partkey", rows.rename_keys(m, {"brand (name)": "brand"}).alias("m"))
    return renamed.select("p_partkey", F.element_at("m", "brand").alias("brand"), F.element_at("m", "kind").alias("kind"))


def _model(prompts):
    """Answers all features, but leaves one out of every third answer by the length of the prompt."""
    out = []
    for p in prompts:
        rush = "" if len(p) % 3 == 0 else ', "Rush": "true"'
        out.append(f'Here: {{"Open Order": "false", "Order Value": "{len(p)}"{rush}}}')
    return out


def _second(prompts):
    return ['{"Rush": "false"}' if len(p) % 2 else "nothing" for p in prompts]


def _variants(t):
    """Rows augmented without and with retrieved texts (the customer's order priorities)."""
    context = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ", ").alias("context"))
    for name, texts in (("without", None), ("with", context)):
        whole, rejects = job.augment_table(t.customer, "c_custkey", F.col("c_name"), SPEC, {}, _model, _second, texts)
        yield name, whole, rejects


_JOB_SQL = r"""
WITH ctx AS (SELECT o_custkey AS c_custkey, string_agg(o_orderpriority, ', ' ORDER BY o_orderpriority) AS context FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) GROUP BY 1),
base AS (SELECT c_custkey, replace(replace(replace(replace('## Report#N{report}#N#N## Data types#N{spec}#N#N## Ranges#N{ranges}#N#NGive a value for every feature as one JSON object.', '#N', chr(10)),
  '{report}', c_name), '{spec}', '{"Open Order":"boolean","Order Value":"numerical","Rush":"boolean"}'), '{ranges}', '{}') AS p FROM customer),
q AS (SELECT 'without' AS run, c_custkey, p FROM base UNION ALL
  SELECT 'with', c_custkey, p || coalesce(chr(10) || chr(10) || '## Retrieved texts' || chr(10) || context, '') FROM base LEFT JOIN ctx USING (c_custkey)),
a AS (SELECT *, length(p) % 3 = 0 AS gap, length(p || chr(10) || chr(10) || 'Missing: Rush') % 2 = 1 AS told FROM q)
SELECT run, c_custkey, p AS augmenting_query, 'Here: {"Open Order": "false", "Order Value": "' || length(p) || '"' || CASE WHEN gap THEN '' ELSE ', "Rush": "true"' END || '}' AS augmenting_output,
  false AS open_order, length(p)::DOUBLE AS order_value, NOT gap AS rush
FROM a WHERE NOT gap OR told
"""


@query("augment_job", _JOB_SQL)
def augment_job(t):
    out = None
    for name, whole, _ in _variants(t):
        part = whole.select(
            F.lit(name).alias("run"),
            "c_custkey",
            "augmenting_query",
            "augmenting_output",
            F.col("`Augmented_Open Order`").alias("open_order"),
            F.col("`Augmented_Order Value`").alias("order_value"),
            F.col("Augmented_Rush").alias("rush"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "augment_variants",
    f"""SELECT run, total, total - (SELECT count(*) FROM ({_JOB_SQL}) j WHERE j.run = v.run) AS failed
FROM (VALUES ('without'), ('with')) v(run), (SELECT count(*) AS total FROM customer)""",
)
def augment_variants(t):
    return job.compare_variants(t.customer, "c_custkey", {name: whole for name, whole, _ in _variants(t)})
