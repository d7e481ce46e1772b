"""Queries of quality measures.

Truth and generated value: the price of an order and the sum of its lines.
Expert scores: every line scores the brand of its part, read as two sheets.
Selected features: brands with a discount above the mean, per line status and
return flag.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.plans.registry import query
from kgspark.quality import agreement, distribution
from kgspark.session import cut

_PAIRS = """pairs AS (SELECT o_orderkey, o_totalprice AS x, y FROM orders JOIN (
  SELECT l_orderkey, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def _pairs(t):
    generated = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("total"))
    return distribution.paired(t.orders, generated, "o_orderkey", "o_totalprice", "total")


@query("rmse", f"WITH {_PAIRS} SELECT round(sqrt(avg((x - y) * (x - y))), 4) AS rmse FROM pairs")
def rmse(t):
    return distribution.rmse(_pairs(t)).withColumn("rmse", F.round("rmse", 4))


_KS = f"""WITH {_PAIRS}, v AS (SELECT x AS v, 1 AS a, 0 AS b FROM pairs UNION ALL SELECT y, 0, 1 FROM pairs),
c AS (SELECT v, sum(a) AS a, sum(b) AS b FROM v GROUP BY 1),
r AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb FROM c),
ks AS (SELECT max(abs(fa - fb)) AS ks, (SELECT count(*) FROM pairs) AS n FROM r)"""


@query("ks_statistic", f"{_KS} SELECT round(ks, 9) AS ks, n AS n1, n AS n2 FROM ks")
def ks_statistic(t):
    return distribution.ks_statistic(cut(_pairs(t))).withColumn("ks", F.round("ks", 9))


@query(
    "ks_pvalue",
    """
WITH d AS (SELECT event_id, user_id / 1000.0::DOUBLE AS ks, 100 + event_id % 50 AS n1, 200 AS n2 FROM events),
l AS (SELECT event_id, sqrt(n1 * n2 / (n1 + n2)::DOUBLE) * ks AS lam FROM d)
SELECT event_id, round(CASE WHEN lam < 0.2 THEN 1 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101),
  lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * lam * lam))))) END, 8) AS p_value FROM l
""",
)
def ks_pvalue(t):
    n1 = (100 + F.col("event_id") % 50).cast("double")
    p = distribution.ks_pvalue(F.col("user_id") / 1000.0, n1, F.lit(200.0))
    return t.events.select("event_id", F.round(p, 8).alias("p_value"))


@query(
    "ks_pvalue_exact",
    """
WITH RECURSIVE asked AS (SELECT DISTINCT 3 + event_id % 7 AS n1, 4 + event_id % 9 AS n2, 1 + user_id % ((3 + event_id % 7) * (4 + event_id % 9)) AS reach FROM events),
walk AS (
  SELECT n1, n2, reach, 0 AS i, list_transform(range(0, n2 + 1), lambda j: (j * n1 < reach)::INT::DOUBLE) AS u FROM asked
  UNION ALL SELECT n1, n2, reach, i + 1, list_transform(range(0, n2 + 1), lambda j: CASE WHEN abs((i + 1) * n2 - j * n1) < reach THEN
    list_sum(list_transform(range(0, j + 1), lambda x: CASE WHEN abs((i + 1) * n2 - x * n1) < reach THEN u[x + 1] ELSE 0 END)) ELSE 0 END)
  FROM walk WHERE i < n1),
p AS (SELECT n1, n2, reach, 1 - u[n2 + 1] * factorial(n1::INT)::DOUBLE * factorial(n2::INT)::DOUBLE / factorial((n1 + n2)::INT)::DOUBLE AS p FROM walk WHERE i = n1)
SELECT event_id, round(p, 9) + 0 AS p_value FROM events JOIN p ON n1 = 3 + event_id % 7 AND n2 = 4 + event_id % 9 AND reach = 1 + user_id % (n1 * n2)
""",
)
def ks_pvalue_exact(t):
    n1, n2 = 3 + F.col("event_id") % 7, 4 + F.col("event_id") % 9
    p = distribution.ks_pvalue_exact((1 + F.col("user_id") % (n1 * n2)) / (n1 * n2), n1, n2)
    return t.events.select("event_id", (F.round(p, 9) + 0).alias("p_value"))


_JS = f"""WITH {_PAIRS}, s AS (SELECT x / sum(x) OVER () AS p, y / sum(y) OVER () AS q FROM pairs)
SELECT round(sqrt(sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2), 8) AS js FROM s"""


@query("js_distance", _JS)
def js_distance(t):
    return distribution.js_distance(_pairs(t)).withColumn("js", F.round("js", 8))


@query(
    "metrics_table",
    f"""
WITH q AS (SELECT l_orderkey, avg(l_quantity) AS x, max(l_quantity) AS y FROM lineitem GROUP BY 1),
d AS (SELECT l_orderkey, avg(l_tax) AS x, avg(l_discount) AS y FROM lineitem GROUP BY 1),
f AS (SELECT 'quantity' AS feature, x, y FROM q UNION ALL SELECT 'rate', x, y FROM d),
c AS (SELECT feature, v, sum(a) AS a, sum(b) AS b FROM (SELECT feature, x AS v, 1 AS a, 0 AS b FROM f UNION ALL SELECT feature, y, 0, 1 FROM f) GROUP BY 1, 2),
r AS (SELECT feature, abs(sum(a) OVER (PARTITION BY feature ORDER BY v) / sum(a) OVER (PARTITION BY feature)
  - sum(b) OVER (PARTITION BY feature ORDER BY v) / sum(b) OVER (PARTITION BY feature)) AS gap FROM c)
SELECT feature, 'rmse' AS metric, round(sqrt(avg((x - y) * (x - y))), 5) AS value FROM f GROUP BY 1
UNION ALL SELECT feature, 'ks', round(max(gap), 5) FROM r GROUP BY 1
UNION ALL SELECT feature, 'p_value', round(CASE WHEN lam < 0.2 THEN 1 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101),
  lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * lam * lam))))) END, 5)
  FROM (SELECT feature, sqrt(n * n / (n + n)) * ks AS lam FROM (SELECT feature, max(gap) AS ks FROM r GROUP BY 1) JOIN (SELECT feature, count(*)::DOUBLE AS n FROM f GROUP BY 1) USING (feature))
UNION ALL SELECT feature, 'js', round(sqrt(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 5)
  FROM (SELECT feature, x / sum(x) OVER (PARTITION BY feature) AS p, y / sum(y) OVER (PARTITION BY feature) AS q FROM f) GROUP BY 1
""",
)
def metrics_table(t):
    # rounded so that equal means are equal values for the ties of the running counts
    by_order = t.lineitem.groupBy("l_orderkey").agg(
        F.avg("l_quantity").alias("q"), F.max("l_quantity").alias("m"), F.avg("l_tax").alias("t"), F.avg("l_discount").alias("d")
    )
    by_order = cut(by_order)
    features = {
        "quantity": by_order.select(F.col("q").alias("x"), F.col("m").alias("y")),
        "rate": by_order.select(F.col("t").alias("x"), F.col("d").alias("y")),
    }
    return distribution.metrics_table(features).withColumn("value", F.round("value", 5))


@query(
    "histogram",
    """
WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT unnest(range(20))::INTEGER AS bin),
c AS (SELECT least(floor((value - lo) / ((hi - lo) / 20))::INTEGER, 19) AS bin, count(*) AS n FROM events, m GROUP BY 1)
SELECT bin, round(lo + bin * (hi - lo) / 20, 6) AS low, round(lo + (bin + 1) * (hi - lo) / 20, 6) AS high, coalesce(n, 0) AS n
FROM m CROSS JOIN b LEFT JOIN c USING (bin)
""",
)
def histogram(t):
    out = distribution.histogram(t.events, "value")
    return out.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query(
    "density_grid",
    """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, stddev_samp(value) AS sd FROM events),
g AS (SELECT i, lo + i * (hi - lo) / 49 AS gx, sd * power(n, -0.2) AS h, n FROM s, (SELECT unnest(range(50)) AS i))
SELECT i::INTEGER AS grid_no, round(any_value(gx), 6) AS x, round(sum(exp(-0.5 * power((value - gx) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 8) AS density
FROM g, events GROUP BY 1
""",
)
def density_grid(t):
    return distribution.density_grid(t.events, "value").withColumns({"x": F.round("x", 6), "density": F.round("density", 8)})


@query(
    "measures_degenerate",
    """
SELECT 'histogram' AS measure, 20 AS n, (SELECT count(*) FROM events)::DOUBLE AS value
UNION ALL SELECT 'density_grid', 0, NULL UNION ALL SELECT 'js_distance', 1, NULL
""",
)
def measures_degenerate(t):
    """Constant columns and vectors that sum to zero."""
    flat = t.events.select(F.lit(3.0).alias("value"), F.lit(0.0).alias("x"), F.col("value").alias("y"))
    bins = distribution.histogram(flat, "value").agg(F.lit("histogram").alias("measure"), F.count(F.lit(1)).cast("int").alias("n"), F.sum("n").cast("double").alias("value"))
    grid = distribution.density_grid(flat, "value").agg(F.lit("density_grid").alias("measure"), F.count(F.lit(1)).cast("int").alias("n"), F.sum("density").alias("value"))
    js = distribution.js_distance(flat).agg(F.lit("js_distance").alias("measure"), F.count(F.lit(1)).cast("int").alias("n"), F.max("js").alias("value"))
    return bins.unionByName(grid).unionByName(js)


# ---------------------------------------------------------------- agreement with experts

_COLUMNS = ["plausibility", "relevance"]


def _sheets(t):
    """Two score sheets; '?' stands for no score."""
    lines = t.lineitem.join(t.part.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    feature = F.lower(F.concat_ws(" ", "p_brand", "p_type")).alias("feature")
    score = lambda c: F.when(F.col("l_tax") < 0.01, "?").otherwise((1 + c % 4).cast("int").cast("string"))
    pick = [feature, score(F.col("l_partkey")).alias("plausibility"), score(F.col("l_partkey") + F.col("l_linenumber")).alias("relevance")]
    return [lines.filter("l_returnflag = 'R'").select(*pick), lines.filter("l_returnflag <> 'R'").select(*pick)]


_FEATURE = "lower(p_brand || ' ' || p_type)"
_SCORES = f"""sc AS (SELECT {_FEATURE} AS feature, avg(CASE WHEN l_tax >= 0.01 THEN 1 + l_partkey % 4 END) AS plausibility,
  avg(CASE WHEN l_tax >= 0.01 THEN 1 + (l_partkey + l_linenumber) % 4 END) AS relevance FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


def _scores(t):
    return agreement.combine_scores(_sheets(t), "feature", _COLUMNS)


@query("combine_scores", f"WITH {_SCORES} SELECT feature, round(plausibility, 6) AS plausibility, round(relevance, 6) AS relevance FROM sc")
def combine_scores(t):
    return _scores(t).withColumns({c: F.round(c, 6) for c in _COLUMNS})


@query(
    "harmonize_names",
    "SELECT c_custkey, coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, c_name) AS feature FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey",
)
def harmonize_names(t):
    synonyms = t.supplier.filter("s_acctbal > 0").select(
        F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("name"), F.col("s_name").alias("standard")
    )
    return agreement.harmonize(t.customer.select("c_custkey", F.col("c_name").alias("feature")), "feature", synonyms)


_SELECTED = f"""al AS (SELECT l_linestatus AS feature_set, l_returnflag AS model, {_FEATURE} AS feature, avg(l_discount) AS d
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3), se AS (SELECT feature_set, model, feature FROM al WHERE d > 0.052),
av AS (SELECT DISTINCT feature_set, feature FROM al WHERE feature_set = 'F' OR feature LIKE '%small')"""


def _selections(t):
    """(selected, available) features."""
    lines = t.lineitem.join(t.part.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    each = cut(
        lines.groupBy(
            F.col("l_linestatus").alias("feature_set"), F.col("l_returnflag").alias("model"), F.lower(F.concat_ws(" ", "p_brand", "p_type")).alias("feature")
        ).agg(F.avg("l_discount").alias("d"))
    )
    available = each.filter("feature_set = 'F' OR feature LIKE '%small'").select("feature_set", "feature").distinct()
    return each.filter("d > 0.052").select("feature_set", "model", "feature"), available


@query(
    "agreement_corr",
    f"""WITH {_SCORES}, {_SELECTED}, g AS (SELECT DISTINCT feature_set, model FROM se),
j AS (SELECT feature_set, model, plausibility, relevance, CASE WHEN se.feature IS NULL THEN 1 ELSE 4 END AS y
  FROM g JOIN av USING (feature_set) JOIN sc USING (feature) LEFT JOIN se USING (feature_set, model, feature))
SELECT feature_set, model, round(corr(plausibility, y), 6) AS corr_plausibility, round(corr(relevance, y), 6) AS corr_relevance FROM j GROUP BY 1, 2""",
)
def agreement_corr(t):
    selected, available = _selections(t)
    out = agreement.agreement_corr(_scores(t), selected, available, _COLUMNS)
    return out.withColumns({c: F.round(c, 6) for c in ("corr_plausibility", "corr_relevance")})


@query(
    "shared_features",
    f"WITH {_SCORES}, {_SELECTED}, w AS (SELECT min(model) AS a, max(model) AS b FROM se) "
    "SELECT feature_set, feature FROM se, w WHERE model = a INTERSECT SELECT feature_set, feature FROM se, w WHERE model = b",
)
def shared_features(t):
    """What the first and the last model by name have in common."""
    selected, _ = _selections(t)
    ends = selected.agg(F.min("model"), F.max("model")).first()
    return agreement.shared_features(selected, *ends)


@query(
    "agreement_corr_missing",
    f"""WITH {_SCORES}, {_SELECTED}, g AS (SELECT DISTINCT feature_set, model FROM se),
j AS (SELECT feature_set, model, CASE WHEN feature LIKE 'brand#1%' THEN NULL ELSE plausibility END AS plausibility,
    1e6 + CASE WHEN feature LIKE '%tin%' THEN NULL ELSE relevance END AS relevance, CASE WHEN se.feature IS NULL THEN 1 ELSE 4 END AS y
  FROM g JOIN av USING (feature_set) JOIN sc USING (feature) LEFT JOIN se USING (feature_set, model, feature))
SELECT feature_set, model, round(corr(plausibility, y), 6) AS corr_plausibility, round(corr(relevance, y), 6) AS corr_relevance FROM
  (SELECT feature_set, model, plausibility, relevance, y FROM j) GROUP BY 1, 2""",
)
def agreement_corr_missing(t):
    """Scores missing in either column, and one column far from zero."""
    selected, available = _selections(t)
    scores = _scores(t).select(
        "feature",
        F.when(~F.col("feature").like("brand#1%"), F.col("plausibility")).alias("plausibility"),
        (1e6 + F.when(~F.col("feature").like("%tin%"), F.col("relevance"))).alias("relevance"),
    )
    out = agreement.agreement_corr(scores, selected, available, _COLUMNS)
    return out.withColumns({c: F.round(c, 6) for c in ("corr_plausibility", "corr_relevance")})


@query(
    "alignment_ratio",
    f"""WITH {_SCORES}, {_SELECTED}, im AS (SELECT feature FROM sc WHERE (plausibility + relevance) / 2 >= 2.55)
SELECT feature_set, model, count(*) AS n_selected, (SELECT count(*) FROM im) AS n_important, count(im.feature) AS n_aligned,
  round(count(im.feature) / count(*), 9) AS ratio FROM se LEFT JOIN im USING (feature) GROUP BY 1, 2""",
)
def alignment_ratio(t):
    out = agreement.alignment_ratio(_scores(t), _selections(t)[0], _COLUMNS, 2.55)
    return out.withColumn("ratio", F.round("ratio", 9))


@query(
    "corr_by_stratum",
    f"""WITH {_SCORES}, {_SELECTED}, u AS (SELECT DISTINCT model, feature FROM se)
SELECT model, CASE WHEN relevance >= 2.5 THEN 'high' ELSE 'low' END AS stratum, count(*) AS n, round(corr(plausibility, relevance), 6) AS corr
FROM u JOIN sc USING (feature) GROUP BY 1, 2""",
)
def corr_by_stratum(t):
    out = agreement.corr_by_stratum(_scores(t), _selections(t)[0], "plausibility", "relevance", 2.5)
    return out.withColumn("corr", F.round("corr", 6))


@query(
    "aligned_scores",
    f"""WITH {_SCORES}, {_SELECTED} SELECT feature_set, model, feature, round((plausibility + relevance) / 2, 6) AS score
FROM se JOIN sc USING (feature) WHERE (plausibility + relevance) / 2 >= 2.55""",
)
def aligned_scores(t):
    return agreement.aligned_scores(_scores(t), _selections(t)[0], _COLUMNS, 2.55).withColumn("score", F.round("score", 6))
