"""Filtering of URLs: host and path rules first, then a ratio of two character models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import lower_ascii, staged

# Symbols of the models: a-z, 0 for any digit, these marks, and * for all else; ^ starts, $ ends.
MARKS = r"\-._/?=&%#:~+"
ORDER = 2
STEPS = 100
LIMIT = 8.0


def symbols(url: Column) -> Column:
    """The URL without its scheme, in 42 symbols at most."""
    at = F.instr(url, "://")
    body = F.when(at > 0, F.substr(url, at + 3)).otherwise(url)
    plain = F.regexp_replace(F.regexp_replace(lower_ascii(body), "[0-9]", "0"), rf"[^a-z0{MARKS}]", "*")
    return F.concat(F.lit("^" * ORDER), plain, F.lit("$"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#``; path: then up to ``?``, ``#``. Empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule (host, path, verdict) that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, say in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(say)).otherwise(verdict)
    return name, verdict


def gram_counts(urls: DataFrame) -> DataFrame:
    """gram, accepted, rejected: runs of three symbols of all URLs, counted over the training folds.

    There are 42 symbols, so never more than 42 ** 3 rows, whatever the data.
    """
    runs = F.transform(F.sequence(F.lit(1), F.length("text") - ORDER), lambda i: F.substr(F.col("text"), i, F.lit(ORDER + 1)))
    rows = urls.select("label", "fold", F.explode(runs).alias("gram"))
    count = [F.sum(F.when((F.col("fold") != 0) & (F.col("label") == k), 1).otherwise(0)).alias(a) for k, a in (("allow", "accepted"), ("block", "rejected"))]
    return rows.groupBy("gram").agg(*count)


def _share(grams: DataFrame, count: str) -> DataFrame:
    """gram, p: smoothed chance of the last symbol after the others, over variable-order contexts.

    A context seen ``n`` times with ``t`` different symbols keeps ``n / (n + t)`` for its own counts
    and hands the rest to the context one symbol shorter; below the empty one all symbols are equal.
    A context never seen hands all of it down.
    """
    seen = grams.select("gram", F.col(count).alias("n"))
    p = seen.select("gram").withColumn("p", F.lit(1.0 / 42))
    for order in range(ORDER + 1):
        own = seen.groupBy(F.substr("gram", F.lit(ORDER + 1 - order)).alias("own")).agg(F.sum("n").alias("n"))
        head = own.groupBy(F.expr(f"substr(own, 1, {order})").alias("head")).agg(
            F.sum("n").alias("total"), F.sum((F.col("n") > 0).cast("long")).alias("kinds")
        )
        p = (
            p.withColumn("own", F.substr("gram", F.lit(ORDER + 1 - order)))
            .withColumn("head", F.expr(f"substr(own, 1, {order})"))
            .join(own, "own")
            .join(head, "head")
            .select("gram", F.when(F.col("total") == 0, F.col("p")).otherwise((F.col("n") + F.col("kinds") * F.col("p")) / (F.col("total") + F.col("kinds"))).alias("p"))
        )
    return p


def ratio_model(grams: DataFrame) -> DataFrame:
    """gram, gain: log of the chance among accepted over that among rejected."""
    accepted, rejected = _share(grams, "accepted"), _share(grams, "rejected")
    return accepted.join(rejected.withColumnRenamed("p", "q"), "gram").select("gram", (F.ln("p") - F.ln("q")).alias("gain"))


def scored(urls: DataFrame, model: DataFrame) -> DataFrame:
    """url, score: the mean gain over the symbols of each distinct URL. The model has a fixed bound, so it is broadcast."""
    runs = F.transform(F.sequence(F.lit(1), F.length("text") - ORDER), lambda i: F.substr(F.col("text"), i, F.lit(ORDER + 1)))
    rows = urls.select("url", F.explode(runs).alias("gram")).join(F.broadcast(model), "gram")
    return rows.groupBy("url").agg((F.sum("gain") / F.count("*")).alias("score"))


def threshold(labelled: DataFrame) -> float:
    """The score that best parts accepted from rejected URLs of the fold kept aside, by balanced accuracy.

    Scores are counted in steps of 1 / ``STEPS`` between -``LIMIT`` and ``LIMIT``: a bounded table.
    Without both kinds the threshold is 0, where both models say the same.
    """
    step = F.round(F.greatest(F.least("score", F.lit(LIMIT)), F.lit(-LIMIT)) * STEPS).cast("long")
    rows = labelled.groupBy(step.alias("step")).agg(
        F.sum((F.col("label") == "allow").cast("long")).alias("good"), F.sum((F.col("label") == "block").cast("long")).alias("bad")
    ).orderBy("step").collect()
    good, bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not good or not bad:
        return 0.0
    best, at, lost, caught = -1.0, 0.0, 0, 0
    for r in rows:
        value = (1 - lost / good) + caught / bad
        if value > best:
            best, at = value, (r["step"] - 0.5) / STEPS
        lost, caught = lost + r["good"], caught + r["bad"]
    return at


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``score``: one row per row of ``pages``.

    A rule's verdict stands. URLs that rules decide teach the two character models, all but every
    fifth by hash, which calibrate the threshold; other URLs are allowed if their score reaches it.
    A null URL has no score and is blocked unless a rule says otherwise. Repeated rows and URLs get
    equal answers; ids may be null; other columns are not looked at; an empty table gives no rows.
    Without decided URLs of both kinds the models agree everywhere, and undecided URLs are allowed.
    """
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    name, say = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("label", say)
    # the row count of one URL has no say in the models
    urls = rows.filter("url IS NOT NULL").select("url", "label").distinct()
    urls = urls.withColumn("fold", F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 8), 16, 10).cast("long") % 5).withColumn("text", symbols(F.col("url")))
    grams = staged(gram_counts(urls), "url-grams")
    seen = grams.agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).first()
    if seen["a"] and seen["r"]:
        model = staged(ratio_model(grams), "url-model")
    else:
        model = grams.select("gram", F.lit(0.0).alias("gain"))
    scores = staged(scored(urls, model), "url-scores")
    least = threshold(urls.filter("fold = 0 AND label IS NOT NULL").join(scores, "url").select("label", "score"))
    judged = F.coalesce("label", F.when(F.col("score") >= least, F.lit("allow")).otherwise(F.lit("block")))
    return rows.join(scores, "url", "left").select(
        F.col("page").alias(id_col), "host", "path", "rule", judged.alias("verdict"), "score"
    )
