"""The block way for large groups gives the same rows as the plain way."""

import random

import pytest
from pyspark.sql import functions as F

from kgspark.operators import aggregates, ordered, windows


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = []
    for i in range(240):
        key = "hot" if i % 2 else rnd.choice(["a", "b", None])
        data.append((i, key, rnd.choice([None, 1.0, 2.0, 2.0, 3.5]), rnd.randint(0, 9)))
    rnd.shuffle(data)
    return spark.createDataFrame(data, "id long, k string, v double, n int").repartition(5).cache()


SMALL = {"limit": 20, "block_rows": 7}


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_sums(rows, keys):
    sums = {"s": F.col("n"), "c": F.col("v").isNotNull().cast("long"), "maybe": F.col("v")}
    assert same(ordered.running_sums(rows, sums, keys, ["id"], **SMALL), ordered.running_sums(rows, sums, keys, ["id"]))


def test_running_sums_descending(rows):
    order = [F.col("n").desc_nulls_last(), F.col("id").asc()]
    assert same(ordered.row_numbers(rows, "r", ["k"], order, **SMALL), ordered.row_numbers(rows, "r", ["k"], order))


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("direction", ["down", "up"])
def test_fill(rows, keys, direction):
    assert same(
        ordered.fill(rows, "v", "f", keys, ["id"], direction, **SMALL), ordered.fill(rows, "v", "f", keys, ["id"], direction)
    )


@pytest.mark.parametrize("op", ["rank", "percent_rank", "cume_dist"])
@pytest.mark.parametrize("keys", [["k"], []])
def test_rank_family(rows, op, keys):
    a = windows.window(rows, op, "r", ["v"], keys=keys, **SMALL).withColumn("r", F.round("r", 9))
    b = windows.window(rows, op, "r", ["v"], keys=keys).withColumn("r", F.round("r", 9))
    assert same(a, b)


@pytest.mark.parametrize("op", ["first_value", "last_value"])
def test_edges(rows, op):
    assert same(
        windows.window(rows, op, "r", ["id"], "v", ["k"], limit=20), windows.window(rows, op, "r", ["id"], "v", ["k"])
    )


def test_quantiles(rows):
    import statistics

    got = ordered.quantiles(rows, "v", {"q": 0.5}, [], **SMALL).first()["q"]
    assert got == statistics.median([r["v"] for r in rows.collect() if r["v"] is not None])
    assert same(ordered.quantiles(rows, "v", {"q": 0.3}, ["k"], **SMALL), ordered.quantiles(rows, "v", {"q": 0.3}, ["k"]))


def test_pages_hold_everything(rows):
    pages = ordered.collect_pages(rows, F.col("v"), "a", ["k"], ["id"], page_rows=9, limit=20)
    got = {}
    for r in pages.orderBy("page").collect():
        assert len(r["a"]) <= 9
        got.setdefault(r["k"], []).extend(r["a"])
    want = {}
    for r in rows.orderBy("id").collect():
        want.setdefault(r["k"], []).append(r["v"])
    assert got == want


def test_aggregate_null_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), (None, 5.0)], "k string, v double")
    specs = [
        {"column": "v", "operation": "sum", "to": "s"},
        {"column": "v", "operation": "product", "to": "p"},
        {"column": "v", "operation": "invalid", "to": "i"},
        {"column": "v", "operation": "mode", "to": "m"},
    ]
    got = {r["k"]: (r["s"], r["p"], r["i"], r["m"]) for r in aggregates.aggregate(df, specs, ["k"]).collect()}
    assert got == {"a": (1.0, None, 1, 1.0), "b": (0.0, None, 1, None)}
    listed = aggregates.aggregate(df, [{"column": "v", "operation": "array_agg", "to": "x"}], ["k"])
    assert {r["k"]: r["x"] for r in listed.collect()} == {"a": [1.0, None], "b": [None]}


def test_stage_tables_and_cuts_write_their_rows_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from kgspark.session import cut, stored

    df = spark.range(30).select("id", F.array(F.col("id").cast("string")).alias("a"), F.when(F.col("id") > 3, F.struct("id")).alias("s"))
    monkeypatch.setattr(type(df), "persist", lambda self, *a: pytest.fail("a copy is kept beside the cut"))
    want = sorted(map(repr, df.collect()))
    for kept, source in ((cut(df), "ExistingRDD"), (stored(df), "parquet")):
        assert sorted(map(repr, kept.collect())) == want and kept.dtypes == df.dtypes
        assert source in kept._jdf.queryExecution().executedPlan().toString()
    # what Parquet does not hold is cut
    odd = stored(df.withColumn("v", F.lit(None)))
    assert odd.count() == 30 and odd.dtypes[-1] == ("v", "void")


def test_first_rows_of_a_budget_are_picked_before_the_shuffle(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from kgspark import config

    w = Window.partitionBy("k").orderBy("id")
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(99))).alias("id"))  # no known count
    df = rows.withColumn("k", F.col("id") % 2).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= config.REPORT_CONTEXT_TOKENS)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString() and df.count() == 100


@pytest.mark.parametrize("keys", [["k"], []])
def test_row_numbers_of_large_groups_take_one_shuffle(rows, keys):
    out = ordered.row_numbers(rows, "r", keys, ["id"], **SMALL)
    assert same(out, ordered.row_numbers(rows, "r", keys, ["id"], 10**6) if keys else ordered.running_sums(rows, {"r": F.lit(1)}, keys, ["id"], **SMALL))
    plan = ordered._row_numbers_blocked(rows, "r", keys, [F.col("id").asc()], 240, 7)._jdf.queryExecution().optimizedPlan().toString()
    # the only window is over the summaries of the blocks
    assert plan.count("Window [") == 1 and plan.index("Aggregate") > plan.index("Window [")


def plan_text(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("page_rows", [None, 3])
@pytest.mark.parametrize("limit", [None, 20])
def test_set_pages_give_the_pages_of_distinct_items(rows, page_rows, limit):
    def item(v):
        return F.when(v != 2.0, F.concat(F.lit("v"), v.cast("string")))  # 2.0 and null give the same item

    got = ordered.set_pages(rows, ["v"], item, "l", ["k"], page_rows, limit)
    made = rows.select("k", item(F.col("v")).alias("v")).distinct()
    want = ordered.collect_pages(made, F.col("v"), "l", ["k"], ["v"], page_rows)
    assert got.columns == want.columns and same(got, want)


def test_small_groups_are_counted_in_buckets(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 1000).alias("k"), "id").unionByName(spark.range(50).select(F.lit(7).cast("long").alias("k"), "id"))
    for buckets, many in ((ordered.COUNT_BUCKETS, 1000), (2, 1000), (2, 0)):
        monkeypatch.setattr(ordered, "COUNT_BUCKETS", buckets)
        monkeypatch.setattr(ordered, "MANY_BUCKETS", many)
        cold, hot, n = ordered.split_hot(df, ["k"], 20)
        assert n == 53 and hot.count() == 53 and cold.count() == 2997
        assert ordered.split_hot(df, ["k"], 60)[1:] == (None, 0)
