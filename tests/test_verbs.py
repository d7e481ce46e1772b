import pytest
from pyspark.sql import functions as F

from kgspark.functions import convert, jsontext, strings
from kgspark.operators import columns, joins, sets
from kgspark.sources import files, tables


def test_full_join_keeps_both_sides_and_null_keys(spark):
    a = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "B"), (None, "N"), (3, "C")], "k int, v string")
    got = {tuple(r) for r in joins.join(a, b, ["k"], "full outer").collect()}
    assert got == {(1, "a", None), (None, "n", None), (2, "b", "B"), (None, None, "N"), (3, None, "C")}
    safe = {tuple(r) for r in joins.join(a, b, ["k"], "full outer", null_safe=True).collect()}
    assert safe == {(1, "a", None), (None, "n", "N"), (2, "b", "B"), (3, None, "C")}


def test_semi_does_not_repeat_and_parts_add_up(spark):
    a = spark.createDataFrame([(i % 4, i) for i in range(10)], "k int, v int")
    b = spark.createDataFrame([(1, 0), (1, 1), (3, 2)], "k int, v int")
    semi, anti = joins.join(a, b, ["k"], "semi join"), joins.join(a, b, ["k"], "anti join")
    assert semi.columns == ["k", "v"]
    assert sorted(map(tuple, semi.unionByName(anti).collect())) == sorted(map(tuple, a.collect()))


def test_cross_of_two_large_sides_meets_in_a_grid(spark, monkeypatch):
    from kgspark import config

    a, b = spark.range(50).selectExpr("id AS a", "id % 3 AS k"), spark.range(33).selectExpr("id AS b", "id % 2 AS k")
    want = sorted((i, i % 3, j, j % 2) for i in range(50) for j in range(33))
    small = joins.join(a, b, strategy="cross")
    monkeypatch.setattr(config, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(config, "GRID_ROWS", 10)
    grid = joins.join(a, b, strategy="cross")
    assert grid.columns == small.columns == ["a", "k_1", "b", "k_2"]
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, grid.collect())) == want
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert joins.join(a.limit(0), b, strategy="cross").count() == 0


def test_two_names_join_and_suffixes(spark):
    a = spark.createDataFrame([(1, "x")], "i int, v string")
    b = spark.createDataFrame([(1, "y")], "j int, v string")
    r = joins.join(a, b, ["i", "j"], "inner")
    assert r.columns == ["i", "v_1", "j", "v_2"] and tuple(r.first()) == (1, "x", 1, "y")


def test_zip_map_later_key_wins_and_lengths_must_agree(spark):
    good = spark.createDataFrame([(["a", "a"], [1, 2])], "k array<string>, v array<int>")
    assert columns.zip_map(good, "m", "k", "v").first()["m"] == {"a": 2}
    bad = spark.createDataFrame([(["a"], [1, 2])], "k array<string>, v array<int>")
    with pytest.raises(Exception, match="differ in length"):
        columns.zip_map(bad, "m", "k", "v").collect()


def test_convert(spark):
    df = spark.createDataFrame([("TRUE", "0x1f", "017", "a,b"), (None, "zz", "19", ""), ("no", "-0x0A", "x", None)], "b string, h string, o string, a string")
    out = convert.convert(df, "b", "b2", "boolean")
    out = convert.convert(out, "h", "h2", "integer", radix=None)
    out = convert.convert(out, "o", "o2", "integer", radix=8)
    out = convert.convert(out, "a", "a2", "array").select("b2", "h2", "o2", "a2")
    assert [tuple(r) for r in out.collect()] == [(True, 31, 15, ["a", "b"]), (False, None, None, [""]), (False, -10, None, [])]
    split = df.select(convert.text_split(F.col("a"), ",").alias("s")).collect()
    assert [r["s"] for r in split] == [["a", "b"], [], None]


def test_merge_and_union(spark):
    df = spark.createDataFrame([(1, None, 2.0, True), (2, "x", 2.5, None)], "i int, a string, d double, f boolean")
    got = columns.merge(df, "m", ["a", "d", "f"], "concat", "-")
    assert got.columns == ["i", "m"] and [r["m"] for r in got.orderBy("i").collect()] == ["2-true", "x-2.5"]
    u = sets.union(df.select("i"), df.select("a"))
    assert u.count() == 4 and u.columns == ["i", "a"]


@pytest.mark.parametrize(
    "text,first,last",
    [
        ('pre {"a": {"b": 1}} mid {"c": 2} post', '{"a": {"b": 1}}', '{"c": 2}'),
        ('{ open {"a": 1}', '{"a": 1}', '{"a": 1}'),
        ("none", None, None),
        ("} {}", "{}", "{}"),
    ],
)
def test_balanced(spark, text, first, last):
    r = spark.createDataFrame([(text,)], "t string").select(jsontext.balanced("t").alias("o")).select("o.*").toDF("f", "l").first()
    assert (r["f"], r["l"]) == (first, last)


def test_json_repair_and_keys(spark):
    text = '```json\n{"a": 1,\n "l": [{"x": 1\n ], "a": 2,}\n```'
    df = spark.createDataFrame([(text,)], "t string").select(jsontext.repair(F.col("t")).alias("j"))
    assert df.select(jsontext.parse(F.col("j"), "a int, l array<struct<x:int>>").alias("r")).first()["r"]["l"][0]["x"] == 1
    keys = spark.createDataFrame([('{"a": 1, "a": 2, "b": "true"}',), ("[1]",)], "t string")
    assert keys.select(jsontext.latest_keys(F.col("t")).alias("m")).first()["m"] == {"a": "2", "b": "true"}
    assert keys.select(jsontext.parse(F.col("t"), "a int").alias("r")).collect()[1]["r"] is None


def test_clean_and_csv(spark):
    df = spark.createDataFrame([("  A &amp;lt; b\x01 ",)], "t string")
    assert df.select(strings.clean_str(F.col("t")).alias("c")).first()["c"] == "A &lt; b"
    assert df.select(strings.clean_str(F.lit(" &eacute;&#233; "), True).alias("c")).first()["c"] == "éé"
    line = df.select(strings.csv_line([F.lit("a,b"), F.lit('q"'), F.lit(None).cast("string"), F.lit("x")]).alias("c")).first()["c"]
    assert line == '"a,b","q""",,x'


def test_csv_and_json_files(spark, tmp_path):
    for n, body in ((10, "id,t\n1,a\n2,\"b\nc\"\n"), (2, "id,t\n3,d\n")):
        (tmp_path / f"part_to{n}new.csv").write_text(body)
    (tmp_path / "other.csv").write_text("id,t\n9,z\n")
    rows = files.read_csv_shards(spark, str(tmp_path), r"part_to(\d+)new\.csv", multi_line=True).orderBy("file_idx", "id").collect()
    assert [(r["id"], r["t"], r["file_idx"]) for r in rows] == [("3", "d", 2), ("1", "a", 10), ("2", "b\nc", 10)]
    out = str(tmp_path / "out")
    files.write_csv(spark.createDataFrame([(1, 'x "y", z')], "i int, s string"), out)
    assert tuple(files.read_csv(spark, out, "i int, s string").first()) == (1, 'x "y", z')
    (tmp_path / "a.json").write_text('{"Articles": [{"Title": "t", "Data": [{"Name": "n"}]},\n {"Title": "u", "Data": []}]}')
    assert {r["Title"] for r in files.read_nested_json(spark, str(tmp_path / "a.json"), "Articles", multi_line=True).collect()} == {"t", "u"}


def test_stage_is_computed_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.stage(spark, str(tmp_path), "s", make).count() == 3
    assert len(calls) == 1
    tables.stage(spark, str(tmp_path), "s", make, try_load=False)
    assert len(calls) == 2


def test_cross_does_not_broadcast_long_texts(spark, monkeypatch):
    from kgspark import config

    monkeypatch.setattr(config, "BROADCAST_BYTES", 1000)
    few = spark.createDataFrame([(1, "why?")], "q int, question string")
    long = spark.range(20).selectExpr("id AS b", "repeat('x', 500) AS context")
    want = sorted((1, "why?", i, "x" * 500) for i in range(20))
    for left, right in ((few, long), (long, few)):
        out = joins.join(left, right, strategy="cross")
        assert sorted((r["q"], r["question"], r["b"], r["context"]) for r in out.collect()) == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        hinted = [i for i, l in enumerate(plan.splitlines()) if "strategy=broadcast" in l]
        # the side that is sent whole is the one of the short texts
        assert hinted and ("rightHint" in plan) == (left is long)
    monkeypatch.setattr(config, "GRID_BYTES", 2000)
    grid = joins.join(long, long.withColumnsRenamed({"b": "c", "context": "other"}), strategy="cross")
    assert "NestedLoop" not in grid._jdf.queryExecution().executedPlan().toString() and grid.count() == 400
