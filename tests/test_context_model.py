import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.augment import rows
from kgspark.context import conversation, local, mixed, reports, search
from kgspark.functions import tokens as tok
from kgspark.model import apply, offline
from kgspark.model.summarize import summarize_lines
from kgspark.quality import agreement
from kgspark.session import FREE_SHUFFLES, discard, shared_folder, stored
from kgspark.vector import embed, ivf, topk


def small_graph(spark):
    nodes = spark.createDataFrame(
        [(lv, c, t, i, "d " * i, 3) for lv, cs in ((0, "AAAAAA"), (1, "BBBCCC")) for i, (t, c) in enumerate(zip("abcdef", cs))],
        "level int, community string, title string, human_readable_id int, description string, degree int",
    )
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f")]
    edges = spark.createDataFrame(
        [(i, a, b, f"{a} to {b}", 10 - i) for i, (a, b) in enumerate(pairs)],
        "human_readable_id int, source string, target string, description string, rank int",
    )
    return nodes, edges


@pytest.mark.parametrize("limit", [5, 12, 20, 25, 33, 1000])
def test_trimmed_context_stays_within_the_limit(spark, limit):
    nodes, edges = small_graph(spark)
    lines = local.context_lines(nodes, edges)
    items = local.context_items(nodes, edges, lines).cache()
    out = local.local_context(items, lines, limit).withColumn("n", tok.count(F.col("context_string"))).collect()
    for r in out:
        assert r["n"] <= limit
        assert r["context_exceed_limit"] == (r["context_size"] > limit)
        if not r["context_exceed_limit"]:
            assert r["n"] == r["context_size"]
    # node number 0 is there
    whole = [r for r in local.local_context(items, lines, 1000).collect() if r["level"] == 0][0]["context_string"]
    assert "\n0,a," in whole and whole.index("0,a,b") < whole.index("5,e,f")


def test_steps_are_numbered_over_blocks(spark, monkeypatch):
    """Blocks of a few edges, shared communities, equal and missing ranks, a node without a row: the same steps as a window gives."""
    titles = [f"n{i}" for i in range(30)]
    nodes = spark.createDataFrame(
        [(lv, f"{lv}/{i % (2 + 3 * lv)}", t, i, "d", 1) for lv in (0, 1) for i, t in enumerate(titles)] + [(2, None, "n1", 1, "d", 1)],
        "level int, community string, title string, human_readable_id int, description string, degree int",
    )
    data = [(i, f"n{i * 7 % 32}", f"n{i * 11 % 29}", "x y", None if i % 9 == 0 else i % 5) for i in range(200)]
    edges = spark.createDataFrame(data, "human_readable_id int, source string, target string, description string, rank int")
    homes = {}
    for lv in (0, 1):
        for i, t in enumerate(titles):
            homes.setdefault(t, []).append((lv, f"{lv}/{i % (2 + 3 * lv)}"))
    want, at = set(), {}
    for i, a, b, _, _ in sorted(data, key=lambda e: (e[4] is None, -(e[4] or 0), e[0])):
        for home in {*homes.get(a, []), *homes.get(b, [])}:
            at[home] = at.get(home, 0) + 1
            want.add((*home, at[home], i))
    monkeypatch.setattr(local, "EDGE_BLOCK_ROWS", 20, raising=False)
    lines = local.context_lines(nodes, edges)
    items = local.context_items(nodes, edges, lines)
    edge_steps = lambda df: {tuple(r) for r in df.filter("kind = 'edge'").select("level", "community", "step", "id").collect()}
    assert edge_steps(items) == want
    assert edge_steps(local.context_items(nodes, edges, lines, max_tokens=100)) == {w for w in want if w[2] <= 100 // 2}  # a line has two tokens
    first = {}
    for lv, c, step, i in sorted(want, key=lambda w: w[2]):
        for side, t in enumerate(data[i][1:3]):
            if (lv, c) in homes.get(t, []):
                first.setdefault((lv, c, titles.index(t)), step * 2 + side)
    got = items.filter("kind = 'node'").select("level", "community", "id", "use").collect()
    assert {tuple(r)[:3]: r["use"] for r in got} == first and len(got) == len(first)
    # the rows per community are never dealt out again to be numbered, and lines of edges meet by one number
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan(items)
    assert plan(local.with_lines(items, lines)).count("Join Inner, (id") == 1


def test_a_title_under_two_numbers_takes_the_smallest(spark):
    nodes, edges = small_graph(spark)
    twice = nodes.withColumn("human_readable_id", F.explode(F.array(F.col("human_readable_id") + 10, "human_readable_id")))
    picked = local._node_ids(twice).select("title", "node").collect()
    assert {r["title"]: r["node"] for r in picked} == {t: i for i, t in enumerate("abcdef")}


def test_claims_get_their_section(spark):
    nodes, edges = small_graph(spark)
    claims = spark.createDataFrame([(1, "b", "T", "S", "said")], "human_readable_id int, subject_id string, type string, status string, description string")
    lines = local.context_lines(nodes, edges, claims)
    text = local.local_context(local.context_items(nodes, edges, lines, claims), lines, 1000).filter("level = 0").first()["context_string"]
    assert "-----Claims-----\nhuman_readable_id,subject_id,type,status,description\n1,b,T,S,said\n" in text


def test_mixed_choice(spark):
    subs = spark.createDataFrame(
        [("P", "s1", 50, 5, "r1"), ("P", "s2", 30, 4, "r2"), ("P", "s3", 10, None, None)],
        "community string, sub_community string, local_size long, report_size long, report_line string",
    )
    use = lambda limit: {r["sub_community"]: r["use"] for r in mixed.mixed_choice(subs, limit).collect()}
    assert use(60) == {"s1": "report", "s2": "local", "s3": "local"}
    assert use(30) == {"s1": "report", "s2": "report", "s3": "local"}
    assert use(9) == {"s1": "report", "s2": "drop", "s3": "drop"}


def test_reports_over_levels(spark):
    nodes, edges = small_graph(spark)
    out = reports.community_reports(nodes, edges, lambda texts, attempt: offline.report(texts), max_tokens=40)
    got = {(r["level"], r["community"]) for r in out.collect()}
    assert got == {(0, "A"), (1, "B"), (1, "C")}


def test_retry_is_bounded(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "k int, p string")
    fn = lambda texts, a: ["ok" if int(t[1:]) < 2 * a else "no" for t in texts]
    done, open_rows = apply.model_retry(df, fn, "p", "k", lambda c: c == "ok", 2)
    assert {r["k"]: r["attempt"] for r in done.collect()} == {0: 1, 1: 1, 2: 2, 3: 2}
    assert sorted(r["k"] for r in open_rows.collect()) == [4, 5]


def test_summaries_fold_to_one_line(spark):
    df = spark.createDataFrame([("a", f"line {i:03d} x y z") for i in range(40)] + [("b", "only"), ("c", "")], "k string, d string")
    fn = lambda prompts: [f"{len(p.split(chr(10)))} lines" for p in prompts]
    got = {r["k"]: r["summary"] for r in summarize_lines(df, "k", "d", fn, max_tokens=20).collect()}
    assert set(got) == {"a", "b"} and got["b"] == "only" and got["a"].endswith("lines")


def test_conversations(spark):
    turns = [(1, 0, "assistant", "hi"), (1, 1, "user", "q1"), (1, 2, "user", "q2"), (1, 3, "system", "s"), (1, 4, "assistant", "a|b")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = [tuple(r)[1:] for r in conversation.qa_turns(df).orderBy("qa_id").collect()]
    assert got == [(1, "q1", None), (2, "q2", "s\na|b")]
    text = conversation.conversation_context(df, user_turns_only=False).first()["context"]
    assert text == '-----Conversation History-----\nturn|content\nuser|q2\nassistant|"s\na|b"\nuser|q1\n'
    bad = spark.createDataFrame([(1, 0, "robot", "x")], df.schema)
    with pytest.raises(Exception, match="invalid role"):
        conversation.checked_roles(bad).collect()


def test_batches_lose_no_report(spark):
    data = [(i, f"t{i}", float(i % 3), float(i), "w " * (i % 9)) for i in range(1, 40)]
    df = spark.createDataFrame(data, "id int, title string, weight double, rank double, content string")
    out = search.report_batches(search.select_reports(df), [], max_tokens=20).collect()
    assert sum(r["n_reports"] for r in out) == 39
    assert all(r["context"].startswith("-----Reports-----\nid|title|occurrence weight|content|rank\n") for r in out)


def test_search_without_points(spark):
    q = spark.createDataFrame([(1, "why?")], "question_id int, question string")
    r = spark.createDataFrame([(1, "t", 1.0, 1.0, "c", "k")], "id int, title string, weight double, rank double, content string, shuffle_key string")
    out = search.global_search(q, r, lambda p: ["nothing" for _ in p]).first()
    assert out["response"] == search.NO_DATA_ANSWER and out["model_calls"] == 1


def test_vectors(spark):
    rng = np.random.default_rng(0)
    v, q = rng.normal(size=(300, 8)), rng.normal(size=(4, 8))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id int, vector array<double>")
    scores = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    got = {}
    for r in topk.similarity_topk(vectors, queries, 7).collect():
        got.setdefault(r["query_id"], {})[r["position"]] = r["id"]
    for i in range(4):
        assert [got[i][p] for p in range(1, 8)] == np.argsort(-scores[i])[:7].tolist()
    # a blocked query side gives the same
    block, topk.QUERY_BLOCK = topk.QUERY_BLOCK, 2
    try:
        again = {(r["query_id"], r["position"]): r["id"] for r in topk.similarity_topk(vectors, queries, 7).collect()}
    finally:
        topk.QUERY_BLOCK = block
    assert again == {(i, p): x for i, m in got.items() for p, x in m.items()}


def test_embedding_of_long_and_empty_text(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a b"), (3, "")], "id int, text string")
    out = {r["id"]: r["e"] for r in embed.text_embed(df, "id", "text", offline.embed, "e", max_tokens=2).collect()}
    assert out[3] is None and out[2] == offline.hash_vector("a b").tolist()
    parts = np.mean([offline.hash_vector(t) for t in ("a b", "c d", "e")], axis=0)
    assert np.allclose(out[1], parts / np.linalg.norm(parts))


def test_completion_merges_and_rejects(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "z": 2}'), (2, '{"a": 1, "b": true}'), (3, "none")], "k int, output string")
    read = rows.read_answer(df)
    ask = lambda gaps: gaps.select("k", F.create_map(F.lit("b"), F.lit("false"), F.lit("a"), F.lit("7")).alias("values"))
    whole, rejects = rows.complete(read, "k", ["a", "b"], ask)
    wide = rows.wide(whole.drop("output"), {"a": "numerical", "b": "boolean"})
    assert sorted(map(tuple, wide.collect())) == [(1, 7.0, False), (2, 1.0, True)]
    assert [(r["k"], r["reason"]) for r in rejects.collect()] == [(3, "no object")]


def test_constant_scores_have_no_correlation(spark):
    scores = spark.createDataFrame([("f", 1.0, 2.0), ("g", 1.0, 4.0)], "feature string, p double, r double")
    selected = spark.createDataFrame([("s", "m", "f")], "feature_set string, model string, feature string")
    available = spark.createDataFrame([("s", "f"), ("s", "g")], "feature_set string, feature string")
    r = agreement.agreement_corr(scores, selected, available, ["p", "r"]).first()
    assert r["corr_p"] is None and r["corr_r"] == pytest.approx(-1.0)


def _cosines(q, v):
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.round(unit(q) @ unit(v).T, topk.DIGITS)


def test_index_finds_what_is_in_its_lists(spark, tmp_path, monkeypatch):
    """With all lists probed the answer is exact, also when a list is shared by many tasks."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 6))
    v[200:330] = v[7]  # copies of one vector: a list that holds a third of all
    q = np.concatenate([rng.normal(size=(9, 6)), v[7:8]])
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 6)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>").withColumn("list", F.lit("clash"))
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(99, None)], "query_id long, vector array<double>")
    monkeypatch.setattr(ivf, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(ivf, "BLOCK_QUERIES", 2)
    index = ivf.build(vectors, str(tmp_path / "index"), lists=8)
    assert sum(index.sizes.values()) == 400 and max(index.sizes.values()) >= 131
    got = ivf.search(index, vectors, queries, 5, probes=8).collect()
    scores = _cosines(q, v)
    want = {(i, p + 1): (j, scores[i, j]) for i in range(10) for p, j in enumerate(sorted(range(400), key=lambda j: (-scores[i, j], j))[:5])}
    assert {(r.query_id, r.position): r.id for r in got} == {key: j for key, (j, _) in want.items()}
    assert all(abs(r.score - want[r.query_id, r.position][1]) < 1e-9 for r in got)


def test_index_reads_probed_lists_only(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "id long, vector array<float>")
    index = ivf.build(vectors, str(tmp_path / "index"), lists=12)
    got = ivf.search(index, vectors, vectors.filter("id = 5").withColumnRenamed("id", "query_id"), 3, probes=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan
    assert got.first().id == 5


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "id long, vector array<float>")
    index = ivf.build(none, str(tmp_path / "index"))
    assert ivf.search(index, none, none.withColumnRenamed("id", "query_id")).collect() == []


def test_hashed_search_makes_no_rows_of_pairs(spark):
    """The same rows as Spark's join of buckets, and nothing but the best of a partition is shuffled."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    v = np.random.default_rng(5).normal(size=(200, 6))
    v[50:60] = v[:10] * 2  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(3, v[3].tolist()), (300, [0.0] * 6), (301, None)]
    vectors = spark.createDataFrame(rows, "id int, vector array<double>").repartition(3).cache()
    asked = vectors.filter("id % 9 = 0").withColumnRenamed("id", "query_id")
    out = topk.similarity_topk_lsh(vectors, asked, 5, radius=0.9, tables=2, width=0.6)
    assert "distanceTo" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" not in plan and "HashJoin" not in plan
    x = [(i, (np.array(a) / np.sqrt(sum(y * y for y in a))).tolist()) for i, a in rows if a and any(a)]
    df = spark.createDataFrame(x, "id int, vector array<double>").select("id", array_to_vector("vector").alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=0.6, numHashTables=2, seed=7).fit(df)
    pairs = model.approxSimilarityJoin(df.filter("id % 9 = 0"), df, 0.9, "d").select(F.col("datasetA.id").alias("q"), F.col("datasetB.id").alias("i"), "d")
    want = {}
    for r in sorted(pairs.collect(), key=lambda r: (r["q"], round(r["d"], 9), r["i"])):
        want.setdefault(r["q"], []).append(r["i"])
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["query_id"], r["position"])):
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert {q: len(g) for q, g in got.items()} == {q: min(5, len(w)) for q, w in want.items()}
    assert all({i for i, _ in g} <= set(want[q]) for q, g in got.items())
    near = {(r["q"], r["i"]): 1 - r["d"] * r["d"] / 2 for r in pairs.collect()}
    assert all(s == pytest.approx(near[q, i], abs=1e-12) for q, g in got.items() for i, s in g)
    assert all(min(s for _, s in g) >= max([near[q, i] for i in want[q] if i not in dict(g)], default=-1) - 1e-9 for q, g in got.items())


def test_scores_come_in_slices(spark, monkeypatch):
    v = np.random.default_rng(1).normal(size=(120, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, vector array<double>").coalesce(1)
    asked = df.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    whole = sorted(map(tuple, topk.similarity_topk(df, asked, 6).collect()))
    monkeypatch.setattr(topk, "SCORE_CELLS", 100)
    assert sorted(map(tuple, topk.similarity_topk(df, asked, 6).collect())) == whole
    held = (np.array([0, 0, 1]), np.array([4, 5, 6]), np.array([0.5, 0.25, 0.75]))
    assert topk._worst(held, 2, 2).tolist() == [[0.25], [-np.inf]]


def test_trimming_sums_no_step_out_of_reach(spark, monkeypatch):
    rows = [(0, "c", s, 2 * s, "edge", s, 1 + s % 3) for s in range(1, 60)]
    items = spark.createDataFrame(rows, "level int, community string, step long, use long, kind string, id long, tokens long")
    seen, steps = [], local.context_steps
    monkeypatch.setattr(local, "context_steps", lambda df: seen.append(df.count()) or steps(df))
    kept = {r["step"] for r in local.trimmed_items(items, 40).collect()}
    total, want = local.HEAD_TOKENS, set()
    for r in rows:
        total += r[6]
        if total <= 40:
            want.add(r[2])
    assert kept == want and seen == [40]


def stages(spark):
    return {p.name for p in Path(shared_folder(spark).removeprefix("file:")).glob("stage-*")}


def test_numbering_the_edges_leaves_one_table_of_numbers(spark):
    nodes, edges = small_graph(spark)
    lines = local.context_lines(nodes, edges)
    before = stages(spark)
    items = local.context_items(nodes, edges, lines)
    # what led to the numbered rows is gone, and names are not in them
    left = [spark.read.parquet(f"{shared_folder(spark)}/{n}") for n in stages(spark) - before]
    (written,) = [df for df in left if "id" in df.columns]
    assert written.columns == ["id", "tokens", "place", "s", "t", "__at"]
    assert written.filter("s IS NOT NULL").count() + written.filter("t IS NOT NULL").count() == items.filter("kind = 'node'").count()


def test_a_stage_table_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum("shuffle_" in str(disk.getAllFiles().apply(i)) for i in range(disk.getAllFiles().length()))
    before = files()
    table = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("x")).count())
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before and table.count() == 7
    assert spark.conf.get(FREE_SHUFFLES) == "false"
    discard(table)
    assert not any(Path(f.removeprefix("file://")).exists() for f in table.inputFiles())
