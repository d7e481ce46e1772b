import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark import config
from kgspark.graph import communities, components, degree, in_task, merge, tables
from kgspark.graph.hierarchy import community_hierarchy
from kgspark.model import records
from kgspark.session import cut, stored


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "source string, target string, weight double")


def test_components(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    other = [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r["title"]: r["component"] for r in components.connected_components(edges_of(spark, chain + other)).collect()}
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"}
    assert got["y"] == "x" and got["z"] == "z"
    assert components.largest_component(edges_of(spark, chain + other)).count() == 61


def brute_components(pairs, nodes=()):
    low = {n: n for n in [*nodes, *(x for p in pairs for x in p)]}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def shapes(seed):
    rnd = random.Random(seed)
    star = [("hub", f"leaf{i:03d}") for i in range(80)]
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    wild = [(f"w{rnd.randrange(150)}", f"w{rnd.randrange(150)}") for _ in range(110)]
    return star + chain + wild + [("é", "e"), ("loop", "loop")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    pairs = shapes(seed)
    nodes = spark.createDataFrame([("alone",), ("hub",)], "title string")
    got = components.connected_components(edges_of(spark, pairs), nodes).collect()
    assert {r.title: r.component for r in got} == brute_components(pairs, ["alone"])
    assert len(got) == len({r.title for r in got})


def test_components_of_numbers_and_odd_edges(spark):
    pairs = [(5, 3), (3, 5), (9, 9), (2**40, 3)]
    df = spark.createDataFrame([*pairs, (None, 4), (None, None)], "source long, target long")
    got = {r.title: r.component for r in components.connected_components(df).collect()}
    assert got == {5: 3, 3: 3, 2**40: 3, 9: 9, 4: 4, None: None}
    assert components.connected_components(df.limit(0)).collect() == []
    text = spark.createDataFrame([("a", None), ("b", "a")], "source string, target string")
    assert {tuple(r) for r in components.connected_components(text).collect()} == {("a", "a"), ("b", "a"), (None, None)}


def test_contraction_takes_a_share_of_the_edges_each_round(spark):
    """On a path in the order of its ids, the slowest case for a smallest neighbour."""
    left = spark.range(3000).selectExpr("id AS a", "id + 1 AS b")
    sizes = [3000]
    while sizes[-1] > 30:
        _, left = components.contract(left, len(sizes))
        sizes.append(left.count())
    assert all(b <= 0.62 * a for a, b in zip(sizes, sizes[1:]) if a > 200)
    assert len(sizes) < 12


def test_no_text_moves_in_the_rounds(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(components, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut(df))
    components.connected_components(edges_of(spark, shapes(3)))
    assert len(plans) > 3
    # ids and their dictionary are made before; the rounds hold none of the titles
    assert not any("title" in line for p in plans[1:] for line in p.splitlines() if "Exchange" in line)


def test_degree_counts_self_loops_twice(spark):
    got = {r["title"]: r["degree"] for r in degree.node_degree(edges_of(spark, [("a", "b"), ("c", "c")])).collect()}
    assert got == {"a": 1, "b": 1, "c": 2}


def test_communities(spark):
    rnd = random.Random(1)
    pairs = []
    for g in range(4):
        names = [f"g{g}_{i}" for i in range(14)]
        pairs += [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rnd.random() < 0.5]
    pairs += [("g0_0", "g1_0"), ("g1_1", "g2_1"), ("g2_2", "g3_2"), ("far", "away")]
    edges = edges_of(spark, pairs)
    member = communities.hierarchical_communities(edges).cache()
    level0 = member.filter("level = 0")
    assert level0.count() == 56  # the small component is left out
    assert communities.modularity(edges, level0).first()[0] > 0.6
    groups = {}
    for r in level0.collect():
        groups.setdefault(r["community"], set()).add(r["title"].split("_")[0])
    assert all(len(g) == 1 for g in groups.values())
    # each level refines the one above, and every community is connected
    for lv in [r["level"] for r in member.select("level").distinct().collect()]:
        mine = {r["title"]: r["community"] for r in member.filter(F.col("level") == lv).collect()}
        inner = [(a, b) for a, b in pairs if a in mine and b in mine and mine[a] == mine[b]]
        parts = components.connected_components(edges_of(spark, inner), spark.createDataFrame([(t,) for t in mine], "title string"))
        assert parts.select("component").distinct().count() == len(set(mine.values()))
        if lv:
            # a community has one level; those below hold nodes of one above only
            assert not set(mine.values()) & {r["community"] for r in member.filter(F.col("level") != lv).collect()}
            upper = {r["title"]: r["community"] for r in member.filter(F.col("level") == lv - 1).collect()}
            assert all(len({upper[t] for t in mine if mine[t] == c}) == 1 for c in set(mine.values()))


def test_hierarchy_skips_missing_levels(spark):
    rows = [(0, "A", t) for t in "abcd"] + [(2, "B", t) for t in "ab"] + [(2, "C", t) for t in "cde"] + [(3, "B2", t) for t in "ab"] + [(0, None, "q")]
    df = spark.createDataFrame(rows, "level int, community string, title string")
    got = {tuple(r) for r in community_hierarchy(df).collect()}
    assert got == {("A", 0, "B", 2), ("B", 2, "B2", 2)}


def test_merge_pages_hold_all_values(spark):
    df = spark.createDataFrame([("n", f"d{i:02d}", i) for i in range(7)] + [("m", None, 9)], "title string, description string, o int")
    got = merge.merge_rows(df, ["title"], {"description": ("concat", ",")}, ["o"], page_rows=3).collect()
    pages = sorted((r["page"], r["description"]) for r in got if r["title"] == "n")
    assert pages == [(0, "d00,d01,d02"), (1, "d03,d04,d05"), (2, "d06")]
    assert [(r["page"], r["description"]) for r in got if r["title"] == "m"] == [(0, None)]


def test_records(spark):
    text = (
        '("entity"<|>"Acme &amp; Co"<|>"org"<|>"makes things")##("entity"<|>"short"<|>"x")##\n'
        '("relationship"<|>"b"<|>"Acme &amp; Co"<|>"buys"<|>"2.5")##("relationship"<|>"b"<|>"c"<|>"knows")##("relationship"<|>"b"<|>"c")<|COMPLETE|>'
    )
    df = spark.createDataFrame([(1, text)], "id int, output string")
    parsed = records.parse_records(df, "output", ["id"])
    assert [(r["title"], r["type"], r["description"]) for r in records.entities(parsed, ["id"]).collect()] == [("ACME & CO", "ORG", "makes things")]
    got = sorted((r["source"], r["target"], r["weight"]) for r in records.relationships(parsed, ["id"]).collect())
    assert got == [("ACME & CO", "B", 2.5), ("B", "C", 1.0)]
    counted = records.parse_records(df, "output", ["id"], weight_mode="count")
    assert {r["weight"] for r in records.relationships(counted, ["id"]).collect()} == {1.0}


def test_rounds_of_a_graph_know_the_size_of_what_they_wrote(spark):
    """An estimate that is handed on gets longer with every join of a loop; multiplying it then takes minutes."""
    left = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    for turn in range(3):
        made = components.contract(left, turn)
        left = made[1]
        for df in made:
            assert "parquet" in df._jdf.queryExecution().executedPlan().toString().lower()
            assert len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 9


def test_lists_of_small_groups_need_no_row_numbers(spark):
    units = spark.createDataFrame([("a", "b", "u1"), ("a", "b", "u1"), ("a", None, "u1"), (None, "b", "u2")], "source string, target string, text_unit_id string")
    nodes = units.select("text_unit_id", F.explode(F.array("source", "target")).alias("title"))
    edges = spark.createDataFrame([("a", "b", 1.0, "d")], "source string, target string, weight double, description string")
    made = {
        "e": tables.unit_entities(nodes),
        "r": tables.unit_relationships(units),
        "p": tables.unit_entities(nodes, 1),
        "t": tables.final_text_units(units.select(F.col("text_unit_id").alias("id"), F.lit("x").alias("chunk"), F.lit(1).alias("n_tokens"), F.array().alias("document_ids")).distinct(), tables.unit_entities(nodes), tables.unit_relationships(units)),
    }
    for name, df in made.items():
        assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString(), name
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    a, b, ab = md5("a"), md5("b"), md5("a\x01b")
    assert {r["id"]: r["entity_ids"] for r in made["e"].collect()} == {"u1": [*sorted([a, b]), None], "u2": [b, None]}
    assert {r["id"]: r["relationship_ids"] for r in made["r"].collect()} == {"u1": sorted([ab, a]), "u2": [b]}
    assert sorted((r["id"], r["page"], r["entity_ids"][0] or "") for r in made["p"].collect()) == sorted(
        [(u, i, x) for u, xs in (("u1", [*sorted([a, b]), ""]), ("u2", [b, ""])) for i, x in enumerate(xs)]
    )
    related = tables.relationships_table(edges, units).collect()
    assert [(r["source"], r["page"], r["text_unit_ids"]) for r in related] == [("a", 0, ["u1"])]


def test_units_of_an_order_are_found_without_a_shuffle_of_names(spark):
    from kgspark.plans import graphs
    from kgspark.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    for df in (graphs.trade_units(t), graphs.trade_node_units(t)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "o_orderkey" in plan[plan.index("Aggregate [") :].splitlines()[0]


@pytest.mark.parametrize("page_rows", [None, 2])
@pytest.mark.parametrize("cell", [50_000, 3])
def test_merge_joins_lists_without_row_numbers(spark, monkeypatch, page_rows, cell):
    monkeypatch.setattr(config, "PAGE_ROWS", cell)
    data = [("k", i, f"v{i % 5}", "w" if i == 3 else None) for i in range(20)] + [("n", 1, None, None), (None, 1, "z", "w")]
    df = spark.createDataFrame(data, "k string, at long, a string, b string")
    out = merge.merge_rows(df, ["k"], {"a": ("concat", ","), "b": ("concat", ";")}, ["at"], page_rows)
    if cell > 20:
        assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    step = page_rows or cell
    want = {("k", p): (",".join(f"v{i}" for i in range(5)[p * step : (p + 1) * step]), "" if p else "w") for p in range(-(-5 // step))}
    got = {(r["k"], r["page"]): (r["a"], r["b"]) for r in out.collect()}
    assert got == want | {("n", 0): (None, None), (None, 0): (None, None)}


def test_label_propagation_moves_numbers(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(communities, "stored", lambda df: seen.append(dict(df.dtypes)) or stored(df))
    pairs = [("b", "a", 1.0), ("b", "c", 1.0), ("c", "d", 5.0), (None, "d", 9.0), ("e", "e", 1.0), ("a", None, 2.0)]
    edges = spark.createDataFrame(pairs, "source string, target string, weight double")
    got = {r["title"]: r["label"] for r in communities.label_propagation(edges, 1).collect()}
    # an end without a name hears the others and is not heard
    assert got == {"a": "b", "b": "a", "c": "d", "d": "c", "e": "e", None: "d"}
    assert all(kind != "string" for d in seen[1:] for kind in d.values())


def test_a_task_of_a_shuffle_is_kept_small(spark):
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def weighted_cliques(spark):
    rnd = random.Random(5)
    rows = []
    for g in range(9):
        names = [f"g{g}_{i}" for i in range(13)]
        rows += [(a, b, rnd.random() + 0.1) for i, a in enumerate(names) for b in names[i + 1 :] if rnd.random() < 0.6]
        rows.append((names[0], f"g{(g + 1) % 9}_5", 0.7))
    rows += [("far", "away", 1.0), ("g1_1", "g1_1", 2.5), ("g2_2", "g4_4", 0.3), (None, "g1_1", 1.0)]
    return spark.createDataFrame(rows, "source string, target string, weight double").repartition(2)


def test_a_graph_that_fits_a_task_takes_few_jobs(spark, monkeypatch):
    """A round of moves as Spark jobs takes seconds, however few edges it has; there are hundreds of rounds."""
    edges = weighted_cliques(spark)
    spark.sparkContext.setJobGroup("communities", "")
    found = {tuple(r) for r in communities.hierarchical_communities(edges).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("communities"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len({t for t, *_ in found}) == 117 and jobs < 50
    # a larger graph begins as a table and goes to a task when what is left to merge or to split fits
    monkeypatch.setattr(communities, "TASK_EDGES", 300)
    assert {tuple(r) for r in communities.hierarchical_communities(edges).collect()} == found


def test_arrays_hash_and_round_as_spark_does(spark):
    ids = [0, 1, -5, 2**33 + 7, 2**62]
    df = spark.createDataFrame([(i,) for i in ids], "v long")
    for seed in (communities.SEED, 5, -7):
        want = [r[0] for r in df.select(F.xxhash64("v", F.lit(seed))).collect()]
        assert in_task.hashes(np.array(ids), seed).view(np.int64).tolist() == want
    xs = [0.0, 1.5e-9, 2.5e-9, -2.5e-9, 0.1234567895, -0.1234567895, 123456.7890123455, -1e-12, 1 / 3, 1e15 + 0.3, 2.0000000005]
    want = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(F.round("x", 9)).collect()]
    assert in_task.rounded(np.array(xs)).tolist() == want


def test_moves_that_undo_each_other_end(spark, monkeypatch):
    """Two of five nodes are more than any share that ends the rounds, and move for ever."""

    def turns():
        yield from range(40)
        raise AssertionError("no end")

    monkeypatch.setattr(communities, "itertools", SimpleNamespace(count=turns))
    monkeypatch.setattr(in_task, "itertools", SimpleNamespace(count=turns))
    a, b, start, k = np.array([0, 1, 2]), np.array([1, 3, 4]), np.array([1, 0, 3, 3, 0]), np.array([1.0, 2.0, 1.0, 1.0, 1.0])
    c = in_task.moved(a, b, np.ones(3), start, k, np.full(5, 6.0), np.arange(5), 0.01, 1.0, 7)
    edges = spark.createDataFrame([(int(x), int(y), 1.0) for x, y in zip(a, b)], "a long, b long, w double")
    nodes = spark.createDataFrame([(i, int(start[i]), float(k[i]), 6.0) for i in range(5)], "v long, c long, k double, m2 double")
    got = {r.v: r.c for r in communities._local_moves(edges, nodes, 0.01, 1.0, 7).collect()}
    assert got == dict(enumerate(c.tolist()))


@pytest.mark.parametrize("hot", [config.HOT_GROUP_ROWS, 2])
def test_lists_of_communities_are_sorted_as_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(config, "HOT_GROUP_ROWS", hot)
    seen = []
    monkeypatch.setattr(tables, "stored", lambda df: seen.append(dict(df.dtypes)) or stored(df))
    edges = spark.createDataFrame([("a", "b"), ("b", "ç"), ("c", "d")], "source string, target string")
    units = spark.createDataFrame([("a", "b", "é"), ("b", "ç", "z"), ("a", "b", "u1"), ("c", "d", "u1"), ("b", "ç", None)], "source string, target string, text_unit_id string")
    member = spark.createDataFrame([(0, "a", "A"), (0, "b", "A"), (0, "c", "B"), (0, "d", None)], "level int, title string, community string")
    got = {(r["id"], r["page"]): (r["relationship_ids"], r["text_unit_ids"]) for r in tables.communities_table(edges, units, member, 2).collect()}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    both = sorted([md5("a\x01b"), md5("b\x01ç")])
    assert got == {("A", 0): (both, ["u1", "z"]), ("A", 1): ([], ["é"]), ("B", 0): ([md5("c\x01d")], ["u1"])}
    assert seen[1]["value"] == "binary"
