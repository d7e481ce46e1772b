import functools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.functions import tokens as tok
from kgspark.text import budget, chunk, split


def greedy(sizes, limit, header=0, most=None):
    out, batch, fill, count = [], 0, header, 0
    for s in sizes:
        if count and (fill + s > limit or (most and count >= most)):
            batch, fill, count = batch + 1, header, 0
        fill += s
        count += 1
        out.append(batch)
    return out


@pytest.mark.parametrize("limit,header,most", [(10, 0, None), (10, 3, None), (10, 0, 3), (25, 5, 4), (9, 0, 1), (1000, 0, None)])
@pytest.mark.parametrize("block_rows", [None, 1, 4, 17])
def test_pack_matches_greedy(spark, limit, header, most, block_rows):
    rnd = random.Random(limit * 31 + (most or 0))
    data = [(g, i, rnd.choice([0, 1, 2, 3, 5, 8, 12])) for g, n in (("a", 60), ("b", 3), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(data, "g string, i int, n long").repartition(4)
    hot = {} if block_rows is None else {"limit": 2, "block_rows": block_rows}
    got = budget.pack(df, ["g"], ["i"], "n", limit, "b", header, most, **hot)
    by = {(r["g"], r["i"]): r["b"] for r in got.collect()}
    for g in "abc":
        mine = [x for x in data if x[0] == g]
        assert [by[(g, x[1])] for x in mine] == greedy([x[2] for x in mine], limit, header, most)


@pytest.mark.parametrize("limit,header,most", [(10, 0, None), (10, 3, None), (10, 0, 3), (25, 5, 4), (9, 0, 1), (1000, 0, None)])
def test_blocks_answers_associate(limit, header, most):
    """Put together two by two, three by three or one after the other, the blocks do the same."""
    rnd = random.Random(limit + (most or 0))
    room = limit - header
    for _ in range(40):
        sizes = [[rnd.choice([0, 0, 1, 2, 5, 12]) for _ in range(rnd.randrange(1, 7))] for _ in range(5)]
        tables = [budget._exits(np.array(x), room, most) for x in sizes]
        join = lambda a, b: budget._after(a, b, room, most)
        left = functools.reduce(join, tables)
        right = functools.reduce(lambda a, b: join(b, a), reversed(tables))
        mixed = join(join(tables[0], tables[1]), join(tables[2], join(tables[3], tables[4])))
        assert left.equals(right) and left.equals(mixed)
        whole = budget._exits(np.array(sum(sizes, [])), room, most)
        shared = whole.merge(left, on="at")
        assert (shared["opened_x"] == shared["opened_y"]).all() and (shared["fill_x"] == shared["fill_y"]).all()
        assert budget._through(left, (0, 0, 0), room, most) == budget._through(whole, (0, 0, 0), room, most)
        assert len(left) <= (most or sum(map(len, sizes))) + 2


def test_no_task_gets_all_blocks(spark, monkeypatch):
    """Sixty blocks, put together three at a time."""
    monkeypatch.setattr(budget, "FAN", 3)
    sizes = [(i * 7) % 5 for i in range(300)]
    df = spark.createDataFrame(list(enumerate(sizes)), "i int, n long").repartition(3)
    got = budget.pack(df, [], ["i"], "n", 9, "b", block_rows=5)
    assert [r["b"] for r in got.orderBy("i").collect()] == greedy(sizes, 9)
    plans = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plans


def test_pack_without_keys(spark):
    data = [(i, (i * 7) % 5) for i in range(50)]
    df = spark.createDataFrame(data, "i int, n long").repartition(3)
    want = greedy([n for _, n in data], 9)
    for hot in ({}, {"limit": 10, "block_rows": 6}):
        got = budget.pack(df, [], [F.col("i").asc()], "n", 9, "b", **hot)
        assert [r["b"] for r in got.orderBy("i").collect()] == want


def test_prefix_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, 4), (2, 6), (3, 1), (4, 0)], "i int, n int")
    kept = budget.prefix(df, [], ["i"], F.col("n"), 10)
    assert [r["i"] for r in kept.orderBy("i").collect()] == [1, 2]
    assert budget.prefix(df, [], ["i"], F.col("n"), 3).count() == 0
    assert [r["i"] for r in budget.prefix(df, [], ["i"], F.col("n"), 11).orderBy("i").collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize("n,sizes", [(0, []), (1, [1]), (1100, [1100]), (1101, [1101, 1]), (1200, [1200, 100]), (2300, [1200, 1200, 100])])
def test_token_chunks(spark, n, sizes):
    text = " ".join(f"w{i}" for i in range(n))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = chunk.chunk_tokens(df, "text").orderBy("chunk_index").collect()
    assert [r["n_tokens"] for r in got] == sizes


@pytest.mark.parametrize("hot", [{}, {"limit": 2, "block_rows": 2}])
def test_group_chunks_cover_the_stream(spark, hot):
    rnd = random.Random(5)
    docs = [("g", i, " ".join(f"{i}x{j}" for j in range(rnd.randint(0, 30)))) for i in range(12)]
    df = spark.createDataFrame(docs, "g string, id int, text string")
    got = chunk.chunk_group(df, ["g"], ["id"], "id", "text", 20, 5, **hot).orderBy("chunk_index").collect()
    stream = [(i, w) for _, i, t in docs for w in t.split()]
    for k, r in enumerate(got):
        part = stream[k * 15 : k * 15 + 20]
        assert r["chunk_index"] == k and r["n_tokens"] == len(part)
        assert r["chunk"].split() == " ".join(w for _, w in part).split() or "".join(r["chunk"].split()) == "".join(w for _, w in part)
        assert r["document_ids"] == sorted({i for i, _ in part})
    assert len(got) == -(-len(stream) // 15)


def test_chars_lose_nothing_but_overlap(spark):
    text = "short\n" * 3 + "x" * 50 + "\n" + "end"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = [r["chunk"] for r in chunk.chunk_chars(df, "id", "text", 20, 5).orderBy("chunk_index").collect()]
    assert all(len(c) <= 20 for c in got)
    assert got[0] == "short\n" * 3 and got[-1].endswith("end")


def test_tokens_are_lossless(spark):
    df = spark.createDataFrame([("  a b\n\nc ",), ("",), ("   ",)], "t string")
    rows = df.select("t", tok.join(tok.tokens(F.col("t"))).alias("back"), tok.count(F.col("t")).alias("n")).collect()
    assert all(r["t"] == r["back"] for r in rows)
    assert [r["n"] for r in rows] == [4, 0, 1]


def nested_pieces(text, room, separators):
    """Splitting again and again, as the description reads."""
    pieces = [text]
    for sep in separators:
        out = []
        for p in pieces:
            if len(p) <= room:
                out.append(p)
            else:
                parts = p.split(sep)
                out += [x + sep for x in parts[:-1]] + parts[-1:]
        pieces = out
    pieces = [q for p in pieces for q in ([p[i : i + room] for i in range(0, len(p), room)] if len(p) > room else [p])]
    return [p for p in pieces if p]


def nested_chunks(text, size, overlap, separators):
    room = size - overlap
    pieces = nested_pieces(text, room, separators)
    at = greedy([len(p) for p in pieces], room)
    chunks = [[p for p, b in zip(pieces, at) if b == k] for k in range(max(at, default=-1) + 1)]
    out = []
    for k, own in enumerate(chunks):
        again, room_left = [], overlap
        for p in reversed(chunks[k - 1] if k else []):
            if len(p) > room_left:
                break
            again.insert(0, p)
            room_left -= len(p)
        out.append("".join(again + own))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_recursive_spans_match_nested_splitting(seed):
    rng = random.Random(seed)
    for _ in range(200):
        text = "".join(rng.choice(["\n", "\n\n", " ", "  ", "a", "éß", "word", "x" * 30, "𝄞"]) for _ in range(rng.randrange(60)))
        size = rng.randrange(5, 40)
        overlap = rng.randrange(0, size)
        got = [text[a:b] for a, b in split.recursive_spans(text, size, overlap, ["\n\n", "\n", " "])]
        assert got == nested_chunks(text, size, overlap, ["\n\n", "\n", " "])


def test_splitters_take_time_in_proportion():
    def spent(words, spans):
        text = " ".join(f"word{i % 977}" for i in range(words))
        start = time.perf_counter()
        assert list(spans(text))
        return time.perf_counter() - start

    for spans in (lambda t: split.recursive_spans(t, 300, 60, ["\n\n", "\n", " "]), lambda t: split.window_spans(t, 300, 60, "\n")):
        once = min(spent(200_000, spans) for _ in range(5))
        assert min(spent(400_000, spans) for _ in range(5)) <= 2.2 * once + 0.02


def test_chunks_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (None, "a b"), (4, "x" * 10), (4, "x" * 10)]
    df = spark.createDataFrame(rows, "`the key` int, text string")
    got = chunk.chunk_recursive(df, "the key", "text", 5, 1).collect()
    assert sorted((r[0] or 0, r[1], r[2]) for r in got) == [(0, 0, "a b"), (3, 0, " "), *sorted([(4, 0, "xxxx"), (4, 1, "xxxx"), (4, 2, "xx")] * 2)]
    got = chunk.chunk_chars(df, "the key", "text", 6, 2).collect()
    assert sorted((r[0] or 0, *tuple(r)[1:]) for r in got) == [
        (0, 0, "a b", 3), (3, 0, " ", 1), *sorted([(4, 0, "xxxxxx", 6), (4, 1, "xxxxxx", 6), (4, 2, "xx", 2)] * 2)]


def test_splitters_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    for made in (chunk.chunk_recursive(df, "id", "text"), chunk.chunk_chars(df, "id", "text")):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_registered_splitter_is_a_table_function(spark):
    chunk.register_chunker(spark, "by_comma", lambda text: text.split(","))
    chunk.register_chunker(spark, "letters_of", lambda text: ((c, 1) for c in text if c.isalpha()))
    rows = [(1, "a,b", "k"), (2, None, "k"), (3, "", "k"), (4, "c," * 30_000, "k"), (1, "a,b", "k")]
    df = spark.createDataFrame(rows, "id int, `the text` string, more string")
    got = chunk.chunk(df, "the text", "by_comma")
    assert got.columns == ["id", "more", "chunk_index", "chunk", "n_tokens"]
    found = got.collect()
    assert sorted(tuple(r) for r in found if r.id != 4) == [
        (1, "k", 0, "a", None), (1, "k", 0, "a", None), (1, "k", 1, "b", None), (1, "k", 1, "b", None), (3, "k", 0, "", None)]
    assert sum(r.id == 4 for r in found) == 30_001
    df.createOrReplaceTempView("splitting")
    told = spark.sql("SELECT d.id, c.chunk, c.n_tokens FROM splitting d, LATERAL letters_of(d.`the text`) c WHERE d.id = 1")
    assert sorted(tuple(r) for r in told.collect()) == [(1, "a", 1)] * 2 + [(1, "b", 1)] * 2
    with pytest.raises(ValueError):
        chunk.chunk(df, "the text", "nobody_registered")
