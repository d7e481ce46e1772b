"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from kgspark.llm import periodic_runs as runs
from kgspark.llm.queries import QUERIES, with_planted_periods

SCHEMA = "doc_id long, text string, id string, runs int, collapsed long, h int, w string, a int, p int"


def frame(spark, rows):
    """Documents with extra columns named like the operator's own."""
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "w", 4, 5) for i, t in rows], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_lyndon(letters):
    n, out = len(letters), []
    for i in range(n):
        if not letters[i]:
            out.append(0)
            continue
        best = 1
        for j in range(i + 1, n + 1):
            word = letters[i:j]
            if 0 in word:
                break
            if all(word < word[k:] for k in range(1, len(word))):
                best = len(word)
        out.append(best)
    return out


def brute_runs(words, shortest):
    """Each period by itself: stretches in which every word is the same as the one a period on."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, 2 * q):
                # smaller periods were seen before
                if not any(s <= i and i + (j - i + q) <= s + length and q % p == 0 for (s, length), p in found.items()):
                    found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc, text):
    words = words_of(text)
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def corpus(seed, docs=60):
    rng = random.Random(seed)
    rows = []
    for k in range(docs):
        letters = rng.choice([["a", "b"], ["a", "b", "c", "A"], [f"w{i}" for i in range(50)]])
        words = rng.choices(letters, k=rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            at, period = rng.randrange(len(words) + 1), rng.randrange(1, 12)
            words[at:at] = (rng.choices(letters, k=period) * 9)[: rng.randrange(period, 9 * period)]
        rows.append((k, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_lyndon_lengths_match_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        letters = rng.choices(range(0 if seed % 2 else 1, rng.choice([2, 3, 5])), k=rng.randrange(0, 40))
        assert runs.lyndon_lengths(letters) == brute_lyndon(letters)


@pytest.mark.parametrize("shortest", [2, 5, 12])
def test_runs_of_texts_match_brute_force(shortest):
    rows = corpus(shortest, 200)
    texts = [[w.encode() for w in words_of(t)] for _, t in rows]
    found = runs.runs_in_texts(texts, shortest)
    assert any(len(r) > 1 for r in found)
    for words, got in zip(texts, found):
        assert [tuple(r) for r in got.tolist()] == brute_runs(words, shortest)
        assert runs.collapsed(words, got).decode() == brute_collapsed([w.decode() for w in words], brute_runs(words, shortest))


def test_blocks_reach_both_ways_up_to_borders():
    letters = np.array([0, 1, 2, 1, 2, 1, 0, 1, 2, 1, 3, 0])
    blocks = runs.Blocks(letters, 8)
    at = np.array([[a, b] for a in range(12) for b in range(12) if a != b])
    for step in (1, -1):
        got = blocks.shared(at[:, 0], at[:, 1], step)
        for (a, b), n in zip(at.tolist(), got.tolist()):
            m = 0
            while 0 <= min(a, b) and max(a, b) < 12 and letters[a] == letters[b] != 0:
                a, b, m = a + step, b + step, m + 1
            assert n == m


LONG = " ".join(["x y z"] * 30_000)
ODD = [(1000, None), (1001, ""), (1002, " \n "), (1003, "one"), (None, "a " * 20), (1003, "one"), (1004, LONG), (1005, "é é " * 12)]


def test_periodic_runs_of_odd_rows(spark):
    got = runs.periodic_runs(frame(spark, ODD)).collect()
    assert sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs]) for r in got) == sorted(
        [
            (1000, 0, []),
            (1001, 0, []),
            (1002, 0, []),
            (1003, 1, []),
            (1003, 1, []),
            (0, 20, [(0, 20, 1)]),
            (1004, 90_000, [(0, 90_000, 3)]),
            (1005, 12, [(0, 12, 1)]),
        ]
    )
    assert {r.doc_id: r.collapsed for r in got} | {1003: "one"} == {
        1000: "", 1001: "", 1002: "", 1003: "one", None: "a", 1004: "x y z", 1005: "é é",
    }
    assert runs.periodic_runs(frame(spark, ODD).limit(0)).collect() == []


def test_query_matches_brute_force(spark, tmp_path):
    rows = corpus(3, 300) + ODD
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    texts = {(r.doc_id, r.text) for r in with_planted_periods(frame(spark, rows)).collect()}
    assert {(i, tuple(words_of(t))) for i, t in texts} == {(i, tuple(planted(i, t))) for i, t in rows}
    want = set()
    for doc, text in rows:
        if text == LONG:
            continue
        words = planted(doc, text)
        found = brute_runs(words, 12)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        want.add(
            (doc, len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None)
            + tuple(hashlib.sha256(x.encode()).hexdigest() for x in (lines, brute_collapsed(words, found)))
        )
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert {tuple(r) for r in got.collect() if r.doc_id != 1004} == want
