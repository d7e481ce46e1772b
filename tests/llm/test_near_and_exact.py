"""Near and exact copies, line removal and benchmark search against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from kgspark.llm import exact_dedup, ngram_join, shingles
from kgspark.llm.common import lower_ascii
from kgspark.llm.decontaminate import contaminated, decontaminate
from kgspark.llm.exact_dedup import exact_duplicates
from kgspark.llm.line_dedup import drop_repeated_lines
from kgspark.llm.ngram_join import near_duplicates

SCHEMA = "doc_id long, text string, doc string, level int, h1 long, key string"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """Documents with extra columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "k") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "One"), (4, "one"), (5, "  \n\t "), (6, "Été À LA mer"), (7, "été À la mer"), (None, "lost"), (9, None)]


def shingle_sets(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1)))


def brute_components(rows, n, percent):
    sets = {i: shingle_sets(t, n) for i, t in rows if i is not None}
    low, links = {i: i for i in sets}, dict.fromkeys(sets, 0)
    edges = []
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a != b and sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                edges.append((a, b))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if low[b] < low[a]:
                low[a], changed = low[b], True
    return {i: (len(sets[i]), low[i], links[i]) for i in sets}


def near_corpus(seed, sizes, variants=6):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = rng.choices(vocabulary, k=40)
    rows, doc = [], 100
    for size in sizes:
        base = rng.choices(vocabulary, k=size)
        for _ in range(variants):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, size // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = words + passage
            rows.append((doc, " ".join(words)))
            doc += 1
    rng.shuffle(rows)
    return rows + [(1000 + k, t) for k, (_, t) in enumerate(rows[:5])]


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_near_duplicates_match_brute_force(spark, words, percent):
    rows = near_corpus(words, [5, 30, 100, 120, 125, 300, 600, 620]) + ODD
    got = near_duplicates(frame(spark, rows), words=words, percent=percent).collect()
    want = brute_components(rows, words, percent)
    assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id is not None} == want
    assert [tuple(r)[2:] for r in got if r.doc_id is None] == [(None, 0)]
    assert len(got) == len(rows)


def test_large_components_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 3)
    rows = near_corpus(8, [60, 200], variants=25)
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates(frame(spark, rows), words=3, percent=90).collect()}
    assert got == brute_components(rows, 3, 90)


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    text = " ".join(f"a{k}" for k in range(30))
    got = near_duplicates(frame(spark, [(4, text), (4, text), (2, text)])).collect()
    assert sorted(tuple(r)[:3] for r in got) == [(2, 26, 2), (4, 26, 2), (4, 26, 2)]


def test_shingle_hashes_are_those_of_whole_texts():
    assert len(shingles.shingle_set("a b c " * 5000, 3)) == 3
    assert len(shingles.shingle_set("A\x0bb", 3)) == 1
    assert (shingles.shingle_set("A b", 3) == shingles.shingle_set("a  B", 3)).all()
    assert not len(shingles.shingle_set(" \x0c", 3))
    long = " ".join(f"t{k}" for k in range(200_000))
    assert len(shingles.shingle_set(long, 3)) == 199_998


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(UP), []).append(i)
    return sorted(
        (
            (i, max(x for x in groups[k] if x is not None) if any(x is not None for x in groups[k]) else None, len(groups[k]))
            for i, t in rows
            for k in [(t or "").translate(UP)]
        ),
        key=repr,
    )


def weak_digest(text):
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 2))


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak_digest])
def test_exact_duplicates_match_brute_force(spark, digest):
    rng = random.Random(3)
    texts = [f"Text {k}" for k in range(400)]
    rows = [(k, rng.choice(texts)) for k in range(600)] + [(k + 1000, i[1]) for k, i in enumerate(ODD)] + [(None, "TEXT 1")]
    got = exact_duplicates(frame(spark, rows), digest=digest).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == brute_exact(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_duplicates_of_nothing_and_of_long_texts(spark):
    assert exact_duplicates(frame(spark, [])).count() == 0
    long = "Ab " * 400_000
    got = exact_duplicates(frame(spark, [(1, long), (2, long.lower()), (3, long + "x")])).collect()
    assert sorted((r.doc_id, r.keep_id) for r in got) == [(1, 2), (2, 2), (3, 3)]


def test_state_goes_on_over_later_files(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "state")
    rows = frame(spark, [(1, "a"), (5, "b")]).select(
        "doc_id", F.col("text").alias("norm")
    ).select(F.col("doc_id").alias("doc"), exact_dedup.sha256(F.col("norm")).alias("digest"), F.lit("f").alias("file"), F.lit(1).cast("long").alias("bytes"))
    rows.write.parquet(folder)
    read = lambda: spark.read.schema(rows.schema).parquet(folder)
    exact_dedup.digest_state(read(), checkpoint)
    rows.withColumn("doc", F.col("doc") + 2).write.mode("append").parquet(folder)
    state = exact_dedup.digest_state(read(), checkpoint).collect()
    assert sorted((r["size"], r["keep_id"]) for r in state) == [(2, 3), (2, 7)]


def test_lower_ascii_leaves_other_letters(spark):
    got = spark.createDataFrame([("ÀZé",), ("ABC",), ("",)], "t string").select(lower_ascii(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == ["Àzé", "abc", ""]


def brute_lines(rows, least=20, docs=3):
    strip = " \t\n\x0b\x0c\r"
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(strip).translate(UP)
            if len(key) >= least and i is not None:
                held.setdefault(key, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = lambda x: i is not None and len(held.get(x.strip(strip).translate(UP), ())) >= docs and i != max(held[x.strip(strip).translate(UP)])  # noqa: B023,E731
        kept = [x for x in lines if not gone(x)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_match_brute_force(spark):
    rng = random.Random(5)
    common = [f"Common line number {k} of the corpus" for k in range(12)] + ["short", "", "ÜBER alle Grenzen und Wege hinaus"]
    rows = []
    for k in range(60):
        lines = [rng.choice(common) if rng.random() < 0.6 else f"own line {k} {rng.random()} with words" for _ in range(rng.randrange(0, 12))]
        lines = [rng.choice(["", "  ", "\t"]) + x.replace("Common", rng.choice(["Common", "COMMON"])) + rng.choice(["", " ", "\r"]) for x in lines]
        rows.append((k, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, common[0] + "\n" + common[1]), (103, (common[0] + "\n") * 3000), (3, rows[3][1])]
    got = drop_repeated_lines(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_lines(rows)
    assert drop_repeated_lines(frame(spark, [])).count() == 0


def brute_leaks(docs, items, n=5, percent=80):
    def sets(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()

    held = [(i, sets(t)) for i, t in docs if i is not None]
    out = []
    for item, t in items:
        own = sets(t)
        out += [(i, item, len(own & s), len(own)) for i, s in held if own and own & s and 100 * len(own & s) >= percent * len(own)]
    return sorted(out)


def test_contaminated_matches_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(500)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([3, 6, 9, 30, 80])))) for k in range(40)]
    docs = []
    for k in range(150):
        words = rng.choices(vocabulary, k=rng.randrange(0, 600))
        if rng.random() < 0.6:
            leak = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, 1 + len(leak) // 20)):
                leak[rng.randrange(len(leak))] = "Other"
            words[5:5] = leak
        docs.append((k, " ".join(words).upper() if k % 3 else ", ".join(words)))
    docs += [(500, items[0][1]), (501, None), (502, ""), (None, items[3][1])]
    items += [(90, None), (91, ""), (92, "...")]
    bench = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, doc_id long")
    got = contaminated(frame(spark, docs), bench)
    assert sorted(tuple(r) for r in got.collect()) == brute_leaks(docs, items)
    left = decontaminate(frame(spark, docs), bench)
    bad = {r[0] for r in brute_leaks(docs, items)}
    assert sorted((r.doc_id is None, r.doc_id) for r in left.filter("doc_id IS NOT NULL").collect()) == sorted((False, i) for i, _ in docs if i is not None and i not in bad)
    assert left.columns == frame(spark, []).columns
    assert contaminated(frame(spark, []), bench).count() == 0
    assert contaminated(frame(spark, docs), bench.limit(0)).count() == 0


def test_sha_of_kept_text_is_plain(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256)).first()[0]
