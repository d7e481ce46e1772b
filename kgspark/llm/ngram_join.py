"""Near-duplicate documents: grouped prefix join on the Jaccard similarity of word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgspark.graph.components import connected_components
from kgspark.llm.common import small_or_plain, staged, texts_for_python
from kgspark.llm.shingles import set_digest, shared_counts, shingle_set

# Shares of all hashes that larger sets are searched by, after the whole range for small ones.
SHARES = (1.0, 0.5, 0.25)
# Shingles of a set that tell whether it can have a partner.
SAMPLE = 64
# exp(-SURE) bounds the chance that a share holds too few shingles of a set.
SURE = 40.0
# Documents and shingles that are verified together in one task.
BLOCK_DOCS = 512
BLOCK_SHINGLES = 1_000_000


def level_sizes(percent: int) -> list[int]:
    """Smallest set size that each share of ``SHARES`` serves.

    A set of size n may miss ``miss * n`` of its shingles, so a share has to hold more of them. By
    Chernoff's bound it fails to with a chance below exp(-n * KL(miss, share)).
    """
    miss = 1 - percent / 100
    out = [0]
    for share in SHARES[1:]:
        if miss >= share:
            out.append(1 << 62)
            continue
        kl = (miss * math.log(miss / share) if miss else 0.0) + (1 - miss) * math.log((1 - miss) / (1 - share))
        out.append(math.ceil(SURE / kl))
    return out


def level_of(n: int, sizes: list[int]) -> int:
    return max(k for k, least in enumerate(sizes) if n >= least)


def tokens(hashes: np.ndarray, level: int) -> np.ndarray:
    """The hashes that stand for a set at a level, the level in the lowest bits."""
    share = SHARES[level]
    low = hashes if share == 1.0 else hashes[: np.searchsorted(hashes, np.uint64(int(share * 2**64)))]
    return ((low & ~np.uint64(3)) | np.uint64(level)).astype(np.int64)


def sample_bound(n: int) -> int:
    """Hashes below this are a set's sample: about ``SAMPLE`` of its shingles, the more the smaller the set."""
    return 1 << 64 if n <= SAMPLE else (SAMPLE << 64) // n


@cache
def most_alone(m: int, percent: int) -> int:
    """How many of ``m`` sampled shingles of a set may be in no other set, if it has a partner.

    A set with a partner misses at most the share ``miss`` of its shingles in it. A sample of m holds a
    share r > miss of those with a chance below exp(-m * KL(r, miss)); the first count for which that is
    below exp(-SURE) is out of the question.
    """
    miss = 1 - percent / 100
    for c in range(math.floor(m * miss) + 1, m + 1):
        r = c / m
        kl = (r * math.log(r / miss) if miss else math.inf) + ((1 - r) * math.log((1 - r) / (1 - miss)) if r < 1 else 0.0)
        if m * kl >= SURE:
            return c - 1
    return m


SIGNED = "doc long, n long, k1 long, k2 long, m int, most int, tokens array<long>"
LEVELLED = "doc long, n long, level int, tokens array<long>"


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    """Rows whose last column is a numpy array of long."""
    offsets = np.cumsum([0] + [len(r[-1]) for r in rows], dtype=np.int32)
    values = np.concatenate([r[-1] for r in rows]) if rows else np.zeros(0, np.int64)
    flat = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)]
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
    return pa.RecordBatch.from_arrays([*flat, lists], names=[*[name for name, _ in kinds], "tokens"])


def _mapped(texts: DataFrame, make, kinds: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += make(doc, text)
                if len(rows) >= 2000:
                    yield _batch(rows, kinds)
                    rows = []
            yield _batch(rows, kinds)

    return texts_for_python(texts.select("doc", "text")).mapInArrow(run, schema)


def signatures(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Per document: set size, set digest and a sample of its shingles.

    ``tokens`` holds the shingles that a partner may have in its own sample; the first ``m`` of them
    are this set's sample. Of those, at most ``most`` may be in no other set if it has a partner.
    """

    def sign(doc, text):
        own = shingle_set(text, words)
        n = len(own)
        m, wide = (
            len(own) if bound >> 64 else int(np.searchsorted(own, np.uint64(bound)))
            for bound in (sample_bound(n), sample_bound(n * percent // 100))
        )
        yield doc, n, *set_digest(own), m, most_alone(m, percent), own[:wide].astype(np.int64)

    long, int_ = pa.int64(), pa.int32()
    kinds = [("doc", long), ("n", long), ("k1", long), ("k2", long), ("m", int_), ("most", int_)]
    return _mapped(texts, sign, kinds, SIGNED)


def survivors(reps: DataFrame) -> DataFrame:
    """Ids of the sets whose samples do not rule out a partner; most sets of a corpus go here.

    One shuffle counts the sets of each sampled shingle, combined before it, and names the set of a
    shingle that only one has; a second one counts those per set.
    """
    sampled = reps.select("doc", "m", F.posexplode("tokens").alias("at", "key"))
    seen = sampled.groupBy("key").agg(F.count("*").alias("df"), F.max(F.when(F.col("at") < F.col("m"), F.col("doc"))).alias("doc"))
    alone = seen.filter("df = 1 AND doc IS NOT NULL").groupBy("doc").agg(F.count("*").alias("alone"))
    return reps.select("doc", "most").join(alone, "doc", "left").filter(F.coalesce("alone", F.lit(0)) <= F.col("most")).select("doc")


def levelled(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Per document and level: set size and the tokens it is searched by.

    A pair belongs to the level of its smaller set; so a set also joins the level of the smallest
    set that may match it.
    """
    sizes = level_sizes(percent)

    def place(doc, text):
        own = shingle_set(text, words)
        n = len(own)
        for level in sorted({level_of(n, sizes), level_of(-(-n * percent // 100), sizes)}):
            yield doc, n, level, tokens(own, level)

    return _mapped(texts, place, [("doc", pa.int64()), ("n", pa.int64()), ("level", pa.int32())], LEVELLED)


def prefixes(reps: DataFrame, percent: int) -> DataFrame:
    """doc, level, n, key: the tokens of each set's prefix that some other set has too.

    Tokens are ordered by how many sets have them, rare ones first, so passages that many documents
    share are in few prefixes. Tokens of one set only come first of all and match nothing: they are
    counted off and not moved a second time.
    """
    posted = reps.select("doc", F.explode("tokens").alias("key"))
    held = posted.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    shared = posted.join(held, "key")
    own = Window.partitionBy("doc", "level")  # one set's tokens
    ranked = (
        shared.withColumn("level", F.col("key").bitwiseAND(3).cast("int"))
        .join(reps.select("doc", "level", "n", F.size("tokens").alias("m")), ["doc", "level"])
        .withColumn("at", F.row_number().over(own.orderBy("df", "key")))
        .withColumn("alone", F.col("m") - F.count("*").over(own))
    )
    length = F.floor(F.col("n") * (100 - percent) / F.lit(100.0) + 1e-9) + 1
    return ranked.filter(F.col("at") + F.col("alone") <= length).select("doc", "level", "n", "key")


def candidate_edges(prefix: DataFrame) -> DataFrame:
    """Edges that connect all documents which may match, without making pairs.

    Documents with identical prefixes and size are one group, named by its smallest document. Groups
    are paired through their prefix tokens: each with the first group that has the token.
    """
    own = prefix.groupBy("doc", "level", "n").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    grouped = own.withColumn("same", F.xxhash64("n", "keys")).withColumn("same2", F.hash("keys", "level"))
    heads = grouped.groupBy("level", "n", "same", "same2").agg(F.min("doc").alias("group"), F.first("keys").alias("keys"))
    heads = staged(heads, "prefix-groups")
    members = grouped.select("doc", "level", "n", "same", "same2").join(heads.drop("keys"), ["level", "n", "same", "same2"])
    posted = heads.select("group", F.explode("keys").alias("key"))
    first = posted.groupBy("key").agg(F.min("group").alias("head"))
    stars = posted.join(first, "key").select(F.col("group").alias("source"), F.col("head").alias("target"))
    edges = members.select(F.col("doc").alias("source"), F.col("group").alias("target")).unionByName(stars)
    return edges.filter("source <> target").distinct()


def block_keys(cand: DataFrame, percent: int) -> DataFrame:
    """doc, n, copies, and ``keys``: the blocks (bucket, part, side) each candidate is verified in.

    Small components share a bucket with others. A large one is cut by size class, classes of more
    than a block by hash; every two blocks of the same or of neighbouring classes meet in one task.
    Sets of other classes differ too much in size to match.
    """
    sums = cand.groupBy("comp").agg(F.count("*").alias("docs"), F.sum("n").alias("sum"))
    large = sums.filter((F.col("docs") > BLOCK_DOCS) | (F.col("sum") > BLOCK_SHINGLES)).select("comp", F.lit(True).alias("large"))
    total = cand.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(total / (BLOCK_SHINGLES // 4)))
    one = "struct(pmod(xxhash64(comp), {}L) AS bucket, comp AS part, 0 AS side)".format(buckets)
    marked = cand.join(large, "comp", "left").withColumn(
        "class", F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / math.log(100 / percent)).cast("int")
    )
    marked = marked.withColumn("class", F.when(F.col("large"), F.col("class")))
    cells = (
        marked.filter("large")
        .groupBy("comp", "class")
        .agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    )
    around = (
        cells.select("comp", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"), F.col("class").alias("of"), "blocks")
        .groupBy("comp", "class")
        .agg(*[F.max(F.when(F.col("of") == F.col("class") + d, F.col("blocks"))).alias(a) for d, a in ((-1, "below"), (0, "here"), (1, "above"))])
        .filter("here IS NOT NULL")
    )
    pair = "struct(xxhash64(comp, {0}, {1}, {2}, {3}) AS bucket, xxhash64(comp, {0}, {1}, {2}, {3}, 1) AS part, {4} AS side)"
    many = "concat({}, {}, {})".format(
        "transform(sequence(0, here - 1), o -> " + pair.format("class", "least(mine, o)", "class", "greatest(mine, o)", "if(o = mine, 0, if(mine < o, 1, 2))") + ")",
        "if(above IS NULL, array(), transform(sequence(0, coalesce(above, 1) - 1), o -> " + pair.format("class", "mine", "class + 1", "o", "1") + "))",
        "if(below IS NULL, array(), transform(sequence(0, coalesce(below, 1) - 1), o -> " + pair.format("class - 1", "o", "class", "mine", "2") + "))",
    )
    placed = marked.join(around, ["comp", "class"], "left").withColumn("mine", F.expr("cast(pmod(xxhash64(doc, 5), here) AS int)"))
    return placed.select("doc", "copies", F.expr(f"if(large IS NULL, array({one}), {many})").alias("keys"))


VERIFIED = "doc long, root long, links long"


def links(texts: DataFrame, keyed: DataFrame, words: int, percent: int) -> DataFrame:
    """doc, root, links: per block, a document each one is connected with, and how many it matches.

    Whole sets are made again from the texts, for candidates only, and compared exactly.
    """

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (key["bucket"], key["part"], key["side"], doc, copies, raw)
                for doc, text, copies, keys in zip(batch["doc"], batch["text"], batch["copies"], batch["keys"], strict=True)
                for raw in [shingle_set(text, words).tobytes()]
                for key in keys
            ]
            yield pd.DataFrame(rows, columns=["bucket", "part", "side", "doc", "copies", "shingles"])

    def verify(block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in block.groupby("part"):
            own = part.drop_duplicates("doc")
            out.append(_verified(own["doc"].to_numpy(), own["side"].to_numpy(), own["copies"].to_numpy(), [np.frombuffer(s, np.uint64) for s in own["shingles"]], percent))
        return pd.concat(out)

    found = texts.join(keyed, "doc").select("doc", "text", "copies", "keys")
    made = found.mapInPandas(sets, "bucket long, part long, side int, doc long, copies long, shingles binary")
    return made.groupBy("bucket").applyInPandas(verify, VERIFIED)


def _verified(docs: np.ndarray, side: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], percent: int) -> pd.DataFrame:
    size = np.array([len(s) for s in sets])
    both = shared_counts(sets)
    match = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    # blocks of two sides: what lies on one side is verified elsewhere
    match &= (side[:, None] == 0) | (side[:, None] != side[None, :])
    np.fill_diagonal(match, False)
    root = np.arange(len(docs))
    while True:
        low = np.where(match, root[None, :], len(docs)).min(axis=1, initial=len(docs))
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return pd.DataFrame({"doc": docs, "root": docs[root], "links": match @ copies})


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_shingles``, ``component_id``, ``n_links``.

    Two documents link when their sets of ``words``-word shingles have a Jaccard similarity of at
    least ``percent`` / 100. ``component_id`` is the smallest id reachable over links, itself
    included; ``n_links`` counts the documents linked with this one. A document without words has
    no links. Rows that repeat an id have to be the same document listed again and count once. A
    null id gets no component and no links. Ids are integers; other columns are not looked at. An
    empty table gives no rows.

    Equal sets are collapsed first, and sets of which a sample shows that they cannot have a partner
    are left out. A link needs a common token in both prefixes, so candidates are found by them. Both
    steps are complete but for samples that misrepresent their set (chance below exp(-40) each).
    Candidates are verified in blocks, and a block gives one row per document, not pairs.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    signed = staged(signatures(texts, words, percent), "signatures")
    known = signed.filter("doc IS NOT NULL AND n > 0")
    once = texts.filter("doc IS NOT NULL")
    if not known.groupBy("doc").count().filter("count > 1").isEmpty():
        known, once = known.dropDuplicates(["doc"]), once.dropDuplicates(["doc"])
    classes = staged(known.groupBy("n", "k1", "k2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")), "set-classes")
    heads = classes.filter("copies > 1")
    others = staged(
        known.select("doc", "n", "k1", "k2").join(heads, ["n", "k1", "k2"]).filter("doc <> rep").select("doc"), "equal-sets"
    )
    reps = known.join(small_or_plain(others), "doc", "left_anti")
    searched = staged(survivors(reps), "searched")
    found = staged(levelled(once.join(small_or_plain(searched), "doc"), words, percent), "tokens")
    edges = staged(candidate_edges(staged(prefixes(found, percent), "prefixes")), "candidate-edges")
    comps = connected_components(edges).select(F.col("title").alias("doc"), F.col("component").alias("comp"))
    cand = staged(
        comps.join(classes.select(F.col("rep").alias("doc"), "n", "copies"), "doc"), "candidates"
    )
    keyed = staged(block_keys(cand, percent), "blocks")
    linked = staged(links(once, small_or_plain(keyed), words, percent), "links")
    joined = connected_components(linked.filter("doc <> root").select(F.col("doc").alias("source"), F.col("root").alias("target")))
    degree = linked.groupBy(F.col("doc").alias("rep")).agg(F.sum("links").alias("links"))
    named = (
        classes.join(joined.select(F.col("title").alias("rep"), "component"), "rep", "left")
        .join(degree, "rep", "left")
        .select("n", "k1", "k2", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    rows = signed.select("doc", "n", "k1", "k2")
    return rows.join(named, ["n", "k1", "k2"], "left").select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id"),
        F.when(F.col("doc").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )
