"""Language identification by prediction with partial matching over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.common import texts_for_python


ORDER = 3
DOCS_PER_LANGUAGE = 3_000
CONTEXTS = 16_384
LANGUAGES = 256
HELD_OUT = 2
# A text that no learned language codes in fewer bits than it has is in none of them.
MAX_BITS_PER_BYTE = 8.0
# Share of a language's labelled documents not learned from that its limit is read from, in steps of so many bits.
KNOWN_SHARE, STEP_BITS = 0.999, 0.02
# Three standard deviations of a byte's bits: what a mean over n bytes may be off is this over the root of n.
MARGIN_BITS = 8.0
UNKNOWN = "und"

SLICE_BYTES = 1 << 17
# All ASCII but letters becomes a blank; bytes of other letters stay.
_ONLY_LETTERS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
_WORDISH = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return text is not None and any(m[0].isalpha() for m in _WORDISH.finditer(text))


def letters(text: str | None) -> bytes:
    """The bytes that are modelled: lower-cased words, one blank before each and one after the last."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_ONLY_LETTERS).split()
    return b" " + b" ".join(words) + b" " if words else b""


def _slices(parts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes with ``ORDER`` bytes of context before each part, and the part each scored byte belongs to.

    Whole texts, in slices of bounded size: a text longer than a slice goes on in the next one with
    its last bytes as context.
    """
    held: list[tuple[int, bytes]] = []
    size = 0
    for k, part in enumerate(parts):
        padded = b" " * ORDER + part
        for at in range(ORDER, len(padded), SLICE_BYTES):
            piece = padded[at - ORDER : at + SLICE_BYTES]
            held.append((k, piece))
            size += len(piece)
            if size >= SLICE_BYTES:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat([k for k, _ in held], [len(p) for _, p in held])
    starts = np.cumsum([0] + [len(p) for _, p in held[:-1]])
    scored = np.ones(len(owner), bool)
    for shift in range(ORDER):
        scored[starts + shift] = False
    return np.frombuffer(b"".join(p for _, p in held), np.uint8), np.where(scored, owner, -1)


@dataclass
class Model:
    """Frozen statistics: ``bits[context * symbols + symbol, language]`` and how to find a context."""

    languages: list[str]
    symbol: np.ndarray  # of a byte; 0 for bytes never seen
    symbols: int
    context: np.ndarray  # of the last ORDER symbols, the longest kept one
    bits: np.ndarray
    shares: dict[str, float] | None = None  # of the learnable documents of each language, those learned from
    sent: Broadcast | None = None

    def broadcast(self, spark: SparkSession) -> Broadcast:
        """The model in the tasks; sent once, so that a Python worker never holds it twice."""
        if self.sent is None:
            self.sent = spark.sparkContext.broadcast(self)
        return self.sent

    def __getstate__(self) -> dict:
        return self.__dict__ | {"sent": None}


def code_lengths(model: Model, parts: list[bytes]) -> np.ndarray:
    """Bits that each language's model needs for each part, a row per part."""
    total = np.zeros((len(parts), len(model.languages)))
    for raw, owner in _slices(parts):
        sym = model.symbol[raw]
        code = np.zeros(len(sym) - ORDER, np.int64)
        for back in range(ORDER):
            code = code * model.symbols + sym[back : len(sym) - ORDER + back]
        at = np.flatnonzero(owner[ORDER:] >= 0)
        mine = owner[ORDER:][at]
        rows = model.bits[model.context[code[at]].astype(np.int64) * model.symbols + sym[ORDER:][at]]
        first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]]) if len(mine) else mine
        if len(first):
            total[mine[first]] += np.add.reduceat(rows, first, axis=0, dtype=np.float64)
    return total


def predict(model: Model | None, texts: list[str | None]) -> pd.DataFrame:
    """``lang_pred``, ``score``, ``bits_per_byte`` and ``length`` in modelled bytes of each text."""
    parts = [letters(t) for t in texts]
    known = np.array([has_letter(t) for t in texts], bool)
    if model is None or not len(texts):
        return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "bits_per_byte": np.nan, "length": 1})
    bits = code_lengths(model, parts)
    best = bits.argmin(axis=1)
    least = bits[np.arange(len(texts)), best]
    share = 1.0 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(axis=1)
    names = np.array(model.languages, object)[best]
    names[~known] = UNKNOWN
    length = np.array([max(1, len(p)) for p in parts])
    return pd.DataFrame(
        {
            "lang_pred": names,
            "score": np.where(known, share, 0.0),
            "bits_per_byte": np.where(known, least / length, np.nan),
            "length": length,
        }
    )


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``ORDER + 1`` bytes of the modelled texts, as numbers, and how often each occurs."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for raw, owner in _slices([letters(t) for t in texts]):
        code = np.zeros(len(raw) - ORDER, np.int64)
        for back in range(ORDER + 1):
            code = code * 256 + raw[back : len(raw) - ORDER + back]
        found.append(np.unique(code[owner[ORDER:] >= 0], return_counts=True))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a slice's codes are few once they are counted
    codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)


def build_model(languages: list[str], lang: np.ndarray, code: np.ndarray, n: np.ndarray, contexts: int = CONTEXTS) -> Model:
    """Context trees with escape probabilities, worked out for every kept context and symbol.

    A context of which a language has seen ``n`` symbols, ``d`` of them different, gives a symbol
    seen ``c`` times ``c / (n + d)``. The rest, ``d / (n + d)``, escapes to the context one byte
    shorter, whose shares are scaled up over the symbols not seen here; below the empty context all
    256 bytes are equal. The ``contexts`` most frequent contexts of full depth are kept, and all the
    shorter ones: this bounds the model, and texts of any other context are coded by a shorter one.
    """
    digits = np.stack([(code >> (8 * (ORDER - k))) & 255 for k in range(ORDER + 1)])
    seen = np.unique(digits)
    symbol = np.zeros(256, np.uint8 if len(seen) < 256 else np.uint16)
    symbol[seen] = np.arange(1, len(seen) + 1)
    a = len(seen) + 1
    digits = symbol[digits].astype(np.int64)
    size = len(languages)
    prob = np.full((1, a, size), 1 / 256)
    context = np.zeros(1, np.int32)
    for order in range(ORDER + 1):
        key = np.zeros(len(code), np.int64)
        for k in range(ORDER - order, ORDER):
            key = key * a + digits[k]
        kept, where = np.unique(key, return_inverse=True)
        if order == ORDER and len(kept) > contexts:
            weight = np.bincount(where, n)
            top = np.sort(np.argsort(-weight, kind="stable")[:contexts])
            inside = np.full(len(kept), -1)
            inside[top] = np.arange(len(top))
            kept, where = kept[top], inside[where]
        ok = where >= 0
        count = np.zeros((len(kept), a, size))
        np.add.at(count, (where[ok], digits[ORDER][ok], lang[ok]), n[ok])
        total, distinct = count.sum(axis=1, keepdims=True), (count > 0).sum(axis=1, keepdims=True)
        parent = context[kept % a ** max(0, order - 1)] if order else np.zeros(len(kept), np.int32)
        lower = prob[parent]
        unseen = np.where(count > 0, 0.0, lower)
        left = 1 - np.where(count > 0, lower, 0.0).sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            escaped = np.where(left > 1e-9, unseen / left, 0.0) * distinct / (total + distinct)
            own = np.where(count > 0, count / (total + distinct), escaped)
        own = np.where(total > 0, own, lower)
        base = len(prob) if order else 0
        prob = np.concatenate([prob, own]) if order else own
        longer = np.zeros(a**order, np.int32)
        if order:
            longer[:] = np.tile(context, a)
        longer[kept] = base + np.arange(len(kept))
        context = longer
    bits = -np.log2(np.maximum(prob, 1e-12)).astype(np.float32).reshape(-1, size)
    return Model(languages, symbol, a, context, bits)


def learnable(id_col: str) -> Column:
    """Rows that may be learned from: crc32 of the id's text, modulo 4, is known and not 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != HELD_OUT, F.lit(False))


def _drawn(ids: Column, lang: Column, shares: dict[str, float]) -> Column:
    """Whether a learnable row is one of its language's share."""
    known = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    return F.pmod(F.xxhash64(ids, F.lit(17)), F.lit(1 << 20)) / float(1 << 20) < F.coalesce(known[lang], F.lit(0.0))


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_language: int = DOCS_PER_LANGUAGE,
    contexts: int = CONTEXTS,
    languages: int = LANGUAGES,
) -> Model | None:
    """Learn a model from about ``docs_per_language`` labelled documents of each language.

    The sample is by hash of the id, so it is the same in every run; its documents are read whole.
    Of more than ``languages`` labels the most frequent are learned. Null labels, null texts and held
    out documents are left out; without any labelled text there is no model (None). Counting is done
    in the tasks; the driver gets sums of byte runs, whose number is bound by the sample.
    """
    rows = docs.filter(learnable(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not sizes:
        return None
    shares = {r["lang"]: docs_per_language / r["count"] for r in sizes}
    drawn = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    drawn = drawn.filter(_drawn(F.col("id"), F.col("lang"), shares))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                code, n = grams(list(own["text"]))
                yield pd.DataFrame({"lang": lang, "code": code, "n": n})

    sums = texts_for_python(drawn.select("lang", "text")).mapInPandas(count, "lang string, code long, n long")
    found = sums.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas().sort_values(["lang", "code"])
    if found.empty:
        return None
    names = sorted(found["lang"].unique())
    lang = found["lang"].map({x: k for k, x in enumerate(names)}).to_numpy()
    model = build_model(names, lang, found["code"].to_numpy(np.int64), found["n"].to_numpy(np.int64), contexts)
    model.shares = shares
    return model


def limits(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> dict[str, float]:
    """The bits per byte that a long text of each language may take, from all labelled documents not learned from.

    Of a language's documents that the model finds to be in it, the bits per byte less the margin of
    their length are counted in steps. The limit lies over the ``KNOWN_SHARE`` quantile by as much as
    that lies over the median, and by ``MARGIN_BITS`` over the root of the number of documents, so
    few documents give a loose limit. A language without such a document has none.
    """
    if model is None:
        return {}
    used = F.coalesce(learnable(id_col) & _drawn(F.col(id_col), F.col(lang_col), model.shares or {}), F.lit(False))
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~used)
    shared = model.broadcast(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = predict(shared.value, list(batch["text"]))
            told = told[(told["lang_pred"] == batch["lang"].reset_index(drop=True)) & told["bits_per_byte"].notna()]
            over = told["bits_per_byte"] - MARGIN_BITS / np.sqrt(told["length"])
            steps = pd.DataFrame({"lang": told["lang_pred"], "step": np.floor(over / STEP_BITS).astype("int64")})
            yield steps.groupby(["lang", "step"]).size().reset_index(name="n")

    narrow = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sums = texts_for_python(narrow).mapInPandas(count, "lang string, step long, n long").groupBy("lang", "step").agg(F.sum("n").alias("n"))
    found: dict[str, list[tuple[int, int]]] = {}
    for r in sums.collect():
        found.setdefault(r["lang"], []).append((r["step"], r["n"]))
    return {lang: limit_of(steps) for lang, steps in found.items()}


def limit_of(steps: list[tuple[int, int]]) -> float:
    """The limit from (step, documents) of one language."""
    step, n = np.array(sorted(steps)).T
    upto, total = np.cumsum(n), n.sum()
    middle, high = ((step[np.searchsorted(upto, q * total)] + 1) * STEP_BITS for q in (0.5, KNOWN_SHARE))
    return float(high + (high - middle) + MARGIN_BITS / np.sqrt(total))


def with_language(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "language") -> DataFrame:
    """Add ``out``, a struct of ``lang_pred``, ``score``, ``bits_per_byte``, from the whole text.

    ``und`` with score 0 stands for a null text, one without a letter, and for every text if there is
    no model. ``score`` is the share of the best language in the sum of the probabilities all give to
    the text; equal code lengths go to the first name. Repeated rows get equal answers, an empty table
    gives none, a column named like ``out`` is replaced, and no other column is looked at.
    """
    shared = model and model.broadcast(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared and shared.value
        for batch in batches:
            yield predict(own, list(batch))[["lang_pred", "score", "bits_per_byte"]]

    return texts_for_python(docs).withColumn(out, judge(F.col(text_col)))


def in_known_language(
    docs: DataFrame, model: Model | None, text_col: str = "text", most: dict[str, float] | None = None
) -> DataFrame:
    """``docs`` without texts in none of the learned languages.

    These are ``und``, or coded in no less than the limit that ``most`` (of ``limits``) has for the
    likeliest language, plus ``MARGIN_BITS`` over the root of the text's bytes, and anyway in 8 bits
    a byte or more. Without a model nothing is known of any language: all texts with a letter stay.
    """
    if model is None:
        return docs.filter(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    shared, most_bits = model.broadcast(docs.sparkSession), most or {}

    @F.pandas_udf("boolean")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in batches:
            told = predict(own, list(batch))
            limit = np.array([most_bits.get(x, MAX_BITS_PER_BYTE) for x in told["lang_pred"]], float)
            limit = np.minimum(MAX_BITS_PER_BYTE, limit + MARGIN_BITS / np.sqrt(told["length"]))
            yield (told["lang_pred"] != UNKNOWN) & (told["bits_per_byte"] < limit)

    return texts_for_python(docs).filter(known(F.col(text_col)))
