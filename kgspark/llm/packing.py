"""Packing of tokenised documents into fixed windows by minimum bin slack."""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kgspark.llm.common import staged, texts_for_python

WINDOW = 1024
END_ID = 0
# Pieces that one packing task gets: at most about this many windows of two-byte ids in its memory.
PIECES_PER_TASK = 20_000
CACHED_CHUNKS = 400_000

_GAP = re.compile(r"(?<=\S)(?= \S)")
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte.

    Printable bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of texts by a byte-level BPE vocabulary file, as little-endian two-byte numbers.

    No token crosses the gap before a blank between two non-blanks, so a text is encoded chunk by
    chunk, and chunks that come again are looked up. Chunks of Latin letters go through a faster
    library with the same vocabulary; all others through the vocabulary's own.
    """

    def __init__(self, vocabulary: str, pattern: str):
        self.own = Tokenizer.from_str(vocabulary)
        letters = byte_letters()
        if self.own.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit two bytes")
        special = {t["content"] for t in json.loads(vocabulary).get("added_tokens", ())}
        self.special = tuple(special)
        ranks = {
            bytes(letters[c] for c in token): k for token, k in json.loads(vocabulary)["model"]["vocab"].items() if token not in special
        }
        self.fast = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.inner = _Chunks(self, " ")
        self.first = _Chunks(self, "")

    def encode(self, text: str) -> bytes:
        if not text or max(text) < "ɐ":
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.own.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u2").tobytes()

    def ids(self, text: str) -> bytes:
        # a special token in a text is one id, which only the vocabulary's own library gives
        if any(token in text for token in self.special):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        head, *rest = text.split(" ")
        try:
            return self.first[head] + b"".join([self.inner[x] for x in rest])
        except _Blanks:  # blanks side by side
            return b"".join([self.encode(x) for x in _GAP.split(text)])


class _Blanks(Exception):
    pass


class _Chunks(dict):
    """Ids of chunks seen before; new ones are kept up to a fixed number."""

    def __init__(self, encoder: Encoder, lead: str):
        self.encoder, self.lead = encoder, lead

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Blanks
        found = self.encoder.encode(self.lead + chunk)
        if len(self) < CACHED_CHUNKS:
            self[chunk] = found
        return found


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary: str, pattern: str) -> Encoder:
    """One per worker process, so that its chunks serve all its tasks."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary, pattern)
    return _encoders[key]


def crc_of(ids: bytes) -> int:
    """crc32 of ids as little-endian four-byte numbers, from two-byte ones."""
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())


def cut(ids: bytes, window: int = WINDOW) -> Iterator[tuple[int, bytes]]:
    """Start and ids of each full window of a document, then of what is left."""
    for at in range(0, len(ids), 2 * window):
        yield at // 2, ids[at : at + 2 * window]


def fill(counts: list[int], room: int) -> tuple[int, dict[int, int]]:
    """Lengths, with how often each is taken, whose sum comes closest to ``room`` from below.

    Subset sums are the bits of one number: a length with ``c`` copies is added in 1, 2, 4, ...
    copies, each one a shift, until ``room`` itself is reached. The way back over the shifts gives
    the copies.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in range(min(room, len(counts) - 1), 0, -1):
        left, k = min(counts[length], room // length), 1
        while left:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, k = left - take, 2 * k
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    at = best
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] += take
            at -= length * take
    return best, dict(used)


def pack(pieces: list[tuple], window: int = WINDOW) -> Iterator[list[tuple]]:
    """Windows of ``(doc, start, ids, doc_tokens)`` pieces, all shorter than ``window``.

    Each window takes the longest piece left and the multiset of other lengths that fills it best;
    a multiset is used as often as there are pieces for it. What is still open is filled by cutting
    a longer piece. Only the last window can stay open; it is split at powers of two, which need no
    padding.
    """
    stacks: dict[int, list[tuple]] = defaultdict(list)
    counts = [0] * window
    for piece in reversed(pieces):
        stacks[len(piece[2]) // 2].append(piece)
        counts[len(piece[2]) // 2] += 1
    longest = window - 1
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return
        counts[longest] -= 1
        best, used = fill(counts, window - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        slack = window - longest - best
        times = 1 if slack else min(counts[k] // c for k, c in used.items())
        for _ in range(times):
            taken = [stacks[k].pop() for k, c in sorted(used.items(), reverse=True) for _ in range(c)]
            if slack == 0:
                yield taken
        for k, c in used.items():
            counts[k] -= c * times
        if slack:
            # any piece longer than the slack gives its front; the rest goes back
            other = next((k for k in range(window - 1, slack, -1) if counts[k]), None)
            if other is None:
                yield from _halves(taken)
                continue
            doc, start, ids, n = stacks[other].pop()
            counts[other] -= 1
            taken.append((doc, start, ids[: 2 * slack], n))
            stacks[other - slack].append((doc, start + slack, ids[2 * slack :], n))
            counts[other - slack] += 1
            yield taken


def _halves(pieces: list[tuple]) -> Iterator[list[tuple]]:
    left = sum(len(p[2]) // 2 for p in pieces)
    pieces = pieces[::-1]
    while left:
        room = size = 1 << (left.bit_length() - 1)
        out = []
        while room:
            doc, start, ids, n = pieces.pop()
            take = min(room, len(ids) // 2)
            out.append((doc, start, ids[: 2 * take], n))
            if 2 * take < len(ids):
                pieces.append((doc, start + take, ids[2 * take :], n))
            room -= take
        yield out
        left -= size


def tokenised(docs: DataFrame, vocabulary: str, pattern: str, id_col: str, text_col: str, window: int) -> DataFrame:
    """Pieces of every document: its full windows, and with ``ids`` what is left."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared.value, pattern)
        end = np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc"], batch["text"], strict=True):
                ids = encoder.ids(text) + end
                doc = None if pd.isna(doc) else int(doc)
                for start, part in cut(ids, window):
                    whole = len(part) == 2 * window
                    rows.append((doc, start, len(part) // 2, crc_of(part), len(ids) // 2, None if whole else part))
                if len(rows) > 20_000:
                    yield _frame(rows, PIECE)
                    rows = []
            yield _frame(rows, PIECE)

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts_for_python(texts).mapInPandas(pieces, PIECE)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"doc_id": "Int64"})


def pack_documents(
    docs: DataFrame,
    vocabulary_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    pieces_per_task: int = PIECES_PER_TASK,
) -> DataFrame:
    """Place every token of ``docs`` in a sequence of at most ``window`` tokens.

    Returns a row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``. A document is its ids and one end id, so a null or empty text is one
    token. Rows that repeat an id are packed as documents of their own. Null ids stay null, other
    columns are not looked at, and an empty table gives no rows. Sequences are full but for a few of
    a power-of-two length in each task.

    Full windows need no packing. What is left of the documents is dealt evenly over tasks of about
    ``pieces_per_task`` pieces by row number, not by id, and each task packs on its own. The pieces
    are a table in the shared folder, so a task that is run again sees the same rows.
    """
    vocabulary = Path(vocabulary_path).read_text(encoding="utf-8")
    pieces = staged(tokenised(docs, vocabulary, pattern, id_col, text_col, window), "pieces")
    whole = pieces.filter(F.col("length") == window).drop("ids")
    full = whole.withColumn("sequence_id", F.monotonically_increasing_id() * 2).withColumn("offset", F.lit(0).cast("long"))
    open_ = pieces.filter(F.col("length") < window).withColumn("row", F.monotonically_increasing_id())
    tasks = max(1, math.ceil(open_.count() / pieces_per_task))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if not held:
            return
        held = pd.concat(held, ignore_index=True).sort_values("row")
        docs_ = [None if pd.isna(d) else int(d) for d in held["doc_id"]]
        rows, sequence = [], TaskContext.get().partitionId() << 33
        for taken in pack(list(zip(docs_, held["start"], held["ids"], held["doc_tokens"], strict=True)), window):
            offset = 0
            for doc, start, ids, n in taken:
                rows.append((doc, start, len(ids) // 2, crc_of(ids), n, 2 * sequence + 1, offset))
                offset += len(ids) // 2
            sequence += 1
        yield _frame(rows, PLACED)

    packed = open_.select("row", "doc_id", "start", "ids", "doc_tokens").repartition(tasks, "row").mapInPandas(place, PLACED)
    return full.select(*packed.columns).unionByName(packed)
