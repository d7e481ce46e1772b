"""Stretches of words that repeat with a period, found through Lyndon words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.session import spread, tune

SHORTEST = 12
# Words of many texts that are looked at together; a longer text is looked at alone.
CHUNK_WORDS = 1 << 19

RUN = "struct<start:long,length:long,period:long>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def lyndon_lengths(letters: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place; 0 is a border that no word contains.

    This is the first phase of Baier's suffix sorter. Places are kept in groups that share a prefix,
    in the order of these prefixes. The highest group left is taken; each of its places ``i`` lengthens
    the prefix of the nearest place before it that is in a lower group, by the prefix of the group
    taken, once or as often as it is hit. Places so lengthened alike leave their group for a new one
    just above it. A place's prefix when its group is taken is its Lyndon word.
    """
    n = len(letters)
    out = [0] * n
    top = max(letters, default=0)
    if not top:
        return out
    group = list(letters)
    members: list[list[int]] = [[] for _ in range(top + 1)]
    for i, letter in enumerate(letters):
        members[letter].append(i)
    count = [len(m) for m in members]
    size = [1] * (top + 1)
    below, above = list(range(-1, top)), list(range(1, top + 2))
    above[top] = -1
    # places taken point to the place before them: the way to the nearest place not taken
    before = list(range(n + 1))
    now = top
    while now > 0:
        taken = members[now] if count[now] == len(members[now]) else [i for i in members[now] if group[i] == now]
        length = size[now]
        for i in taken:
            out[i] = length
            before[i + 1] = i
        hits: dict[int, int] = {}
        for i in taken:
            place = i + 1
            while before[place] != place:
                before[place] = before[before[place]]
                place = before[place]
            if place and group[place - 1]:
                hits[place - 1] = hits.get(place - 1, 0) + 1
        if hits:
            moves: dict[tuple[int, int], list[int]] = {}
            for place, times in hits.items():
                moves.setdefault((group[place], times), []).append(place)
            # the highest first, as each new group is put next to the one left
            for old, times in sorted(moves, reverse=True):
                places = moves[old, times]
                if len(places) == count[old]:
                    size[old] += times * length
                    continue
                new = len(members)
                for place in places:
                    group[place] = new
                members.append(places)
                count.append(len(places))
                size.append(size[old] + times * length)
                count[old] -= len(places)
                below.append(old)
                above.append(above[old])
                below[above[old]] = new
                above[old] = new
        now = below[now]
    return out


class Blocks:
    """Names of all blocks of 1, 2, 4, … letters; equal blocks have equal names. 0 borders are all unlike."""

    def __init__(self, letters: np.ndarray, longest: int):
        first = letters.astype(np.int64)
        borders = first == 0
        first[borders] = -1 - np.arange(int(borders.sum()))
        self.levels = [np.unique(first, return_inverse=True)[1]]
        self.n = len(first)
        while 1 << len(self.levels) <= longest:
            names, width = self.levels[-1], 1 << (len(self.levels) - 1)
            pairs = names[:-width] * np.int64(self.n) + names[width:] if width < len(names) else names[:0]
            self.levels.append(np.unique(pairs, return_inverse=True)[1])

    def shared(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """How many letters are the same from ``a`` and from ``b`` on, to the right or (-1) to the left."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            names, width = self.levels[level], 1 << level
            if not len(names):
                continue
            shift = 0 if step > 0 else width - 1
            x, y = a - shift, b - shift
            inside = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < len(names))
            same = inside & (names[np.where(inside, x, 0)] == names[np.where(inside, y, 0)])
            moved = np.where(same, width, 0)
            a, b, out = a + step * moved, b + step * moved, out + moved
        return out


def runs_of(letters: np.ndarray, shortest: int) -> np.ndarray:
    """All runs as rows (start, length, period), by start and period. 0 is a border between texts.

    A run has a Lyndon word of its period under the usual or the reversed order of letters, and that
    is the longest Lyndon word at its place. So each place's two words are tried as roots and followed
    to both sides as far as letters repeat. No run reaches over a border.
    """
    borders = np.flatnonzero(letters == 0)
    longest = int(np.diff(np.concatenate([[-1], borders, [len(letters)]])).max())
    blocks = Blocks(letters, longest)
    top = int(letters.max(initial=0))
    found = []
    for order in (letters, np.where(letters > 0, top + 1 - letters, 0)):
        period = np.array(lyndon_lengths(order.tolist()), np.int64)
        at = np.flatnonzero(period)
        period = period[at]
        right = blocks.shared(at, at + period, 1)
        left = blocks.shared(at - 1, at + period - 1, -1)
        length = left + period + right
        long = length >= np.maximum(shortest, 2 * period)
        found.append(np.stack([(at - left)[long], length[long], period[long]], axis=1))
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _suspects(hashes: np.ndarray, text_of: np.ndarray, shortest: int) -> np.ndarray:
    """Marks every word that lies in a run, and some others.

    The words of a run but its last period are each the same as the word a period on; with at least
    ``shortest`` words and two periods these are half of ``shortest`` or more. So each stretch of that
    many words in a run stands twice in its text, and the marked words of a run are without a gap.
    Equal hashes of unlike stretches only mark more.
    """
    width = (shortest + 1) // 2
    marked = np.zeros(len(hashes), bool)
    starts = len(hashes) - width + 1
    if starts < 2:
        return marked
    gram = text_of[:starts].astype(np.uint64)
    for k in range(width):
        gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + starts]
    gram ^= gram >> np.uint64(32)
    order = np.argsort(gram)
    ordered = gram[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(starts, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice &= text_of[:starts] == text_of[width - 1 :]
    edges = np.zeros(len(hashes) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return np.cumsum(edges[:-1]) > 0


def runs_in_texts(texts: list[list[bytes]], shortest: int) -> list[np.ndarray]:
    """The runs of each of some texts, given as words."""
    sizes = np.array([len(words) for words in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    hashes = np.fromiter((hash(w) for words in texts for w in words), np.int64, int(starts[-1])).view(np.uint64)
    marked = _suspects(hashes, np.repeat(np.arange(len(texts)), sizes), shortest)
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(texts)
    letters, place, owner = [0], [-1], [-1]
    number: dict[bytes, int] = {}
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    for low, high in edges.reshape(-1, 2).tolist():
        text = int(np.searchsorted(starts, low, "right")) - 1
        while low < high:
            # marked words of neighbouring texts touch
            end = min(high, int(starts[text + 1]))
            first = int(starts[text])
            letters += [number.setdefault(w, len(number) + 1) for w in texts[text][low - first : end - first]] + [0]
            place += list(range(low - first, end - first)) + [-1]
            owner += [text] * (end - low) + [-1]
            low, text = end, text + 1
    if len(letters) == 1:
        return out
    rows = runs_of(np.array(letters, np.int64), shortest)
    owners = np.array(owner, np.int64)[rows[:, 0]]
    rows[:, 0] = np.array(place, np.int64)[rows[:, 0]]
    for text in np.unique(owners).tolist():
        out[text] = rows[owners == text]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that any run repeats after its first period."""
    if not len(runs):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def _chunks(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    chunk, size = [], 0
    for text in texts:
        words = text.split() if text else []
        if chunk and size + len(words) > CHUNK_WORDS:
            yield chunk
            chunk, size = [], 0
        chunk.append(words)
        size += len(words)
    if chunk:
        yield chunk


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """The periodic runs of each whole text, and the text with each run cut to its first period.

    Returns one row per row of ``docs``: ``id_col``, ``n_words``, ``runs`` (start word, length and
    smallest period of each, by start, then period) and ``collapsed`` (the words left, joined by one
    space). Words are runs of anything but ASCII blanks, compared as they are, letter case included. A
    run is a stretch of at least ``shortest`` words and of at least two of its smallest periods that
    no neighbouring word extends with that period.

    Null and empty texts have no words, no runs and an empty ``collapsed``. A text is handled as a
    whole by one task, in time of n log n, whatever its length. Repeated rows and null ids are rows
    like any others. Other columns are not looked at, whatever their names. An empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    tune(docs.sparkSession)
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for chunk in _chunks(batch.column(1).to_pylist()):
                runs = runs_in_texts(chunk, shortest)
                parts = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                columns = [pa.array(parts[:, k], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(chunk)),
                        pa.array([len(words) for words in chunk], pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(_RUNS.value_type)), type=_RUNS),
                        pa.array([collapsed(words, r) for words, r in zip(chunk, runs)], pa.binary()).cast(pa.string()),
                    ],
                    names=["id", "n_words", "runs", "collapsed"],
                )
                done += len(chunk)

    found = rows.mapInArrow(work, f"id {id_type}, n_words long, runs array<{RUN}>, collapsed string")
    return found.withColumnRenamed("id", id_col)
