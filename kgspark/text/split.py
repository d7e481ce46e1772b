"""Splitting of one text by offsets: pieces at separators, packed in order into chunks.

Every piece is a pair of offsets into the text. Separators are searched once per level, inside the
pieces that are still too long, and each chunk's end is found by binary search over the pieces' ends,
so the work grows with the length of the text and nothing is cut out of it before its chunks are.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence


def _cut_at(text: str, ends: list[int], separator: str, longest: int) -> list[int]:
    """Ends of pieces once those longer than ``longest`` are cut after each separator."""
    find = re.compile(re.escape(separator)).finditer
    out, start = [], 0
    for end in ends:
        if end - start > longest:
            out += [m.end() for m in find(text, start, end)]
        if not out or out[-1] != end:
            out.append(end)
        start = end
    return out


def recursive_spans(text: str, size: int, overlap: int, separators: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Start and end of each chunk: at most ``size`` characters, cut at the widest separator that does.

    Each chunk starts with the last whole pieces of the one before, up to ``overlap`` characters.
    """
    room = size - overlap
    ends = [len(text)] if text else []
    for separator in separators:
        ends = _cut_at(text, ends, separator, room)
    cuts, start = [0], 0
    for end in ends:
        cuts += range(start + room, end, room)
        cuts.append(end)
        start = end
    at, begin = 0, 0
    while at < len(cuts) - 1:
        own = cuts[at]
        # a piece is never longer than the room
        stop = bisect_right(cuts, own + room, at + 1) - 1
        yield begin, cuts[stop]
        begin = cuts[bisect_left(cuts, cuts[stop] - overlap, at)]
        at = stop


def window_spans(text: str, size: int, overlap: int, separator: str) -> Iterator[list[tuple[int, int]]]:
    """Pieces of each chunk: text between separators, those longer than ``size`` as sliding windows."""
    pieces, start = [], 0
    for end in _cut_at(text, [len(text)] if text else [], separator, 0):
        if end - start > size:
            pieces += [(s, min(s + size, end)) for s in range(start, end, size - overlap)]
        else:
            pieces.append((start, end))
        start = end
    sums = [0]
    for low, high in pieces:
        sums.append(sums[-1] + high - low)
    at = 0
    while at < len(pieces):
        stop = max(at + 1, bisect_right(sums, sums[at] + size, at + 1) - 1)
        yield pieces[at:stop]
        at = stop
