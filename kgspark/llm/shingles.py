"""Sets of word shingles as sorted 64-bit hashes, made with numpy in the tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
CACHED_WORDS = 400_000


class _Words(dict):
    """Hashes of words seen before, up to a fixed number."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = found
        return found


_words = _Words()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Distinct ``n``-word shingles of a whole text, as sorted hashes.

    Words are runs of anything but ASCII blanks, A-Z lower-cased. With fewer than ``n`` words the
    whole sequence is one shingle; without words, or for null, the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out * _MIX[0] + hashes[k : len(words) - width + 1 + k])
    return np.unique(out)


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed numbers; the order of the hashes has no say."""
    one = mixed(hashes + _MIX[0]).sum(dtype=np.uint64)
    two = mixed(hashes * _MIX[2] + _MIX[1]).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def shared_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of a bounded block of sets."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    column = np.cumsum(often) - 1
    kept = often[where]
    owner, at = owner[kept], column[where[kept]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for low in range(0, int(often.sum()), columns):
        a, b = np.searchsorted(at, [low, low + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[owner[a:b], at[a:b] - low] = 1
        out += part @ part.T
    return out.astype(np.int64)
