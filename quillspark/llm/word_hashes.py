"""Hashes of all words of a text at once, as numpy arrays.

A word's bytes are a number in a fixed odd base modulo 2**64.  With running sums
over the text a word's number is a difference of two sums, brought to the place
of the first byte by the inverse of the base, and then mixed.  Words of more than
``LONG`` bytes, for which such numbers can be made to collide, are hashed by
themselves.
"""

from __future__ import annotations

import numpy as np
import xxhash

BASE, LONG = 0x9E3779B97F4A7C15, 64
#: Bytes that go through at once; tables of powers are as long.
PIECE = 1 << 18
_MULT = np.uint64(BASE)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            table = np.full(max(n, 1 << 16), b, dtype=np.uint64)
            table[0] = 1
            _POWERS[k : k + 1] = [np.multiply.accumulate(table)]
    return _POWERS[0], _POWERS[1]


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and their hashes, which depend on the words' bytes alone.

    Words are what blanks separate; the data ends in a blank.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = raw != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(raw) and inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(raw * up[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h = (h ^ (h >> np.uint64(32))) * _MULT
    h ^= h >> np.uint64(29)
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return starts, ends, h


def hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of a text of any length."""
    if len(data) <= PIECE:
        return words_of(data + b" ")[2]
    out, at = [], 0
    while at < len(data):
        end = data.rfind(b" ", at, at + PIECE)  # the last blank in reach
        if end <= at or len(data) - at <= PIECE:
            if len(data) - at <= PIECE:
                out.append(words_of(data[at:] + b" ")[2])
                break
            if end == at or data[at : at + 1] == b" ":
                at += 1
                continue
            end = data.find(b" ", at)  # a word that is longer than a piece
            end = len(data) if end < 0 else end
            word = data[at:end]
            out.append(words_of(word + b" ")[2] if len(word) <= LONG else np.array([xxhash.xxh3_64_intdigest(word)], dtype=np.uint64))
        else:
            out.append(words_of(data[at:end] + b" ")[2])
        at = end + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
