"""Vectorised splitting of many texts at once: code points, character classes, runs and 64-bit run hashes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

#: Code points that are handled together, so that a batch's arrays stay within some tens of MB.
BATCH_POINTS = 900_000
SPACE, LETTER, NUMBER, OTHER, BREAK = range(5)
_A, _B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    kinds = np.frombuffer("".join(map(unicodedata.category, map(chr, range(0x110000)))).encode(), np.uint8)[::2]
    table = np.full(0x110000, OTHER, np.uint8)
    table[kinds == ord("L")] = LETTER
    table[kinds == ord("N")] = NUMBER
    table[_WHITE] = SPACE
    return table


def batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BATCH_POINTS code points, one text at least."""
    start, points = 0, 0
    for i, text in enumerate(texts):
        points += len(text) + 1
        if points >= BATCH_POINTS:
            yield start, i + 1
            start, points = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each ended by a break; their classes; and where each text starts (and the end)."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = classes()[codes]
    kinds[ends - 1] = BREAK
    return codes, kinds, np.concatenate(([0], ends))


def hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of code points: the sum of one mixed number for each sign at its place in the run.

    Not a polynomial, whose even powers cancel out in strings of a regular pattern.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    first = np.zeros(len(codes), np.int64)
    first[starts] = starts
    place = np.arange(len(codes)) - np.maximum.accumulate(first)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) * np.uint64(_A) + place.astype(np.uint64) * np.uint64(_B)), dtype=np.uint64, out=total[1:])
    return mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
