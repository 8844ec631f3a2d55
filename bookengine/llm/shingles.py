"""Word shingles of whole texts as 64-bit numbers, vectorised over the bytes of many documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from bookengine.llm.columns import LOWER, byte_steps, word_bounds

WORDS = 5
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, size: int) -> np.ndarray:
    """base ** 0 .. base ** (size - 1), modulo 2 ** 64; kept by the worker up to the longest step seen."""
    have = _powers.get(base)
    if have is None or len(have) < size:
        run = np.full(max(size, 1 << 20), base, np.uint64)
        run[0] = 1
        have = _powers[base] = np.multiply.accumulate(run)
    return have[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of a 64-bit number spread over all places (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, ASCII letters in lower case."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    value = (sums[ends] - sums[starts]) * powers(_INVERSE, len(data) + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _joined(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    value = np.full(len(at), width, np.uint64)
    for k in range(width):
        value = mix(value * np.uint64(BASE) + words[at + k])
    return value


def shingle_sets(batch: pa.RecordBatch, column: str = "text", width: int = WORDS) -> Iterator[np.ndarray]:
    """For each row the sorted distinct shingles; fewer words than ``width`` are one shingle, no words none."""
    for _, _, data, offsets in byte_steps(batch, column):
        starts, ends, first = word_bounds(data, offsets)
        words = word_hashes(data, starts, ends)
        count = np.diff(first)
        values = np.zeros(len(words), np.uint64)
        if len(words) >= width:
            values[: len(words) - width + 1] = _joined(words, np.arange(len(words) - width + 1), width)
        for row, n in enumerate(count.tolist()):
            a = first[row]
            if n >= width:
                out = np.sort(values[a : a + n - width + 1])
                yield out[np.concatenate([[True], out[1:] != out[:-1]])]
            elif n:
                yield _joined(words, np.array([a]), n)
            else:
                yield np.zeros(0, np.uint64)
