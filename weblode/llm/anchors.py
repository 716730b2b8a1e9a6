"""Winnowed anchors: every window of a fixed number of units belongs to the leftmost least hash of the grams in it.

Equal windows have equal grams, so they belong to equal anchors at equal places; windows of different anchors are never equal. An anchor
with the windows next to each other that belong to it is one record, and the stretch of units those windows cover is its segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from weblode.llm.common import Rolling, sliding_argmin

#: A random 64-bit symbol for each byte.
BYTES = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes whose prefix sums are held at once.
PIECE = 1 << 20


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes alone."""
    out, k = np.zeros(len(starts), np.uint64), 0
    while k < len(starts):
        j = max(k + 1, int(np.searchsorted(ends, starts[k] + PIECE, "right")))
        low = starts[k]
        out[k:j] = Rolling(BYTES[body[low : ends[j - 1]]], 0x9E3779B97F4A7C15).of(starts[k:j] - low, ends[k:j] - low)
        k = j
    return out


def owned(symbols: np.ndarray, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Records (row, first window, number of windows, anchor hash, place of the anchor from the first window) of rows symbols[at[r] : at[r + 1]]; first counts over all symbols."""
    empty = np.zeros(0, np.int64)
    if len(symbols) < window:
        return empty, empty, empty, np.zeros(0, np.uint64), empty
    rolling = Rolling(symbols)
    grams = np.arange(len(symbols) - gram + 1)
    hashes = rolling.of(grams, grams + gram)
    place = sliding_argmin(hashes, window - gram + 1)[: len(symbols) - window + 1]
    row = np.searchsorted(at, np.arange(len(place)), "right") - 1
    inside = np.arange(len(place)) + window <= at[row + 1]
    first = inside & np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]])
    begin = np.flatnonzero(first)
    if not len(begin):
        return empty, empty, empty, np.zeros(0, np.uint64), empty
    number = np.add.reduceat(inside.astype(np.int64), begin)
    return row[begin], begin, number, hashes[place[begin]], place[begin] - begin


def byte_pieces(body: np.ndarray, at: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Rows cut to pieces (row, place in the row, symbols) that share window - 1 bytes, so that each window is in one piece."""
    for r in range(len(at) - 1):
        low, high = int(at[r]), int(at[r + 1])
        for p in range(low, max(low, high - window) + 1, PIECE):
            yield r, p - low, BYTES[body[p : min(high, p + PIECE + window - 1)]]
