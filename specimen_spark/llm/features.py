"""Hashed word and character n-gram features of a text, in numpy without a loop over words."""

from __future__ import annotations

import numpy as np

MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * MIX_A
    x = (x ^ (x >> np.uint64(29))) * MIX_B
    return x ^ (x >> np.uint64(32))


def text_bytes(text: str) -> np.ndarray:
    """UTF-8 bytes with one space before and after and every control character turned into a space."""
    raw = np.frombuffer(b" " + text.encode("utf-8", "replace") + b" ", np.uint8)
    return np.where(raw < 32, np.uint8(32), raw)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word (run of bytes that aren't spaces), in order."""
    inside = raw != 32
    edge = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    values = mix(raw[inside].astype(np.uint64) + (within.astype(np.uint64) << np.uint64(8)) + np.uint64(1))
    return mix(np.add.reduceat(values, np.cumsum(lengths) - lengths))


def ngram_hashes(raw: np.ndarray, lengths: range) -> np.ndarray:
    """A 64-bit hash of every run of n bytes, for each n (8 at most) in `lengths`."""
    out, wide = [], raw.astype(np.uint64)
    for n in lengths:
        if len(raw) >= n:
            packed = np.full(len(raw) - n + 1, n, np.uint64)
            for j in range(n):
                packed = packed * np.uint64(256) + wide[j : len(raw) - n + 1 + j] if n > 7 else packed + (wide[j : len(raw) - n + 1 + j] << np.uint64(8 * j + 4))
            out.append(mix(packed))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
