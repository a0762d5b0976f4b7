"""Sets of 5-word shingles as sorted 64-bit fingerprints."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

from folioforge.llm.tokens import chunks

WIDTH = 5
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word of the UTF-8 text with A-Z lower-cased."""
    parts = []
    for part in chunks(data):
        words = part.lower().split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def combine(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of the hashes in a row; the order counts."""
    x = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        x = (x ^ c) * _M1
        x ^= x >> np.uint64(29)
        x *= _M2
        x ^= x >> np.uint64(32)
    return x


def shingle_set(text: str | bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles; a text of fewer words is one shingle, one without words has none."""
    w = word_hashes(text.encode() if isinstance(text, str) else text or b"")
    if not len(w):
        return w
    if len(w) < width:
        return combine([w[i : i + 1] for i in range(len(w))])
    return np.unique(combine([w[i : len(w) - width + 1 + i] for i in range(width)]))


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest()
