"""Word shingles of whole texts as 64-bit hashes (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20         # bytes hashed at a time
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) | np.uint64(1)
_SLOT = _rng.integers(1, 2 ** 63, 64, dtype=np.uint64) | np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = _inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n (at least)."""
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 2 * CHUNK)
        one = [np.uint64(1)]
        _powers = np.concatenate([one, np.cumprod(np.full(n, _BASE, np.uint64))])
        _inverse = np.concatenate([one, np.cumprod(np.full(n, pow(_BASE, -1, 2 ** 64), np.uint64))])
    return _powers, _inverse


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of ``raw`` (A-Z lower-cased)."""
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    word = ~_SPACE[b]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p, back = powers(len(b) + 1)
    cum = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[b] * p[:len(b)])])
    h = (cum[e] - cum[s]) * back[s]         # the same wherever the word stands
    return s, mix64(h + (e - s).astype(np.uint64))


def words_of(texts: list[bytes]) -> list[np.ndarray]:
    """Word hashes of every text; long texts are cut at blanks, so that memory
    follows CHUNK rather than the longest text."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
            size += len(texts[j]) + 1
            j += 1
        if size <= 2 * CHUNK or j > i + 1:
            off = np.cumsum([0] + [len(t) + 1 for t in texts[i:j]])
            s, h = _word_hashes(b" ".join(texts[i:j]))
            out += np.split(h, np.searchsorted(s, off[1:-1]))
        else:
            t, parts, a = texts[i], [], 0
            while a < len(t):
                z = a + CHUNK
                while z < len(t) and not _SPACE[t[z]]:
                    z += 1
                parts.append(_word_hashes(t[a:z])[1])
                a = z
            out.append(np.concatenate(parts))
        i = j
    return out


def shingles_of(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of ``size`` words; with fewer words the whole
    sequence is one shingle; without words there is none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    w = min(n, size)
    s = np.zeros(n - w + 1, np.uint64)
    for k in range(w):
        s += words[k:n - w + 1 + k] * _SLOT[k]
    return np.unique(mix64(s + np.uint64(w)))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 4 * CHUNK):
    """``(first row, texts)`` of the batch in slices of about ``limit`` bytes."""
    text = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    i = 0
    while i < batch.num_rows:
        j, size, part = i, 0, []
        while j < batch.num_rows and (j == i or size < limit):
            t = text[j].as_py() or b""
            size += len(t)
            part.append(t)
            j += 1
        yield i, part
        i = j
