"""Vectorised hashing of words: whole batches of texts as one byte array.

A word is a run of bytes that are ASCII digits, letters or beyond ASCII, after
``str.lower``. Its hash is polynomial over its bytes modulo 2**64, computed for
all words at once from prefix sums, then mixed. Deterministic across workers.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            _powers = _powers_of(_BASE, size)
            _inverses = _powers_of(_INVERSE, size)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def words_of(text: str | None, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hashes of a text's words in order, then one array per prefix length:
    hashes of the first ``p`` bytes of the words longer than ``p`` bytes."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _WORD[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return tuple(np.empty(0, np.uint64) for _ in range(1 + len(prefixes)))
    _grow(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers[: len(raw)], out=sums[1:])

        def spans(s, e, salt):
            return mix((sums[e] - sums[s]) * _inverses[s] + np.uint64(salt))

        out = [spans(starts, ends, 0)]
        for p in prefixes:
            longer = (ends - starts) > p
            out.append(spans(starts[longer], starts[longer] + p, p * 0x1000193))
    return tuple(out)
