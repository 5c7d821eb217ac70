"""Sets of hashed word shingles, many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_MASK = 0xFFFFFFFFFFFFFFFF


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS = np.ones(64, np.uint64)
for _i in range(1, 64):
    _POWERS[_i] = (int(_POWERS[_i - 1]) * _BASE) & _MASK


def _powers(n: int) -> np.ndarray:
    """The first n powers of the base; kept for words of up to 4096 bytes."""
    global _POWERS
    have = _POWERS
    while len(have) < n:
        step = np.uint64((int(have[-1]) * _BASE) & _MASK)
        have = np.concatenate([have, have * step])
        if len(have) <= 4096:
            _POWERS = have
    return have


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lowered), and where each text's words begin, with the end of the last."""
    flat = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = (flat == 32) | ((flat >= 9) & (flat <= 13))
    byte = np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint64)
    byte += np.uint64(1)
    byte[space] = 0
    before = np.concatenate(([True], space[:-1]))
    start = np.flatnonzero(~space & before)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    bounds = np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes))))
    if not len(start):
        return np.zeros(0, np.uint64), bounds
    within = np.arange(len(flat)) - start[np.cumsum(~space & before).clip(1) - 1]
    longest = int(within[~space].max()) + 1
    value = np.add.reduceat(byte * _powers(longest)[np.minimum(within, longest - 1).clip(0)], start)
    return mix(value), bounds


def shingle_sets(texts: list[str], k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle, none if it has no words."""
    weights = [np.uint64((0xD1B54A32D192ED03 * (2 * i + 1) * (i + 7)) & _MASK) | np.uint64(1) for i in range(k)]
    at = 0
    while at < len(texts):
        raw, size = [], 0
        while at < len(texts) and (not raw or size < _CHUNK):
            raw.append(texts[at].encode())
            size += len(raw[-1])
            at += 1
        words, bounds = word_hashes(raw)
        n = max(0, len(words) - k + 1)
        every = np.zeros(n, np.uint64)
        for i in range(k):
            every += words[i : i + n] * weights[i]
        every = mix(every)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= k:
                x = np.sort(every[a : b - k + 1])
                yield x[np.concatenate(([True], x[1:] != x[:-1]))]
            elif b > a:
                few = np.add.reduce(words[a:b] * np.array(weights[: b - a]), keepdims=True)
                yield mix(few + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
