"""Hashes of the words of many texts at once, with numpy over the bytes of a whole batch."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_BYTE[_SPACES] = 0  # separators add nothing to the word before them
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWER = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64))
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text.

    Words are runs of anything but ASCII white space, with A-Z lower-cased.
    """
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    if not coded:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = _LOWER[np.frombuffer(b" " + b" ".join(coded) + b" ", np.uint8)]
    space = _SPACES[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    bounds = np.cumsum([0] + [len(c) + 1 for c in coded]) + 1
    counts = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    place = np.arange(len(data)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(data)]))))
    # Places beyond 2**16 bytes of a word reuse the powers in blocks; there the block number is mixed in so that moved
    # bytes still show. All else is as it would be without them: a word's hash depends on that word alone.
    value = _BYTE[data] * _POWER[place & 0xFFFF]
    far = np.flatnonzero((place > 0xFFFF) & ~space)
    value[far] = mixed(value[far] + (place[far] >> 16).astype(np.uint64))
    return mixed(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64)), counts


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words; one fewer than that many, and the result is empty."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    out = words[:n].copy()
    for k in range(1, size):
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + words[k : n + k])
    return out


def chunks(texts: list[str], chars: int = 1 << 20):
    """Ranges of texts of about ``chars`` characters together, so that work arrays stay small."""
    at, held = 0, 0
    for n, text in enumerate(texts):
        held += len(text)
        if held >= chars:
            yield at, n + 1
            at, held = n + 1, 0
    if at < len(texts):
        yield at, len(texts)
