"""Sets of hashed word shingles, computed with numpy over the bytes of a text."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(1_000_003)
LETTER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


PIECE = 1 << 20  # bytes of a text whose words are hashed at once


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word (run of bytes other than ASCII white space, A-Z lower-cased), in order."""
    raw = np.frombuffer(text, dtype=np.uint8)
    out, at = [], 0
    while len(raw) - at > PIECE:
        space = np.flatnonzero(IS_SPACE[raw[at : at + PIECE]])
        stop = at + int(space[-1]) + 1 if len(space) else at + PIECE
        while not len(space) and stop < len(raw) and not IS_SPACE[raw[stop]]:  # a word longer than a piece stays whole
            more = np.flatnonzero(IS_SPACE[raw[stop : stop + PIECE]])
            stop = stop + int(more[0]) if len(more) else min(len(raw), stop + PIECE)
        out.append(_hash_words(raw[at:stop]))
        at = stop
    out.append(_hash_words(raw[at:]))
    return np.concatenate(out)


def _hash_words(raw: np.ndarray) -> np.ndarray:
    inside = ~IS_SPACE[raw]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    raw, inside, lengths = raw[starts[0] :], inside[starts[0] :], ends - starts
    starts = starts - starts[0]
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    powers = np.full(int(lengths.max()) + 1, BASE)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    place = np.minimum(place, len(powers) - 1)
    terms = LETTER[LOWER[raw]] * powers[place] * inside
    return mix(np.add.reduceat(terms, starts) + lengths.astype(np.uint64))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of a text with fewer words, the whole sequence as one."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    n = min(k, len(words))
    out = np.full(len(words) - n + 1, np.uint64(n))
    for i in range(n):
        out = mix(out * BASE + words[i : len(words) - n + 1 + i])
    return np.unique(out)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets; an empty set is linked with nothing."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
