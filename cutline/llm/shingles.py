"""Word shingles of whole texts as sorted arrays of 64-bit hashes.

Works on the bytes of a text, in numpy, so that a text costs a few passes over its bytes and no Python object per
word. Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` after A-Z is lowered; bytes of longer code points
are never white space, so words of bytes and words of characters are the same.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_EMPTY = np.empty(0, dtype=np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a bijection, so unequal values stay unequal)."""
    values = values ^ (values >> np.uint64(32))
    values = values * _STEP
    values = values ^ (values >> np.uint64(32))
    values = values * _STEP
    return values ^ (values >> np.uint64(32))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


class Powers:
    """Powers of the hash base and of its inverse, grown to the longest text seen so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(2 * size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:size], self.down[:size]


def word_hashes(raw: np.ndarray, breaks: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of lowered bytes; no word crosses a break.

    A hash is a polynomial over the word's bytes, by differences of one running sum.
    """
    inside = np.zeros(len(raw) + 1, dtype=bool)
    inside[:-1] = ~_SPACE[raw]
    before = np.zeros(len(raw) + 1, dtype=bool)
    before[1:] = inside[:-1]
    before[breaks] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return starts, _EMPTY
    after = np.zeros(len(raw) + 1, dtype=bool)
    after[:-1] = inside[1:]
    after[breaks[breaks > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = powers.get(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[raw] * up[: len(raw)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of all runs of ``width`` words, sorted; of the whole sequence if it is shorter."""
    if not len(words):
        return _EMPTY
    width = min(width, len(words))
    runs = words[: len(words) - width + 1].copy()
    for i in range(1, width):
        runs *= _BASE
        runs += words[i : i + len(runs)]
    runs = mix(runs + np.uint64(width))
    runs.sort()
    return runs[np.concatenate(([True], runs[1:] != runs[:-1]))]


def batch_shingles(texts: list[str | None], width: int, powers: Powers, size: int = 1 << 18):
    """The shingle set of each text, in order. About ``size`` bytes are hashed at once, or one longer text."""
    held: list[bytes] = []
    total = 0
    for text in texts:
        held.append((text or "").encode("utf-8"))
        total += len(held[-1])
        if total >= size:
            yield from _shingles_of(held, width, powers)
            held, total = [], 0
    yield from _shingles_of(held, width, powers)


def _shingles_of(texts: list[bytes], width: int, powers: Powers):
    if not texts:
        return
    raw = _LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    ends = np.cumsum([len(t) for t in texts])
    breaks = np.concatenate(([0], ends))
    starts, hashes = word_hashes(raw, breaks, powers)
    cuts = np.searchsorted(starts, breaks)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield shingle_set(hashes[lo:hi], width)


def text_shingles(text: str | None, width: int, powers: Powers) -> np.ndarray:
    return next(batch_shingles([text], width, powers))
