"""Token ids of a word-level BPE, word by word, exactly as the ``tokenizers`` library gives them.

The tokenizer's first steps look at one code point (case, composition) or split at white space, so a text's ids are
those of its words in a row. Words repeat far more than texts do: each worker keeps the ids of words, and of the letter
runs and symbol runs inside them, in two dictionaries of bounded size. New runs of Latin letters or symbols are merged together in
numpy; words of other characters, and special tokens, are left to the library. The bounds change only the time taken.
"""

from __future__ import annotations

import json
import re

import numpy as np

# words without these split into runs by the pattern below; the others are left to the library
_ODD = re.compile("[^!-~À-ÖØ-öø-ÿ\n]|<[|]")
# fixed values: the splitting pattern of the tokenizer file, for the characters above in lower case
_RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-zß-öø-ÿ0-9\n]+")
_BREAK = b"\xff" * 4  # stands for the end of a word; no id has these bytes


def load(path: str):
    """The tokenizer at ``path`` without truncation and padding, single-threaded: Spark's tasks fill the cores."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def as_bytes(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


_NONE = np.int32(2**31 - 1)


class Merges:
    """The merge table of a byte-level BPE file, applied to many short runs at once."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        # bytes that do not print are written as the code points from 256 on
        prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        signs = {b: chr(b) for b in prints}
        signs |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in signs)}
        self.inner = np.array([vocab[signs[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab[signs[b] + end] for b in range(256)], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.mask = (1 << 20) - 1
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.uint64)
        self.keys = np.full(self.mask + 1, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.ranks = np.full(self.mask + 1, _NONE, dtype=np.int32)
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # those that find their place taken go on to the next
            free = self.keys[slots] == np.iinfo(np.uint64).max
            _, first = np.unique(slots[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[slots[placed]] = keys[left[placed]]
            self.ranks[slots[placed]] = left[placed]
            rest = np.setdiff1d(np.arange(len(left)), placed)
            left, slots = left[rest], (slots[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; pairs that never merge, or with a negative id, get the largest number."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slots = self._slot(keys)
        ranks = self.ranks[slots]
        held = self.keys[slots]
        open_ = np.flatnonzero((held != keys) & (ranks != _NONE))
        ranks[held != keys] = _NONE
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            held, found = self.keys[slots[open_]], self.ranks[slots[open_]]
            hit = held == keys[open_]
            ranks[open_[hit]] = found[hit]
            open_ = open_[~hit & (found != _NONE)]
        return ranks

    def encode(self, runs: list[bytes]) -> list[bytes]:
        """Ids of each run: the pair of least rank, leftmost among equals, merges until none is left."""
        out: list[bytes] = [b""] * len(runs)
        sizes = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            data = np.frombuffer(b"".join([runs[i] for i in rows]), dtype=np.uint8).reshape(len(rows), size)
            ids = self.inner[data]
            ids[:, -1] = self.last[data[:, -1]]
            ids = np.concatenate([ids, np.full((len(rows), 1), -1, dtype=np.int32)], axis=1)
            ranks = np.full(ids.shape, _NONE, dtype=np.int32)
            if size > 1:
                ranks[:, : size - 1] = self.rank(ids[:, : size - 1].ravel(), ids[:, 1:size].ravel()).reshape(-1, size - 1)
            while len(rows):
                at = ranks.argmin(axis=1)
                every = np.arange(len(rows))
                best = ranks[every, at]
                done = best == _NONE
                if done.any():
                    width = (ids[done] >= 0).sum(axis=1)
                    for i, row, n in zip(rows[done], ids[done].astype("<u4"), width):
                        out[i] = row[:n].tobytes()
                    keep = ~done
                    rows, ids, ranks, at, best = rows[keep], ids[keep], ranks[keep], at[keep], best[keep]
                    every = every[: len(rows)]
                    if not len(rows):
                        break
                ids[every, at] = self.merged[best]
                columns = np.arange(ids.shape[1] - 1)
                after = columns > at[:, None]
                ids = np.concatenate([np.where(after, ids[:, 1:], ids[:, :-1]), ids[:, -1:]], axis=1)[:, :-1]
                ids[:, -1] = -1
                ranks = np.where(after, ranks[:, 1:], ranks[:, :-1])
                ranks[every, at] = self._next(ids, every, at)
                before = np.flatnonzero(at > 0)
                ranks[before, at[before] - 1] = self._next(ids, before, at[before] - 1)
        return out

    def _next(self, ids: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        right = ids[rows, np.minimum(at + 1, ids.shape[1] - 1)]
        ranks = self.rank(ids[rows, at], np.maximum(right, 0))
        ranks[right < 0] = _NONE
        return ranks


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, words: int = 150_000, runs: int = 200_000) -> None:
        self.tokenizer = load(path)
        self.word_limit, self.run_limit = words, runs
        self.words: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {"\n": _BREAK}
        self.merges = Merges(path)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [as_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs_of(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not kept yet. All words go through each step together, a line each."""
        text = b"\n".join(words).decode("utf-8")
        found = {}
        if _ODD.search(text):
            odd = [w for w in words if _ODD.search(w.decode("utf-8"))]
            found = dict(zip(odd, self._library([w.decode("utf-8") for w in odd])))
            words = [w for w in words if w not in found]
            text = b"\n".join(words).decode("utf-8")
        if not words:
            return found
        runs = _RUNS.findall(text.lower())
        fresh = list(set(runs).difference(self.runs))
        extra = dict(zip(fresh, self.merges.encode([r.encode("utf-8") for r in fresh])))
        room = self.run_limit - len(self.runs)
        self.runs.update(extra if room >= len(extra) else list(extra.items())[:room])
        known = self.runs
        ids = map(known.__getitem__, runs) if room >= len(extra) else [known[r] if r in known else extra[r] for r in runs]
        found.update(zip(words, b"".join(ids).split(_BREAK)))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; call with a batch of texts, as new words are encoded together."""
        split = [t.encode("utf-8").split() for t in texts]  # at [\x20\x09-\x0D]
        words = self.words
        missing = set().union(*split).difference(words)
        if missing:
            found = self._runs_of(list(missing))
            room = self.word_limit - len(words)
            if room >= len(found):
                words.update(found)
            else:
                if room > 0:
                    words.update(list(found.items())[:room])
                return [b"".join([words[w] if w in words else found[w] for w in s]) for s in split]
        return [b"".join(map(words.__getitem__, s)) for s in split]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file; workers serve many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def slices(texts: list[str], size: int = 4 << 20):
    """Ranges of a batch that hold about ``size`` characters each, at least one text."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
