"""Alignment of two tokenizers over the same bytes, by lockstep merging of all documents of a batch.

Each side gives, per document, where its tokens end in the bytes of space + text. One state vector holds a pointer into
A's ends and one into B's for every lane; a lane is a stretch of ``LANE`` bytes of a document, so that one long text does
not leave the others waiting. At every step each lane whose two tokens end together emits a link and a cut, and moves
both pointers; the others move the pointer whose token ends first. Finished lanes are dropped from the vector.

Pairs linked anywhere are few: two tokens that end together are the same bytes from the end on, the shorter being a
suffix of the longer. A token of n bytes has at most n suffixes, so the pairs number at most the summed lengths of all
tokens of both vocabularies (``pair_bound``), whatever the corpus. Their counts may therefore be broadcast.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import batches_of, broadcast_within, saved, table
from cutline.plans.pooled import lookup

LANE = 512
# code points whose class has not changed for long; texts with others are left to the library that defines the result
_ODD = re.compile("[^\t\n\r -~ -˿Ͱ-ϿЀ-ӿ‐-‧€ぁ-ゖァ-ヺ一-龥]")


def byte_signs() -> dict[str, int]:
    """The printable sign that byte-level tokenizers write for each byte: bytes that do not print follow from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE file. ``encode`` gives the ids of texts as the ``tokenizers`` library does, specials as text.

    Where the file's merges are in the order of their ids and its pattern is the plain byte-level one, the same merges
    run in ``tiktoken``, several times faster; files of other kinds, and texts with rare code points, use the library.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        signs = byte_signs()
        special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        vocab = {t: i for t, i in parts["model"]["vocab"].items() if t not in special}
        self.bytes = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(map(signs.__getitem__, token))
        self.fast = self._fast(parts, vocab)
        self.lengths = np.array([len(t) for t in self.bytes], dtype=np.int64)

    def _fast(self, parts: dict, vocab: dict[str, int]):
        model, before = parts["model"], parts["pre_tokenizer"] or {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = [vocab.get(a + b, -1) for a, b in pairs]
        plain = (
            parts["normalizer"] is None and parts["post_processor"] is None and before.get("type") == "ByteLevel"
            and before.get("use_regex") and not before.get("add_prefix_space")
            and not any(model.get(k) for k in ("dropout", "ignore_merges", "end_of_word_suffix", "continuing_subword_prefix"))
            and merged == sorted(set(merged)) and len(merged) + 256 == len(vocab) and all(t["special"] for t in parts["added_tokens"])
        )
        if not plain:
            return None
        import public_tokenizers
        import tiktoken

        ranks = {self.bytes[i]: i for i in vocab.values()}
        return tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        slow = [i for i, t in enumerate(texts) if self.fast is None or _ODD.search(t)]
        taken = dict(zip(slow, self.library.encode_batch([texts[i] for i in slow], add_special_tokens=False)))
        return [taken[i].ids if i in taken else self.fast.encode_ordinary(t) for i, t in enumerate(texts)]


class Pieces:
    """A sentencepiece model. Its pieces stand for their UTF-8 bytes, U+2581 for a space, ``<0xHH>`` for one byte."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]
        self.lengths = np.array([len(t) for t in self.bytes], dtype=np.int64)

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        if re.fullmatch("<0x[0-9A-Fa-f]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode("utf-8")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_LOADED: dict[tuple[str, str], object] = {}


def _loaded(kind, path: str):
    """A worker keeps its tokenizers; it serves many tasks."""
    if (kind.__name__, path) not in _LOADED:
        _LOADED[kind.__name__, path] = kind(path)
    return _LOADED[kind.__name__, path]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array, and where each document's begin."""
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    out = np.empty(sizes.sum(), dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    for row, lo, hi in zip(ids, starts[:-1], starts[1:]):
        out[lo:hi] = row
    return out, starts


class Side:
    """One tokenizer's tokens of a batch: ids, where documents begin among them, and ends in the batch's bytes."""

    def __init__(self, ids: list[list[int]], tokenizer, whole: list[bytes]) -> None:
        for i, (row, text) in enumerate(zip(ids, whole)):
            if b"".join(map(tokenizer.bytes.__getitem__, row)) != text:
                ids[i] = []
        self.ids, self.starts = _flat(ids)
        self.lengths = tokenizer.lengths


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places (a, b) where tokens end together, in order: a row per link.

    ``ends_a`` and ``ends_b`` rise over the whole batch. A lane looks at ends in (low, high]; it is finished once one
    side has no more ends in it.
    """
    a, b = np.searchsorted(ends_a, low, side="right"), np.searchsorted(ends_b, low, side="right")
    stop = np.iinfo(np.int64).max
    ends_a, ends_b = np.append(ends_a, stop), np.append(ends_b, stop)
    found_a, found_b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    while len(a):
        at_a, at_b = ends_a[a], ends_b[b]
        open_ = np.maximum(at_a, at_b) <= high
        if not open_.all():
            a, b, high, at_a, at_b = a[open_], b[open_], high[open_], at_a[open_], at_b[open_]
        together = at_a == at_b
        found_a.append(a[together])
        found_b.append(b[together])
        a, b = a + (at_a <= at_b), b + (at_b <= at_a)
    links_a, links_b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(links_a, kind="stable")
    return np.stack([links_a[order], links_b[order]])


class Aligned:
    """The alignment of a batch of texts: both sides, and the links of every document in order."""

    def __init__(self, texts: list[str | None], path_a: str, path_b: str) -> None:
        first, second = _loaded(ByteLevel, path_a), _loaded(Pieces, path_b)
        spaced = [" " + t if t else "" for t in texts]
        whole = [t.encode("utf-8") for t in spaced]
        ids_a, ids_b = first.encode(spaced), second.encode([t or "" for t in texts])
        self.a, self.b = Side(ids_a, first, whole), Side(ids_b, second, whole)
        n_a, n_b = np.diff(self.a.starts), np.diff(self.b.starts)
        whole_pair = (n_a > 0) & (n_b > 0)
        if ((n_a > 0) != (n_b > 0)).any():
            keep = [i if k else [] for i, k in zip(ids_a, whole_pair)], [i if k else [] for i, k in zip(ids_b, whole_pair)]
            self.a.ids, self.a.starts = _flat(keep[0])
            self.b.ids, self.b.starts = _flat(keep[1])
        ends_a, ends_b = np.cumsum(self.a.lengths[self.a.ids]), np.cumsum(self.b.lengths[self.b.ids])
        sizes = np.array([len(t) for t in whole], dtype=np.int64) * whole_pair
        self.base = np.concatenate(([0], np.cumsum(sizes)))
        lanes = -(-sizes // LANE)
        of = np.repeat(np.arange(len(sizes)), lanes)
        place = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        low = self.base[of] + place * LANE
        self.link_a, self.link_b = lockstep(ends_a, ends_b, low, np.minimum(low + LANE, self.base[of + 1]))
        self.ends = ends_a[self.link_a]
        self.links = np.searchsorted(self.link_a, self.a.starts)  # where documents begin among the links

    def group_texts(self) -> Iterator[bytes]:
        """Per document ``a1,a2|b1;a3|b2,b3``: decimal ids by group, in order."""
        ends_a, ends_b = self.link_a + 1, self.link_b + 1
        count = np.arange(len(ends_a))
        a, b = np.arange(len(self.a.ids)), np.arange(len(self.b.ids))
        group_a, group_b = np.searchsorted(self.link_a, a), np.searchsorted(self.link_b, b)
        before_b, to_a = np.concatenate(([0], ends_b))[group_a], ends_a[group_b]
        ids = np.empty(len(a) + len(b), dtype=np.int64)
        marks = np.full(len(ids), ord(","), dtype=np.uint8)
        ids[a + before_b], ids[b + to_a] = self.a.ids, self.b.ids
        marks[self.link_a + np.concatenate(([0], ends_b))[count]] = ord("|")
        marks[self.link_b + ends_a] = ord(";")
        digits, used = _decimals(int(ids.max()) + 1 if len(ids) else 1)
        width = digits.shape[1] - 1
        cells = digits[ids]
        cells[np.arange(len(ids)), used[ids]] = marks
        shown = np.arange(width + 1) <= used[ids][:, None]
        text = cells[shown].tobytes()
        ends = np.concatenate(([0], np.cumsum(used[ids] + 1)))[self.a.starts + self.b.starts]
        for lo, hi in zip(ends[:-1], ends[1:]):
            yield text[lo : max(hi - 1, lo)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked id pairs by document as (document, a << 32 | b), with how many links hold them."""
        document = np.repeat(np.arange(len(self.links) - 1), np.diff(self.links))
        pair = self.a.ids[self.link_a] << 32 | self.b.ids[self.link_b]
        order = np.lexsort((pair, document))
        document, pair = document[order], pair[order]
        new = np.ones(len(pair), dtype=bool)
        new[1:] = (pair[1:] != pair[:-1]) | (document[1:] != document[:-1])
        at = np.flatnonzero(new)
        return document[at], pair[at], np.diff(np.append(at, len(pair)))


_DECIMALS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0, 1, 2, ... as rows of bytes with room for a mark, and how many digits each has."""
    width = 1 << (size - 1).bit_length()
    if width not in _DECIMALS:
        shown = np.arange(width).astype(f"S{len(str(width)) + 1}")
        _DECIMALS[width] = (
            shown.view(np.uint8).reshape(width, -1).copy(), np.char.str_len(shown).astype(np.int64),
        )
    return _DECIMALS[width]


def _slices(texts: list[str | None], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with about ``size`` characters each, at least one text."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, ids_a, ids_b, stops_a, stops_b, offsets``.

    Group k holds A's tokens from the previous group's stop to ``stops_a[k]``, likewise B's, and ends before byte
    ``offsets[k]`` of space + text. A text that is NULL, empty, or that either tokenizer does not give back byte by
    byte has no tokens. Texts are read whole, one batch of about a million characters at a time, or one longer text.
    """
    path_a, path_b = path_a or default_paths()[0], path_b or default_paths()[1]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in _slices(texts):
                found = Aligned(texts[lo:hi], path_a, path_b)
                each = np.repeat(np.arange(hi - lo), np.diff(found.links))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        _lists(found.a.ids, found.a.starts, pa.int32()), _lists(found.b.ids, found.b.starts, pa.int32()),
                        _lists(found.link_a + 1 - found.a.starts[each], found.links, pa.int32()),
                        _lists(found.link_b + 1 - found.b.starts[each], found.links, pa.int32()),
                        _lists(found.ends - found.base[each], found.links, pa.int64()),
                    ],
                    ["doc_id", "ids_a", "ids_b", "stops_a", "stops_b", "offsets"],
                )

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, ids_a array<int>, ids_b array<int>, stops_a array<int>, stops_b array<int>, offsets array<long>"
    )


def _digested(docs: DataFrame, path_a: str, path_b: str, id: str, text: str) -> DataFrame:
    """Counts and digest per row of ``docs``, and its distinct linked pairs with their numbers."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in _slices(texts):
                found = Aligned(texts[lo:hi], path_a, path_b)
                n_a, n_b, links = np.diff(found.a.starts), np.diff(found.b.starts), np.diff(found.links)
                hashes = [hashlib.sha256(t).hexdigest() if t else "" for t in found.group_texts()]
                document, pair, times = found.pairs()
                starts = np.searchsorted(document, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo), pa.array(n_a), pa.array(n_b), pa.array(links), pa.array(links),
                        pa.array(hashes, pa.string()), _lists(pair, starts, pa.int64()), _lists(times, starts, pa.int32()),
                    ],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs array<long>, times array<int>",
    )


def pair_bound(path_a: str, path_b: str) -> int:
    """The most id pairs that can ever be linked."""
    return int(ByteLevel(path_a).lengths.sum() + Pieces(path_b).lengths.sum())


def pair_counts(digested: DataFrame) -> DataFrame:
    """``pair, n, best``: how many links of the corpus hold a pair, and if no pair with the same B id has more."""
    counts = (
        digested.selectExpr("inline(arrays_zip(pairs, times)) AS (pair, times)").groupBy("pair").agg(F.sum("times").alias("n"))
    )
    return counts.selectExpr("pair", "n", "n = max(n) OVER (PARTITION BY pair & 4294967295) AS best")


def alignment_summary(
    docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Texts that are NULL, empty or not given back have zeros and ''. Repeated rows and ids, NULL ids included, give a
    row each; links of all rows are counted. Columns other than the two named are ignored. No rows give no rows.
    Texts are encoded once: what the second step needs is written down in between.
    """
    path_a, path_b = path_a or default_paths()[0], path_b or default_paths()[1]
    with batches_of(docs.sparkSession, 1000):
        digested = saved(
            _digested(docs, path_a, path_b, id, text).withColumn("_row", F.monotonically_increasing_id()), "align"
        )
    # at most pair_bound(...) rows, some 10 MB for these files; with far larger vocabularies they are joined by a shuffle
    counts = saved(pair_counts(digested), "align")
    held = digested.selectExpr("_row", "inline(arrays_zip(pairs, times)) AS (pair, times)")
    small = broadcast_within(counts)
    sums = (
        (lookup(held, counts, ["pair"]) if small is counts else held.join(small, "pair"))
        .groupBy("_row")
        .agg(F.expr("sum(CASE WHEN best THEN times ELSE 0 END) AS n_best"), F.expr("sum(times * n) AS count_sum"))
    )
    return digested.drop("pairs", "times").join(sums, "_row", "left").selectExpr(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "coalesce(n_best, 0L) AS n_best",
        "coalesce(count_sum, 0L) AS count_sum", "groups_sha256",
    )


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_summary(table(spark, sf_dir, "documents"))
