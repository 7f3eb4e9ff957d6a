"""Packing of token sequences by bin completion over the counts of piece lengths."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import saved, table
from cutline.llm.tokens import encoder, slices
from cutline.plans.pooled import numbered

CAPACITY = 2048
Filling = tuple[int, ...]


def fillings(
    room: int, counts: Counter, lengths: list[int], most: int, nodes: int, spare: int | None = None
) -> tuple[list[Filling], int, bool]:
    """Up to ``most`` undominated ways to fill ``room`` from the lengths left (descending), least waste first.

    A filling is dominated if another piece still fits, or if one of its pieces could give way to a longer one. Long
    pieces are tried first, and one step takes as many of a length as fit and are left, so the first filling found is
    the best-fit one. Without ``spare`` it is always reached, in as many steps as it has different lengths; with it,
    fillings that waste more are passed over, and partial ones that all pieces left could not mend are cut. The search
    ends at ``most`` fillings without waste, or after ``nodes`` steps.
    Returns the fillings, the steps, and whether these are all undominated ones.
    """
    found: dict[tuple[tuple[int, int], ...], int] = {}  # (length, times) of a filling, and its waste
    exact, steps = 0, 0
    rest = [0] * (len(lengths) + 1)  # sum of all pieces from a length on
    if spare is not None:
        for i in range(len(lengths) - 1, -1, -1):
            rest[i] = rest[i + 1] + lengths[i] * counts[lengths[i]]
    stack: list[tuple[int, int, int, tuple[tuple[int, int], ...]]] = [(0, room, room, ())]
    while stack and exact < most and (steps < nodes or (spare is None and not found)):
        i, top, left, chosen = stack.pop()
        steps += 1
        lo, hi = i, len(lengths)
        while lo < hi:  # first length that fits
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if lengths[mid] > left else (lo, mid)
        if spare is not None and left - rest[lo] > spare:
            continue
        if lo == len(lengths):
            found[chosen] = left
            exact += left == 0
            continue
        n = lengths[lo]
        times = min(left // n, counts[n], top if lo == i else room)
        if lo + 1 < len(lengths) or times > 1:  # later: with one less of this length
            stack.append((lo, times - 1, left, chosen) if times > 1 else (lo + 1, room, left, chosen))
        stack.append((lo + 1, room, left - n * times, (*chosen, (n, times))))
    kept = []
    for filling, waste in found.items():
        used = Counter(dict(filling))
        # 0 stands for no piece: it could give way to any that still fits
        longer = any(
            used[n] < counts[n] for piece in (0, *used) for n in range(piece + 1, piece + waste + 1) if n in counts
        )
        if not longer or waste == 0:
            kept.append((waste, filling))
    if not kept and spare is None:
        kept = [(w, f) for f, w in found.items()]
    flat = [(w, sum(k for _, k in f), tuple(n for n, k in f for _ in range(k))) for w, f in kept]
    return [f for _, _, f in sorted(flat)[:most]], steps, not stack and len(flat) <= most


def best_fit(counts: Counter, capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on counts: the first incumbent."""
    counts = Counter({n: c for n, c in counts.items() if c > 0})
    lengths = sorted(counts, reverse=True)
    bins: list[tuple[Filling, int]] = []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        options, _, _ = fillings(capacity - first, counts, lengths if counts[first] else lengths[1:], 1, 64)
        counts[first] += 1
        filling = (first, *(options[0] if options else ()))
        times = _times(counts, filling)
        _take(counts, filling, times)
        lengths = [n for n in lengths if counts[n]]
        bins.append((filling, times))
    return bins


def _times(counts: Counter, filling: Filling) -> int:
    return min(counts[n] // k for n, k in Counter(filling).items())


def _take(counts: Counter, filling: Filling, times: int) -> None:
    for n in filling:
        counts[n] -= times


def _completions(counts: Counter, capacity: int, tried: set[Filling], spare: int, meter: list[int]):
    """Ways to go on: (filling around the largest piece, times), those of least waste and most times first.

    Undominated fillings are enumerated a few at a time, ever more of them as those before fail, until none is left.
    ``tried`` holds the fillings of this largest piece that are done with: all packings that use them once more have
    been searched. Between two results ``counts`` may change, but is put back.
    """
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    first, most, nodes, complete = lengths[0], 4, 500, False
    while not complete:
        counts[first] -= 1
        usable = lengths if counts[first] else lengths[1:]
        options, steps, complete = fillings(capacity - first, counts, usable, most + len(tried), nodes, spare)
        counts[first] += 1
        meter[0] += steps
        for rest in options:
            filling = (first, *rest)
            if filling not in tried:
                tried.add(filling)
                for times in range(_times(counts, filling), 0, -1):
                    yield filling, times
        most, nodes = most * 4, nodes * 4


def _branch(counts: Counter, capacity: int, best: list, bound: int, budget: int) -> tuple[list, bool]:
    """Depth-first branch and bound from the incumbent ``best``: the best packing found, and whether nothing beats it."""
    counts, total = Counter(counts), sum(n * c for n, c in counts.items())
    size = sum(times for _, times in best)
    meter = [0]
    bins: list[tuple[Filling, int]] = []
    waste = 0
    # one entry per open decision: its ways to go on, and the fillings done with
    tried: set[Filling] = set()
    open_: list = [(_completions(counts, capacity, tried, (size - 1) * capacity - total, meter), tried)]
    while open_ and size > bound and meter[0] < budget:
        ways, tried = open_[-1]
        if len(bins) == len(open_):  # back from what followed this decision
            filling, times = bins.pop()
            _take(counts, filling, -times)
            waste -= (capacity - sum(filling)) * times
        way = next(ways, None)
        meter[0] += 1
        if way is None:
            open_.pop()
            continue
        filling, times = way
        more = (capacity - sum(filling)) * times
        # fewer bins than the incumbent leave this much waste in all
        spare = (size - 1) * capacity - total - waste - more
        if spare < 0:
            continue
        bins.append(way)
        waste += more
        _take(counts, filling, times)
        if not any(counts.values()):
            size, best = sum(t for _, t in bins), list(bins)
            continue
        onward = set(tried) if counts[filling[0]] else set()
        open_.append((_completions(counts, capacity, onward, spare, meter), onward))
    return best, size <= bound or not open_


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins needed at least: for the sum of the lengths, and for the pieces of which at most k fit in a bin, for each k."""
    bound = -(-sum(n * c for n, c in counts.items()) // capacity)
    large, at_most = 0, 0
    for n in sorted(counts, reverse=True):
        large, at_most = large + counts[n], max(1, capacity // n)
        bound = max(bound, -(-large // at_most))
    return bound


def pack_proven(
    counts: dict[int, int], capacity: int = CAPACITY, budget: int = 2_000_000
) -> tuple[list[tuple[Filling, int]], bool]:
    """Pack ``counts[length]`` pieces into few bins: (lengths in a bin, number of such bins), and whether that is proven.

    Bin completion: around the largest piece left, try all undominated fillings of the rest of its bin, those that
    waste least first, and each as often as the counts allow, then less often. A branch is cut as soon as its waste
    rules out fewer bins than the incumbent has. Best-fit decreasing gives the first incumbent. The search ends at the
    lower bound, when no branch is left (both proven), or after ``budget`` steps of the search and of the enumeration of
    fillings; then the best packing so far stands. Its cost depends on the different lengths, not on the pieces.
    """
    counts = Counter({int(n): int(c) for n, c in counts.items() if c > 0})
    if not counts:
        return [], True
    best, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    if sum(times for _, times in best) <= bound:
        return best, True
    return _branch(counts, capacity, best, bound, budget)


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY, budget: int = 2_000_000) -> list[tuple[Filling, int]]:
    """The packing of ``pack_proven``."""
    return pack_proven(counts, capacity, budget)[0]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of each whole text, then id 0, cut into pieces of ``capacity``: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                out: list[tuple] = []
                for doc, data in zip(ids[lo:hi], encode(texts[lo:hi])):
                    data += b"\0\0\0\0"
                    for k in range(0, len(data), 4 * capacity):
                        part = data[k : k + 4 * capacity]
                        out.append((doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int32(), *[pa.int64()] * 3])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col(id).cast("long"), F.coalesce(F.col(text), F.lit("")))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Place each piece of each document: the columns of ``pieces`` and ``sequence_id, offset``.

    Full pieces are sequences by themselves. For the others only the counts by length reach the driver, at most
    ``capacity`` numbers for any corpus; pieces of a length are numbered in spans, and their number gives their place.
    A NULL text is empty and has the single id 0; NULL ids and repeated rows are packed as rows of their own.
    """
    cut = saved(pieces(docs, tokenizer_path, capacity, id, text).withColumn("_row", F.monotonically_increasing_id()), "pack")
    short = cut.where(F.col("length") < capacity)
    counts = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    bins = pack_lengths(counts, capacity)
    # by length: first number, first sequence, offset, number of such bins; a bin's pieces of a length lie together
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    base = 0
    for filling, times in bins:
        offset = 0
        for n, k in Counter(filling).items():
            places.setdefault(n, []).append((used[n], base, offset, times))
            used[n] += times * k
            offset += n * k
        base += times
    arrays = {n: np.array(rows, dtype=np.int64) for n, rows in places.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            number = batch.column("_number").to_numpy() - 1
            sequence, offset = np.zeros_like(number), np.zeros_like(number)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                rows = arrays[int(n)]
                k = np.searchsorted(rows[:, 0], number[at], side="right") - 1
                nth, bin_ = np.divmod(number[at] - rows[k, 0], rows[k, 3])
                sequence[at] = rows[k, 1] + bin_
                offset[at] = rows[k, 2] + nth * n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = numbered(short, ["length"], "_row", "_number").select(*columns, "_number").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    full = cut.where(F.col("length") == capacity).select(
        *columns, (F.col("_row") + base).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return placed.union(full)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: where each piece of the remaining documents goes."""
    return pack(docs, default_tokenizer())


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
