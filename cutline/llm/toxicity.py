"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels.

A document is toxic if at least one of its sentences is: ``p = 1 - prod(1 - s)``. A sentence's score is logistic in
the set of its words and of their beginnings, with weights that are not negative. The same scores then show where the
offending sentences are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import saved, table
from cutline.llm.mil_quality import fold
from cutline.llm.shingles import _BYTE_VALUES, _LOWER, Powers, mix

BITS = 20  # words are hashed to so many bits
SAMPLE = 8000  # labelled documents the model is fitted on, at most, those of smallest hash
SEEN = 5  # a word needs so many documents of the sample to get a weight
LIFT = 2  # and a share of toxic documents at least so many times that of clean ones
STEMS = (4, 5, 6, 7, 8)  # beginnings of words, in bytes
OFFENDING = 0.5
TEXT_SLICE = 1 << 18

_ID = (1 << BITS) - 1
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def sentence_words(texts: list[bytes], powers: Powers):
    """Of some texts: word ids and the sentence of each, each sentence's text, start and end in bytes of its text.

    Sentences end after a run of ``.!?`` or line breaks; words are runs of letters, in lower case where ASCII or
    Latin-1 have it. Each word gives an id for itself and one for each of its beginnings in ``STEMS``.
    """
    raw = _LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    raw[1:][(raw[:-1] == 0xC3) & (raw[1:] < 0x9F)] += 0x20
    breaks = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    stop = _STOP[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[1:-1] = stop[:-1] & ~stop[1:]
    cut[breaks[:-1][np.diff(breaks) > 0]] = True
    cut[-1] = False
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(raw)) if len(starts) else starts
    doc = np.searchsorted(breaks, starts, side="right") - 1
    letter = np.zeros(len(raw) + 2, dtype=bool)
    letter[1:-1] = _LETTER[raw]
    new, over = letter[1:] & ~letter[:-1], letter[:-1] & ~letter[1:]
    inner = breaks[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    both = letter[inner] & letter[inner + 1]  # a word may not go on in the next text
    new[inner[both]] = over[inner[both]] = True
    word, end = np.flatnonzero(new), np.flatnonzero(over)
    up, down = powers.get(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[raw] * up[: len(raw)], out=sums[1:])
    sentence = np.searchsorted(starts, word, side="right") - 1
    hashes, owners = [(sums[end] - sums[word]) * down[word]], [sentence]
    for size in STEMS:
        longer = np.flatnonzero(end - word >= size)
        begin = word[longer]
        hashes.append((sums[begin + size] - sums[begin]) * down[begin] + np.uint64(size))
        owners.append(sentence[longer])
    ids = (mix(np.concatenate(hashes)) >> np.uint64(64 - BITS)).astype(np.int64)
    return ids, np.concatenate(owners), doc, starts - breaks[doc], ends - breaks[doc]


class NoisyOr:
    """Weights of words; the intercept makes a sentence without weighty words all but harmless."""

    def __init__(self) -> None:
        self.weights = np.zeros(1 << BITS, dtype=np.float32)
        self.intercept = -7.0

    def sentences(self, ids: np.ndarray, sentence: np.ndarray, count: int) -> np.ndarray:
        total = self.intercept + np.bincount(sentence, self.weights[ids], count)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def fit(self, ids, sentence, doc, labels: np.ndarray, bare=0, epochs: int = 300, rate: float = 0.1, sparse: float = 1e-4):
        """Full-batch Adam on the log-likelihood of document labels; ``sparse`` is the price of weight.

        ``ids`` are words and ``sentence``, ascending, the sentences that hold them; ``doc`` is the document of each
        sentence. ``bare`` counts each document's further sentences, without any word.
        """
        vocabulary, column = np.unique(ids, return_inverse=True)
        heads = np.flatnonzero(np.diff(sentence, prepend=-1))
        filled = sentence[heads]
        row = sentence[np.argsort(column, kind="stable")]
        tails = np.concatenate(([0], np.cumsum(np.bincount(column))[:-1]))
        w = np.zeros(len(vocabulary) + 1)
        w[-1] = -5.0
        one, two = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, epochs + 1):
            total = np.full(len(doc), w[-1])
            total[filled] += np.add.reduceat(w[column], heads)
            s = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            s0 = 1 / (1 + np.exp(-max(w[-1], -30.0)))
            clean = np.bincount(doc, np.log1p(-np.minimum(s, 1 - 1e-9)), len(labels)) + bare * np.log1p(-s0)  # log of 1 - p
            p = -np.expm1(clean)
            # d loss / d logit of a sentence: s for clean documents, -s (1 - p) / p for toxic ones
            pull = np.where(labels == 1, -(1 - p) / np.maximum(p, 1e-6), 1.0) / len(labels)
            ds = s * pull[doc]
            grad = np.append(np.add.reduceat(ds[row], tails), ds.sum() + s0 * (bare * pull).sum())
            grad[:-1] += sparse
            one, two = 0.9 * one + 0.1 * grad, 0.99 * two + 0.01 * grad**2
            w = w - rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
            w[:-1] = np.maximum(w[:-1], 0)
            w[-1] = min(w[-1], -4.0)
        self.weights[vocabulary] = w[:-1]
        self.intercept = float(w[-1])
        return self


def _packed(words: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(words.as_buffer(), np.int64)


def _text_slices(texts: list[str]):
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= TEXT_SLICE or i + 1 == len(texts):
            yield start, [t.encode("utf-8") for t in texts[start : i + 1]]
            start, size = i + 1, 0


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, parts: int = 3, out: int = 1) -> NoisyOr:
    """Fit on at most ``sample`` labelled documents outside fold ``out``.

    Rows without an id or with a label other than 0 and 1 are no labels; of conflicting labels the larger counts.
    Without labels no word has a weight.

    Weights are not negative, so only words that at least ``SEEN`` documents hold, and toxic ones ``LIFT`` times as
    often as clean ones, take part. Their list has at most ``2 ** BITS`` numbers. It and the places of those words in the
    sample reach the driver; sentences without them are only counted.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", parts) != out))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            packed: list[bytes] = []
            for _, held in _text_slices(batch.column(2).to_pylist()):
                ids, sentence, doc, _, _ = sentence_words(held, powers)
                order = np.argsort(sentence, kind="stable")
                ids, sentence = ids[order], sentence[order]
                owner = doc[sentence]
                cuts = np.searchsorted(owner, np.arange(len(held) + 1))
                firsts = np.searchsorted(doc, np.arange(len(held)))
                for d in range(len(held)):
                    own = slice(cuts[d], cuts[d + 1])
                    # a sentence's words form a set
                    packed.append(np.unique((sentence[own] - firsts[d]) << BITS | ids[own]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "label", "words"]
            )

    sampled = saved(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
        .mapInArrow(run, "doc_id long, label int, words binary"),
        "toxic-words",
    )

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.zeros((2, 1 << BITS), dtype=np.int64)
            for label, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen[label, np.unique(_packed(words) & _ID)] += 1
            ids = np.flatnonzero(seen.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(seen[0, ids]), pa.array(seen[1, ids])], names=["id", "clean", "toxic"])

    sides = {r["label"]: r["n"] for r in sampled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    vocabulary = (
        sampled.select("label", "words").mapInArrow(tally, "id long, clean long, toxic long")
        .groupBy("id").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(f"clean + toxic >= {SEEN} AND toxic > 0 AND toxic * {sides.get(0, 0)} >= {LIFT} * clean * {sides.get(1, 0)}")
        .select("id").toPandas()["id"].to_numpy(np.int64)
    )
    model = NoisyOr()
    if not len(vocabulary):
        return model
    wanted = docs.sparkSession.sparkContext.broadcast(np.isin(np.arange(1 << BITS), vocabulary))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bare, kept, held = [], [], []
            for words in batch.column(2):
                both = _packed(words)
                own = both[wanted.value[both & _ID]]
                filled, sentence = np.unique(own >> BITS, return_inverse=True)
                bare.append(len(np.unique(both >> BITS)) - len(filled))
                kept.append((own & _ID).astype(np.int32).tobytes())
                held.append(sentence.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bare, pa.int64()), pa.array(kept, pa.binary()), pa.array(held, pa.binary())],
                names=["doc_id", "label", "bare", "ids", "sentence"],
            )

    rows = (
        sampled.mapInArrow(places, "doc_id long, label int, bare long, ids binary, sentence binary")
        .toPandas().sort_values(["doc_id", "ids", "sentence", "bare"])
    )
    held = [np.frombuffer(b, np.int32) for b in rows["sentence"]]
    counts = np.array([int(h[-1]) + 1 if len(h) else 0 for h in held])
    first = np.cumsum(counts) - counts
    sentence = np.concatenate([h + f for h, f in zip(held, first)]).astype(np.int64)
    ids = np.concatenate([np.frombuffer(b, np.int32) for b in rows["ids"]])
    labels_, bare = rows["label"].to_numpy(), rows["bare"].to_numpy()
    del rows, held
    return model.fit(ids, sentence, np.repeat(np.arange(len(counts)), counts), labels_, bare)


def score(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """``doc_id, score, offending``: the noisy-or of all sentences, and the sentences scored ``OFFENDING`` or more.

    ``offending`` lists (start, end, score) in bytes of the UTF-8 text. A NULL or empty text has no sentence, so its
    score is 0. Repeated rows repeat. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            scores, spans = [], []
            for _, held in _text_slices(batch.column(1).to_pylist()):
                ids, sentence, doc, start, end = sentence_words(held, powers)
                heavy = sent.value.weights[ids] > 0
                pair = np.unique(sentence[heavy] << BITS | ids[heavy])
                s = sent.value.sentences(pair & _ID, pair >> BITS, len(doc))
                s = np.where(np.bincount(sentence, minlength=len(doc)) > 0, s, 0.0)  # sentences without words
                scores.append(-np.expm1(np.bincount(doc, np.log1p(-np.minimum(s, 1 - 1e-12)), len(held))))
                own: list[list] = [[] for _ in held]
                for i in np.flatnonzero(s >= OFFENDING):
                    own[doc[i]].append({"start": int(start[i]), "end": int(end[i]), "score": float(s[i])})
                spans += own
            values = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.clip(values, 0, 1)), pa.array(spans, kind)], names=["doc_id", "score", "offending"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("offending").alias("offending_sentences"), F.expr("get(offending, 0).start").alias("first_offending"),
    )
