"""Quality by attention-based multiple-instance learning (Ilse, Tomczak and Welling, 2018).

A document is a bag of passages of ``WORDS`` words. Each passage is encoded by the shape of its text; gated attention,
learned from document labels alone, weighs the encoded passages; a logistic layer scores the weighted sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import short_batches, table
from cutline.llm.shingles import Powers, word_hashes

WORDS = 96
SAMPLE = 6000  # labelled documents the model is fitted on, at most, those of smallest hash
TEXT_SLICE = 1 << 18

_CLASS = np.full(256, 0, dtype=np.int64)  # other bytes of longer code points
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[]_|~"
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[ord(" ")] = 4
_CLASS[[9, 10, 11, 12, 13]] = 5
for _i, _c in enumerate(_SIGNS):
    _CLASS[ord(_c)] = 6 + _i
_CLASSES = 6 + len(_SIGNS)
SIZE = _CLASSES + 7


def passage_features(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and how many passages each text has (one at least).

    Per passage: share of each byte class, length of words and its spread, share of distinct words in the passage and
    in the document, share of words that repeat their predecessor's end, and size.
    """
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    breaks = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    starts, hashes = word_hashes(raw, breaks, powers)
    cuts = np.searchsorted(starts, breaks)
    words = np.diff(cuts)
    bags = np.maximum(1, -(-words // WORDS))
    first = np.concatenate(([0], np.cumsum(bags)))
    total = int(first[-1])
    doc = np.repeat(np.arange(len(texts)), words)  # of each word
    passage = first[doc] + (np.arange(len(starts)) - cuts[doc]) // WORDS
    # where each passage's bytes begin: at the text for the first, else at its first word
    begin = np.empty(total + 1, dtype=np.int64)
    begin[-1] = len(raw)
    begin[first[:-1]] = breaks[:-1]
    inner = np.flatnonzero(np.diff(passage, prepend=-1) != 0)
    inner = inner[(inner - cuts[doc[inner]]) > 0]
    begin[passage[inner]] = starts[inner]
    size = np.diff(begin)
    owner = np.repeat(np.arange(total), size)
    shares = np.bincount(owner * _CLASSES + _CLASS[raw], minlength=total * _CLASSES).reshape(total, _CLASSES)
    out = np.zeros((total, SIZE), dtype=np.float32)
    out[:, :_CLASSES] = np.sqrt(shares / np.maximum(size, 1)[:, None])
    n = np.bincount(passage, minlength=total)
    n1 = np.maximum(n, 1)
    gaps = np.minimum(np.append(starts[1:], len(raw)), breaks[doc + 1])[: len(starts)] - starts
    mean = np.bincount(passage, np.minimum(gaps, 60), total) / n1
    square = np.bincount(passage, np.minimum(gaps, 60) ** 2, total) / n1
    # distinct words, by sorting (passage, word) and (document, word)
    for k, group in enumerate((passage, doc)):
        order = np.lexsort((hashes, group))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(group[order]) != 0) | (hashes[order][1:] != hashes[order][:-1])
        fresh = np.zeros(len(order), dtype=np.float64)
        fresh[order] = new
        out[:, _CLASSES + k] = np.bincount(passage, fresh, total) / n1
    out[:, _CLASSES + 2] = mean / 10
    out[:, _CLASSES + 3] = np.sqrt(np.maximum(square - mean**2, 0)) / 10
    out[:, _CLASSES + 4] = np.log1p(n) / 5
    share = np.bincount(doc, minlength=len(texts)).astype(float)
    kinds = np.zeros(len(texts))
    if len(doc):
        order = np.lexsort((hashes, doc))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(doc[order]) != 0) | (hashes[order][1:] != hashes[order][:-1])
        kinds = np.bincount(doc[order], new, len(texts))
    out[:, _CLASSES + 5] = np.repeat(kinds / np.maximum(share, 1), bags)
    out[:, _CLASSES + 6] = np.repeat(np.log1p(share) / 8, bags)
    return out, bags


class Attention:
    """tanh encoding, gated attention, logistic score; plain arrays, so it travels to the tasks as a broadcast."""

    def __init__(self, size: int, hidden: int = 24, gate: int = 12, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "W": rng.normal(0, 1 / np.sqrt(size), (size, hidden)), "b": np.zeros(hidden),
            "V": rng.normal(0, 1 / np.sqrt(hidden), (hidden, gate)), "U": rng.normal(0, 1 / np.sqrt(hidden), (hidden, gate)),
            "w": rng.normal(0, 1 / np.sqrt(gate), gate), "c": rng.normal(0, 1 / np.sqrt(hidden), hidden), "d": np.zeros(1),
        }
        self.mean, self.scale = np.zeros(size), np.ones(size)

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict:
        p = self.p
        starts = np.concatenate(([0], np.cumsum(bags)[:-1]))
        doc = np.repeat(np.arange(len(bags)), bags)
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[doc])
        a = e / np.add.reduceat(e, starts)[doc]
        m = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["d"], -30, 30)))
        return {"z": z, "h": h, "t": t, "g": g, "a": a, "m": m, "y": y, "doc": doc, "starts": starts}

    def fit(self, x: np.ndarray, bags: np.ndarray, labels: np.ndarray, epochs: int = 400, rate: float = 0.01, decay: float = 1e-4):
        x = x.astype(np.float64)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 0.05
        p, one, two = self.p, {}, {}
        for step in range(1, epochs + 1):
            f = self.forward(x, bags)
            doc = f["doc"]
            dy = (f["y"] - labels) / len(labels)
            dm = dy[:, None] * p["c"]
            da = (dm[doc] * f["h"]).sum(axis=1)
            de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["starts"])[doc])
            dt, dg = de[:, None] * p["w"] * f["g"], de[:, None] * p["w"] * f["t"]
            dt, dg = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
            dh = (f["a"][:, None] * dm[doc] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
            grads = {
                "W": f["z"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
                "w": (f["t"] * f["g"]).T @ de, "c": f["m"].T @ dy, "d": dy.sum(keepdims=True),
            }
            for k, grad in grads.items():
                grad = grad + decay * p[k] * (k not in "bd")
                one[k] = 0.9 * one.get(k, 0) + 0.1 * grad
                two[k] = 0.99 * two.get(k, 0) + 0.01 * grad**2
                p[k] = p[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return self.forward(x.astype(np.float64), bags)["y"]


def feature_batches(texts: list[str], powers: Powers):
    """Passage features of a batch, a slice of about ``TEXT_SLICE`` bytes (or one longer text) at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text.encode("utf-8"))
        size += len(held[-1])
        if size >= TEXT_SLICE:
            yield passage_features(held, powers)
            held, size = [], 0
    if held:
        yield passage_features(held, powers)


def fold(column: str, parts: int) -> F.Column:
    return F.crc32(F.col(column).cast("string")) % parts


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, parts: int = 5, out: int = 0) -> Attention:
    """Fit on at most ``sample`` labelled documents outside fold ``out``.

    Rows without an id or with a label other than 0 and 1 are no labels; of conflicting labels the larger counts.
    Only features of the sample reach the driver. With no label at all the model scores everything alike, at 0.5.
    """
    short_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", parts) != out))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            parts_ = [(x, b) for x, b in feature_batches(batch.column(2).to_pylist(), powers)]
            bags = np.concatenate([b for _, b in parts_])
            x = np.concatenate([x for x, _ in parts_])
            ends = np.cumsum(bags)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[e - n : e].tobytes() for e, n in zip(ends, bags)], pa.binary())],
                names=["doc_id", "label", "x"],
            )

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
        .mapInArrow(run, "doc_id long, label int, x binary").toPandas().sort_values(["doc_id", "x"])
    )
    model = Attention(SIZE)
    if not len(rows):
        model.p["c"][:] = 0
        return model
    x = [np.frombuffer(b, np.float32).reshape(-1, SIZE) for b in rows["x"]]
    return model.fit(np.concatenate(x), np.array([len(b) for b in x]), rows["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Attention) -> DataFrame:
    """``doc_id, score`` of every whole text. NULL and empty texts are one empty passage; repeated rows repeat."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            scores = [sent.value.score(x, b) for x, b in feature_batches(batch.column(1).to_pylist(), powers)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).mapInArrow(run, "doc_id long, score double")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the model does not reject (score of 0.3 or more), with the columns of ``docs``; NULL ids stay."""
    model = train(docs, table(spark, sf_dir, "labels"))
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(text: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([sent.value.score(x, b) for x, b in feature_batches(list(text), Powers())] or [[]]))

    scored = docs.withColumn("_score_", quality(F.coalesce("text", F.lit(""))))
    return scored.where("_score_ >= 0.3 OR doc_id IS NULL").select(*docs.columns)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
