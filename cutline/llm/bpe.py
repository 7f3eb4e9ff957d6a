"""BPE encoding by reuse of content-defined chunks, and decoding.

A text is cut where a hash of the last bytes has a certain form, so a passage that many documents hold is cut alike
wherever it stands. Each worker encodes a chunk once and keeps its ids in a dictionary of bounded size. A cut may fall
inside a word: every join is repaired by encoding the words around it anew, more of them until the ids on both sides
agree with those of the chunks.

Chunks are shared by the documents a worker sees, not through a table of all chunks: ids and texts of a corpus, sent to
where they are needed, would cost more than encoding them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import table
from cutline.llm.packing import default_tokenizer
from cutline.llm.tokens import encoder, slices

WINDOW = 8
MASK = np.uint64((1 << 11) - 1)  # a cut every 2,048 bytes on average
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_HEAD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+")


def chunks(data: bytes) -> list[bytes]:
    """Cut UTF-8 bytes where the hash of a window of ``WINDOW`` bytes ends in zeros, never inside a code point."""
    if len(data) <= WINDOW:
        return [data] if data else []
    raw = np.frombuffer(data, dtype=np.uint8)
    rolled = np.zeros(len(raw) - WINDOW + 1, dtype=np.uint64)
    for k in range(WINDOW):
        rolled |= raw[k : k + len(rolled)].astype(np.uint64) << np.uint64(8 * k)
    cuts = np.flatnonzero((rolled * _FACTOR) >> np.uint64(32) & MASK == 0) + WINDOW
    out, start = [], 0
    for cut in cuts.tolist():
        while cut < len(data) and data[cut] & 0xC0 == 0x80:
            cut += 1
        if start < cut < len(data):
            out.append(data[start:cut])
            start = cut
    return [*out, data[start:]]


def _tail(data: bytes, words: int) -> bytes:
    """The last part of a chunk that starts with a word: the word under way for 1, one more for each further."""
    at = len(data)
    for _ in range(words):
        at = max(data.rfind(s, 0, max(at - 1, 0)) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1
        if at == 0:
            break
    return data[at:]


def _head(data: bytes, words: int) -> bytes:
    end = 0
    for _ in range(words):
        found = _HEAD.match(data, end)
        if not found:
            break
        end = found.end()
    return data[:end]


def join_chunks(parts: list[tuple[bytes, bytes]], encode: Callable[[list[str]], list[bytes]]) -> bytes:
    """Ids of a whole text from its chunks and their ids."""
    if not parts:
        return b""
    done = []
    text, ids = parts[0]
    for after, after_ids in parts[1:]:
        words = 1
        while True:
            a, b = _tail(text, words), _head(after, words)
            ia, ib, both = encode([a.decode(), b.decode(), (a + b).decode()])
            if ids.endswith(ia) and after_ids.startswith(ib) or (a, b) == (text, after):
                break
            words *= 2
        done.append(ids[: len(ids) - len(ia)])
        if b == after:  # the word may go on in the next chunk
            text, ids = a + b, both
        else:
            done.append(both)
            text, ids = after[len(b) :], after_ids[len(ib) :]
    return b"".join([*done, ids])


class ChunkEncoder:
    """Ids of texts through chunks; ``limit`` bounds the bytes of chunks and ids that are kept."""

    def __init__(self, path: str, limit: int = 48 << 20) -> None:
        self.words = encoder(path)
        self.kept: dict[bytes, bytes] = {}
        self.room = limit

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [chunks(t.encode("utf-8")) for t in texts]
        fresh = list({c for parts in cut for c in parts if c not in self.kept})
        found = dict(zip(fresh, self.words.encode([c.decode("utf-8") for c in fresh])))
        # the words at all joins of the batch at once; join_chunks asks anew where one word is not enough
        near = {w for parts in cut for a, b in zip(parts, parts[1:]) for x, y in [(_tail(a, 1), _head(b, 1))] for w in (x, y, x + y)}
        words = [w.decode("utf-8") for w in near]
        memo = dict(zip(words, self.words.encode(words)))

        def encode(texts: list[str]) -> list[bytes]:
            return [memo[t] if t in memo else self.words.encode([t])[0] for t in texts]

        ids = [
            join_chunks([(c, self.kept[c] if c in self.kept else found[c]) for c in parts], encode) for parts in cut
        ]
        for chunk, own in found.items():
            self.room -= len(chunk) + len(own) + 200
            if self.room < 0:
                self.kept.clear()
                self.room = 48 << 20
            self.kept[chunk] = own
        return ids


_CHUNKERS: dict[str, ChunkEncoder] = {}


def encode_decode(docs: DataFrame, tokenizer_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), and the digests of ids and of the decoded text.

    NULL counts as empty; an empty text has no ids and decodes to an empty text. Rows stay as they are, repeated or
    with a NULL id. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _CHUNKERS:
            _CHUNKERS[tokenizer_path] = ChunkEncoder(tokenizer_path)
        chunker = _CHUNKERS[tokenizer_path]
        size = chunker.words.tokenizer.get_vocab_size()
        digits = [str(i) for i in range(size)]
        # the file names no decoder, so the library joins the tokens by one space
        tokens = [chunker.words.tokenizer.id_to_token(i) for i in range(size)]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                coded = chunker.encode(texts[lo:hi])
                shas, plain, counts = [], [], []
                for data in coded:
                    numbers = np.frombuffer(data, dtype="<u4").tolist()
                    counts.append(len(numbers))
                    shas.append(hashlib.sha256(" ".join(map(digits.__getitem__, numbers)).encode()).hexdigest())
                    decoded = " ".join(map(tokens.__getitem__, numbers))
                    plain.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi], pa.int64()), pa.array(counts, pa.int64()), pa.array(shas), pa.array(plain),
                     pa.array(coded, pa.binary())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
                )

    return docs.select(F.col(id).cast("long"), F.coalesce(F.col(text), F.lit(""))).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), default_tokenizer()).drop("ids")
