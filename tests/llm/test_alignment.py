"""Alignment against the libraries and a brute force over byte ranges."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")

from cutline.llm import alignment


@pytest.fixture(scope="module")
def libraries():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


def by_hand(text, libraries):
    """Ids of both sides and the links, by comparing all ends."""
    first, second = libraries
    if not text:
        return [], [], []
    whole = (" " + text).encode()
    signs = alignment.byte_signs()
    a = first.encode(" " + text, add_special_tokens=False)
    b = second.encode(text)

    def piece(i):
        name = second.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if second.is_byte(i) else name.replace("▁", " ").encode()

    bytes_a = [bytes(signs[c] for c in t) for t in a.tokens]
    bytes_b = [piece(i) for i in b]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return [], [], []
    ends_a, ends_b = np.cumsum([len(t) for t in bytes_a]).tolist(), np.cumsum([len(t) for t in bytes_b]).tolist()
    at_b = {e: j for j, e in enumerate(ends_b)}
    links = [(i, at_b[e]) for i, e in enumerate(ends_a) if e in at_b]
    return a.ids, b, links


def expected(rows, libraries):
    found = [(i, by_hand(t, libraries)) for i, t in rows]
    counts = Counter((a[i], b[j]) for _, (a, b, links) in found for i, j in links)
    best = defaultdict(int)
    for (a, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, (a, b, links) in found:
        parts, low = [], (0, 0)
        for i, j in links:
            parts.append(",".join(map(str, a[low[0] : i + 1])) + "|" + ",".join(map(str, b[low[1] : j + 1])))
            low = i + 1, j + 1
        ns = [(counts[a[i], b[j]], best[b[j]]) for i, j in links]
        text = ";".join(parts)
        out.append((
            doc_id, len(a), len(b), len(links), len(links), sum(n == m for n, m in ns), sum(n for n, _ in ns),
            hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return sorted(out, key=repr)


TEXTS = [
    "hello world", "Hello  World\n\n\tand   more ", " leading", "naïve façade — “quoted” 北京 город ß", "tokenization<|endoftext|>of text",
    "▁ itself", "a\x00b", "emoji 👩‍👩‍👧‍👦 and ¼ ٣ Ⅷ", "", None, " ", "\n", "x" * 3000, "é" * 700, "1234567 89.00", "can't won't I'LL",
    "   wide 　 spaces", "<s> </s> <unk> <0x41>", "word " * 2000,
]


def test_matches_brute_force(spark, libraries):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "hello world"), (0, "another text of id 0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS pairs", "1 AS _row")
    got = sorted((tuple(r) for r in alignment.alignment_summary(docs).collect()), key=repr)
    assert got == expected(rows, libraries)


def test_given_documents(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = sorted((tuple(r) for r in alignment.alignment_summary(docs).collect()), key=repr)
    assert got == expected([tuple(r) for r in docs.collect()], libraries)


def test_fast_ids_are_the_librarys(libraries):
    first = alignment.ByteLevel(public.path("byte_bpe_50k.json"))
    assert first.fast is not None
    random.seed(5)
    signs = "abcXYZ  \n\t'sé ß¹½٣—中あア  ​😀<|endoftext|>09_.,"
    texts = ["".join(random.choices(signs, k=random.randint(0, 60))) for _ in range(3000)]
    assert first.encode(texts) == [libraries[0].encode(t, add_special_tokens=False).ids for t in texts]


def test_lockstep_does_not_depend_on_lanes():
    random.seed(1)
    for size in (1, 5, 64, 5000):
        ends_a = np.unique(np.append(np.random.default_rng(size).integers(1, size + 1, size), size))
        ends_b = np.unique(np.append(np.random.default_rng(size + 1).integers(1, size + 1, size // 2), size))
        common = np.intersect1d(ends_a, ends_b)
        for lane in (1, 3, 512, 10**6):
            low = np.arange(0, size, lane)
            a, b = alignment.lockstep(ends_a, ends_b, low, np.minimum(low + lane, size))
            assert (ends_a[a] == common).all() and (ends_b[b] == common).all()


def test_spans_give_the_text_back(spark, libraries):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    out = {r.doc_id: r for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        a, b, links = by_hand(t, libraries)
        r = out[i]
        assert (r.ids_a, r.ids_b) == (a, b)
        assert list(zip(r.stops_a, r.stops_b)) == [(x + 1, y + 1) for x, y in links]
        if links:
            assert r.offsets[-1] == len(" " + t.encode().decode()) + len(t.encode()) - len(t)


def test_pairs_stay_within_their_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    paths = alignment.default_paths()
    counts = alignment.pair_counts(alignment._digested(docs, *paths, "doc_id", "text"))
    a, b = alignment.ByteLevel(paths[0]), alignment.Pieces(paths[1])
    for pair in counts.select("pair").collect():
        x, y = a.bytes[pair.pair >> 32], b.bytes[pair.pair & 0xFFFFFFFF]
        assert x.endswith(y) or y.endswith(x)
    assert alignment.pair_bound(*paths) < 1_000_000


def test_settings_are_put_back_and_nothing_gives_nothing(spark, nothing, awkward):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    assert alignment.alignment_summary(nothing).count() == 0
    assert alignment.alignment_summary(awkward).count() == awkward.count()
    assert spark.conf.get(name) == before
