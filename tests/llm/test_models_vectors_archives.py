"""Classifiers by held-out accuracy, vector search against brute force, archives by round trip."""

import base64
import hashlib
import math
import os
import random

import numpy as np
import pytest

from cutline.llm import mil_quality, toxicity, vp_search, warc

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def accuracy(found, labels, label):
    seen = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    return sum(p == y for p, y in seen) / len(seen), len(seen)


@pytest.mark.parametrize("query, label, least", [(mil_quality.op6_quality_classifier, "quality", 0.93), (toxicity.op10_toxicity, "toxic", 0.85)])
def test_held_out_accuracy(spark, query, label, least):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = query(spark, SF).collect()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 for r in found)
    share, n = accuracy(found, labels, label)
    assert share >= least, (share, n)


def test_passages_cover_whole_texts():
    texts = [b"", b"one", b"w " * 1000, " é".encode() * 97]
    x, bags = mil_quality.passage_features(texts, mil_quality.Powers())
    assert bags.tolist() == [1, 1, 11, 2] and len(x) == 15 and np.isfinite(x).all()
    alone = np.concatenate([mil_quality.passage_features([t], mil_quality.Powers())[0] for t in texts])
    assert np.allclose(x, alone)


def test_attention_gradient_descends():
    rng = np.random.default_rng(0)
    bags = rng.integers(1, 6, 200)
    x = rng.normal(size=(bags.sum(), mil_quality.SIZE)).astype(np.float32)
    doc = np.repeat(np.arange(200), bags)
    y = (np.bincount(doc, x[:, 3] > 1.2, 200) > 0).astype(float)  # one passage decides
    model = mil_quality.Attention(mil_quality.SIZE).fit(x, bags, y)
    assert ((model.score(x, bags) > 0.5) == y).mean() > 0.95


def test_offending_sentences_are_located():
    powers, rng = toxicity.Powers(), random.Random(1)
    texts, labels = [], []
    for i in range(300):
        body = [" ".join(rng.choice(["calm", "tree", "river", "stone"]) for _ in range(6)) for _ in range(4)]
        labels.append(i % 4 == 0)
        if labels[-1]:
            body[2] += " vile"
        texts.append((". ".join(body) + ".").encode())
    ids, sentence, doc, start, end = toxicity.sentence_words(texts, powers)
    order = np.argsort(sentence, kind="stable")
    model = toxicity.NoisyOr().fit(ids[order], sentence[order], doc, np.array(labels).astype(int))
    score = model.sentences(ids, sentence, len(doc))
    bad = score >= toxicity.OFFENDING
    assert [b"vile" in texts[doc[i]][start[i] : end[i]] for i in range(len(doc))] == bad.tolist()


def test_awkward_documents_are_scored(spark, awkward, nothing):
    model = toxicity.NoisyOr()
    found = toxicity.score(awkward, model).collect()
    assert len(found) == 10 and all(r["score"] == 0 for r in found if r["doc_id"] in (3, 4, 9))
    assert toxicity.score(nothing, model).count() == 0
    quality = mil_quality.Attention(mil_quality.SIZE)
    assert mil_quality.score(awkward, quality).count() == 10
    assert mil_quality.score(nothing, quality).count() == 0
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    assert mil_quality.train(awkward, labels).score(*mil_quality.passage_features([b"x"], toxicity.Powers()))[0] == 0.5
    assert not toxicity.train(awkward, labels).weights.any()


def test_the_quality_stage_drops_what_the_query_rejects(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = mil_quality.stage(spark, docs, SF)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in mil_quality.op6_quality_classifier(spark, SF).collect() if r["predicted"] == 1}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == want and 0 < len(want) < docs.count()


def brute(rows, k=5):
    good = {i: np.array(v, float) for i, v in rows.items() if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i in good:
        if i % 50 == 0:
            scores = [(-float(good[i] @ v / np.linalg.norm(good[i]) / np.linalg.norm(v)), j) for j, v in good.items() if j != i]
            out[i] = sorted((round(s, 9), j) for s, j in scores)[:k]
    return out


@pytest.mark.parametrize("shard, leaf", [(8192, 128), (97, 8)])
def test_nearest_is_exact_with_ties_and_bad_vectors(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(vp_search, "LEAF", leaf)
    rng = np.random.default_rng(4)
    rows = {i: rng.normal(size=6).astype(np.float32).tolist() for i in range(600)}
    for i in range(200, 420):
        rows[i] = [1.0, 2.0, 3.0, 0.0, 0.0, 1.0]  # a hot vector
    rows |= {600: None, 650: [0.0] * 6, 601: [1.0, None, 0.0, 0.0, 0.0, 0.0], 602: [float("nan")] * 6, 603: [float("inf")] + [0.0] * 5}
    frame = spark.createDataFrame([*rows.items(), (None, [1.0] * 6)], "vec_id long, embedding array<float>")
    found = {}
    for r in vp_search.nearest(frame, "vec_id % 50 = 0", shard=shard).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((round(-r["score"], 9), r["vec_id"]))
    assert found == brute(rows)
    assert vp_search.nearest(frame.limit(0), "vec_id % 50 = 0").count() == 0


def test_a_relaxed_factor_still_finds_most(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    exact = vp_search.nearest(frame, "vec_id % 50 = 0").select("query_id", "vec_id")
    relaxed = vp_search.nearest(frame, "vec_id % 50 = 0", factor=1.2).select("query_id", "vec_id")
    assert exact.intersect(relaxed).count() >= 0.9 * exact.count()


def test_loser_tree_merges_runs():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        assert list(warc.loser_tree(runs)) == sorted(x for r in runs for x in r)


def test_archives_give_back_every_page(spark):
    pages = [(i, f"https://www.h{i % 3}.example.org/p?q={i} x#f", f"<p>{i % 7} WARC/1.1\r\n\r\né</p>") for i in range(60)]
    pages += [(60, None, None), (61, "http://a.example", ""), (None, "http://b.example/x", "<p>own</p>"), (7, "http://again.example", pages[7][2])]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, archive string")
    found = warc.roundtrip(frame).collect()
    assert len(found) == len(pages)
    best = {}
    for i, _, html in pages:
        if i is not None:
            best[html or ""] = max(best.get(html or "", -1), i)
    for r in found:
        if r["page_id"] is None:
            assert r["record_type"] == "response"
            continue
        body = dict((i, h or "") for i, _, h in pages)[r["page_id"]].encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        keep = best[body.decode()]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if keep == r["page_id"] else ("revisit", keep))
    ordered = [(r["url_key"], r["captured"]) for r in sorted(found, key=lambda r: (r["range_no"], r["position"]))]
    assert ordered == sorted(ordered)
    assert warc.roundtrip(frame.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.roundtrip(frame, least=1000).collect()} == {"response"}
