import random
import zlib

import numpy as np
import pyarrow as pa
from llm_words import prose

from ripestream.llm import text as tx
from ripestream.llm import toxicity
from ripestream.llm.queries import QUERIES


def pages(texts):
    return [tx.Page(data, offs, tx.ALNUM, True) for _, _, data, offs in tx.pieces(pa.array(texts, pa.large_string()))]


def convolved(m, x):
    """Largest value of each filter over all windows of ``x``, which ends with pads."""
    last = len(x) - toxicity.PADS + 1
    return np.concatenate([np.max([sum(x[p + j] @ w[j] for j in range(len(w)) if p + j < len(x)) for p in range(last)], axis=0) for w in m.filters])


def test_pooling_matches_plain_convolution():
    rng = np.random.default_rng(0)
    m = toxicity.fit([], np.zeros(0, np.float32), [])
    m.emb = rng.normal(size=m.emb.shape).astype(np.float32)
    m.emb[0] = 0
    texts = ["", "one", "one two", None, "a bb ccc dddd eeeee ffffff ggggggg", prose(1, 50)]
    for page in pages(texts):
        buckets, words = toxicity.word_buckets(page)
        got, _, _ = m.features(buckets, *toxicity.padded(page, words))
        for i in range(page.n):
            x = m.emb[buckets[words[page.first[i] : page.first[i + 1]]]].sum(axis=1)
            x = np.concatenate([x.reshape(-1, toxicity.DIM), np.zeros((toxicity.PADS, toxicity.DIM), np.float32)])
            assert np.allclose(got[:, i], convolved(m, x), atol=1e-4)


def test_scores_of_a_fixed_model(spark):
    rng = np.random.default_rng(2)
    m = toxicity.fit([], np.zeros(0, np.float32), [])
    m.constant, m.emb, m.scale, m.shift = None, rng.normal(0, 0.2, m.emb.shape).astype(np.float32), 0.7, -0.4
    m.bias, m.out = (rng.normal(0, 0.3, len(m.bias)).astype(np.float32) for _ in range(2))
    m.emb[0] = 0
    texts = [None, "", "one", "Ä ß 12 ... x", "ONE one", prose(3, 5000), *[prose(i, 1 + i % 40) for i in range(60)]]
    got = {r.doc_id: r.toxicity for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), m).collect()}
    for i, t in enumerate(texts):
        (page,) = pages([t])
        buckets, words = toxicity.word_buckets(page)
        x = m.emb[buckets[words]].sum(axis=1).reshape(-1, toxicity.DIM)
        raw = m.out @ np.maximum(convolved(m, np.concatenate([x, np.zeros((toxicity.PADS, toxicity.DIM), np.float32)])) + m.bias, 0) + m.out_bias
        assert abs(got[i] - 1 / (1 + np.exp(-(0.7 * raw - 0.4)))) < 1e-4, i


def test_learns_and_calibrates():
    r = random.Random(1)
    bad = ["vile", "nasty"]
    texts, y, langs = [], [], []
    for i in range(800):
        w = prose(i, 40).split()
        toxic = i % 4 == 0
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(bad))
        texts.append(" ".join(w))
        y.append(toxic)
        langs.append(["en", "de"][i % 8 < 4])
    m = toxicity.fit(texts, np.array(y, np.float32), langs)
    fresh = [prose(10_000 + i, 60) + (" vile " if i % 2 else "") for i in range(200)]
    s = np.concatenate([m.score(p) for p in pages(fresh)])
    assert (s[1::2] >= 0.7).mean() > 0.95 and (s[::2] < 0.7).mean() > 0.95
    assert set(m.thresholds) == {"en", "de"}
    again = toxicity.fit(texts, np.array(y, np.float32), langs)
    assert np.array_equal(again.emb, m.emb)


def test_odd_rows(spark, odd_docs, no_docs):
    one_kind = spark.createDataFrame([(1, 0), (2, 0), (None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    m = toxicity.train(odd_docs, one_kind)
    got = toxicity.score(odd_docs, m, out="score").collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    m = toxicity.train(odd_docs, spark.createDataFrame([(i, i % 2) for i in range(1, 15)], "doc_id long, toxic int"))
    scored = toxicity.score(odd_docs, m)
    got = scored.withColumn("flagged", toxicity.flagged(scored, m)).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.toxicity <= 1 for r in got)
    assert toxicity.score(no_docs, m).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op6_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) >= 0.96 * len(held)
    toxic = [r for r in held if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic)
    assert sum(r.predicted for r in held if not r.toxic) <= 0.02 * len(held)


def test_calibration_counts_all_labelled_rows(spark, monkeypatch):
    """With both caps of the sample reached, scores still follow the share of toxic rows, and a rare language has its threshold."""
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 100)
    monkeypatch.setattr(toxicity, "MAX_CLEAN", 200)
    r = random.Random(4)
    rows, marks = [], []
    for i in range(4000):
        word = r.random() < 0.25  # a sign that is wrong more often than right: 0.4 of its rows are toxic
        rows.append((i, prose(i, 20) + (" vile" if word else ""), "de" if i % 8 == 0 else "en"))
        marks.append((i, int(word and r.random() < 0.4)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    scored = toxicity.score(docs, m).collect()
    assert abs(sum(x.toxicity for x in scored) / 4000 - sum(y for _, y in marks) / 4000) < 0.02
    assert set(m.thresholds) == {"de", "en"}
