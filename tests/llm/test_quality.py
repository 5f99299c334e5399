import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
from ledgerflow.llm import quality, textkit
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in quality.query(spark, SF).collect()}
    labels = duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall()
    assert len(rows) == duckdb.sql(f"select count(*) from '{SF}/documents.parquet'").fetchall()[0][0]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in rows.items())
    own = [(rows[d].predicted, q) for d, q in labels if rows[d].held_out]
    assert np.mean([p == q for p, q in own]) >= 0.97


def test_prior_estimate():
    rng = np.random.default_rng(1)
    p, n = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    assert abs(quality.estimate_prior(p, np.concatenate([p[:2100] + 0.01, n[:900]])) - 0.7) < 0.06


def test_risk_needs_no_negative_label():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(1, 1, (900, 5)), rng.normal(-1.5, 1, (300, 5))
    m = quality.fit(good[:300], np.concatenate([good[300:], bad]))
    assert (m.score(good) > 0.5).mean() > 0.9 and (m.score(bad) < 0.5).mean() > 0.9
    assert quality.fit(good[:0], good).score(good).tolist() == [0.5] * 900


def by_hand(text):
    """The features of one text in plain loops."""
    kind = lambda b: 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b > 127 else 3 if 48 <= b <= 57 else b
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    x = np.zeros(quality.SHAPES + quality.RATES)
    if not words:
        return x
    lower = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    runs = [[k for i, k in enumerate(map(kind, w)) if i == 0 or k != kind(w[i - 1])] for w in words]
    for r in runs:
        h, power = 0, 1
        for k in r:
            h, power = (h + (k + 1) * power) % 2**64, power * textkit.BASE % 2**64
        x[int(textkit.mix(np.array([(h + len(r)) % 2**64], np.uint64))[0]) % quality.SHAPES] += 1 / len(words)
    x[quality.SHAPES :] = [
        sum(a == b for a, b in zip(lower, lower[1:])) / len(words), len(set(lower)) / len(words), sum(np.log(len(w)) for w in words) / len(words),
        sum(len(r) == 1 and len(w) > 1 and kind(w[0]) == 1 for r, w in zip(runs, words)) / len(words), sum(kind(w[-1]) > 3 for w in words) / len(words),
        sum(kind(b) > 3 and b > 32 for b in raw) / len(raw), sum(kind(b) == 1 for b in raw) / len(raw), sum(kind(b) == 3 for b in raw) / len(raw), min(np.log1p(len(words)), 8) / 8,
    ]
    return x


def test_features_match_plain_loops():
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' limit 80").fetchall()] + [None, "", " \n", "One two two. TWO", "ABC!! ab*** 12 X", "\u00e9 \u00e0\x85b", "a" * 300]
    assert np.allclose(quality.features_of(pa.array(texts)), [by_hand(t) for t in texts], atol=1e-5)


def test_gradient_of_the_risk():
    rng = np.random.default_rng(4)
    p, u, prior = rng.normal(1, 1, (40, 3)), rng.normal(0, 1, (60, 3)), 0.4

    def parts(w):
        return prior * np.logaddexp(0, -p @ w).mean(), np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()

    seen = set()
    for w in (np.zeros(3), np.array([0.5, -0.2, 0.1]), np.array([4.0, 4.0, 4.0])):
        a, b = parts(w)
        seen.add(b >= 0)
        risk = (lambda w: sum(parts(w))) if b >= 0 else (lambda w: -parts(w)[1])
        number = [(risk(w + e) - risk(w - e)) / 2e-5 for e in np.eye(3) * 1e-5]
        assert np.allclose(quality.risk_gradient(w, p, u, prior), number, atol=1e-6)
    assert seen == {True, False}


def test_scores_are_the_models_on_those_features(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"))
    for r in quality.query(spark, sf).collect():
        text = docs.where(f"doc_id = {r.doc_id}").first().text if r.doc_id % 50 == 0 else None
        if text:
            z = (by_hand(text) - model.mean) / model.scale @ model.w[:-1] + model.w[-1]
            assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-4


def test_sample_is_bounded_by_rows_and_leaves_repeated_rows(spark):
    docs = spark.createDataFrame([(k % 3, f"text {k // 2}") for k in range(60)] * 3, "doc_id long, text string")
    own = quality._sample(docs, docs.select("doc_id").distinct(), 7).collect()
    assert len(own) == 7 and quality._sample(docs, docs.select("doc_id").distinct(), 700).count() == docs.distinct().count()


def test_features_do_not_depend_on_neighbours():
    texts = ["One two two.", None, "", "ABC!! ab*** 12", "é à", " "]
    together = quality.features_of(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(together[i], quality.features_of(pa.array([t], pa.string()))[0])


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (5, 1), (6, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(awkward.select("doc_id", "text"), labels)
    out = quality.classify(awkward, model)
    assert out.count() == awkward.count() and set(out.columns) == {*awkward.columns, "predicted"}
    assert out.where("text is null or text = ''").agg(F.countDistinct("score")).first()[0] == 1
    assert quality.classify(awkward.limit(0), model).count() == 0
    assert quality.train(awkward.select("doc_id", "text"), labels.limit(0)).score(np.zeros((1, quality.SHAPES + quality.RATES)))[0] == 0.5
