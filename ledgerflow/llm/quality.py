"""Operator 7: quality classifier by positive-unlabelled learning.

Trusted positives are training documents labelled 1; the unlabelled side is a sample of the web text itself, good and bad.
Negative labels are not used. The class prior is estimated from the two samples (best bin estimation, Garg et al. 2021),
then a logistic model minimises the non-negative unbiased risk (Kiryo et al. 2017)

    prior * E_p[loss(f)] + max(0, E_u[loss(-f)] - prior * E_p[loss(-f)]),

whose minimiser estimates the log odds of label 1, so its logistic value is a probability.

A text's features are frequencies of its words' hashed shapes (runs of upper case, lower case, digits, marks) and a few
rates: repeated words, distinct words, lengths, marks. They need one pass over the bytes. Samples are bounded
(``MOST_POSITIVES``, ``MOST_UNLABELLED`` distinct rows by smallest hash of id and text); every document is scored, whole, without a
shuffle, and tasks receive only the weights.

Defined results. Null and empty texts have all-zero features and the score of those. Repeated rows are scored alike.
Documents without a label may serve as unlabelled text. Without any positive label the score is 0.5 throughout. Empty
table: empty result. Input columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerflow.llm import textkit

SHAPES, RATES = 256, 9
MOST_POSITIVES, MOST_UNLABELLED, SLICE_BYTES = 6000, 12_000, 1 << 20
THRESHOLD, FOLDS = 0.3, 5


def _classes() -> np.ndarray:
    """Class of each byte: upper case 1, lower case and all above 7F 2, digit 3, any other mark its own value."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91], t[97:123], t[128:], t[48:58] = 1, 2, 2, 3
    return t


CLASSES = _classes()


def features_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row per text; all zeros without words."""
    w = textkit.scan(column, "space", lower=False)
    texts, words = len(w.bounds) - 1, len(w.start)
    out = np.zeros((texts, SHAPES + RATES), np.float32)
    if not words:
        return out
    n = np.maximum(w.counts, 1)[:, None].astype(np.float64)
    doc = np.repeat(np.arange(texts), w.counts)
    kinds = CLASSES[w.data]
    # Shapes: of each run of one class a single byte stays.
    turn = np.ones(len(kinds), bool)
    turn[1:] = kinds[1:] != kinds[:-1]
    turn[w.start] = True
    place = np.concatenate([[0], np.cumsum(turn)])
    start, end = place[w.start], place[w.end]
    shape = textkit.hash_ranges(kinds[turn], start, end) % np.uint64(SHAPES)
    out[:, :SHAPES] = np.bincount(doc * SHAPES + shape.astype(np.int64), minlength=texts * SHAPES).reshape(texts, SHAPES) / n
    h = textkit.hash_ranges(textkit.LOWER[w.data], w.start, w.end)
    again = np.zeros(words, bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    fresh = np.ones(words, bool)
    fresh[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    distinct = np.bincount(ds[fresh], minlength=texts)
    of_text = lambda values: np.add.reduceat(np.append(values, 0), np.minimum(w.bounds[:-1], len(values))) * (np.diff(w.bounds) > 0)
    per_word = lambda values: np.bincount(doc, values, texts)
    size = np.maximum(np.diff(w.bounds), 1)
    marks, runs = (kinds > 3) & (w.data > 32), (end - start)
    single = (runs == 1) & (w.end - w.start > 1)
    rates = [per_word(again), distinct, per_word(np.log(w.end - w.start)), per_word(single & (kinds[w.start] == 1)), per_word(kinds[w.end - 1] > 3)]
    for k, r in enumerate(rates):
        out[:, SHAPES + k] = r / n[:, 0]
    for k, c in enumerate((marks, kinds == 1, kinds == 3)):
        out[:, SHAPES + len(rates) + k] = of_text(c.astype(np.int64)) / size
    out[:, -1] = np.minimum(np.log1p(w.counts), 8) / 8
    out[w.counts == 0] = 0
    return out


def _descend(risk_gradient, dim: int, steps: int, rate: float) -> np.ndarray:
    """Adam on a full-batch gradient; deterministic."""
    w, m, v = np.zeros(dim), np.zeros(dim), np.zeros(dim)
    for t in range(1, steps + 1):
        g = risk_gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among unlabelled scores: the least ratio of tails, each with its sampling error added."""
    cuts = np.quantile(p, np.linspace(0, 0.99, 100))
    tail = lambda s: (s[None] >= cuts[:, None]).mean(axis=1)
    pt, ut = tail(p), tail(u)
    error = np.sqrt(np.log(200) / 2) * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p)))
    best = int(np.argmin((ut + error) / np.maximum(pt, 1e-9)))
    return float(np.clip(ut[best] / pt[best], 0.01, 0.99))


class Model:
    """Weights on standardised features; a fixed number of them."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, prior: float):
        self.mean, self.scale, self.w, self.prior = mean, scale, w, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1])


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Direction of descent of the non-negative risk: where the part for negatives has fallen below zero, it is raised again."""
    zp, zu = p @ w, u @ w
    as_positive = -(_sigmoid(-zp) @ p) / len(p)
    rest = (_sigmoid(zu) @ u) / len(u) - prior * (_sigmoid(zp) @ p) / len(p)
    negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return prior * as_positive + rest if negative_risk >= 0 else -rest


def fit(positive: np.ndarray, unlabelled: np.ndarray, l2: float = 1e-4, steps: int = 400, rate: float = 0.03) -> Model:
    """Estimate the prior on halves of the samples, then minimise the non-negative risk on all of them."""
    d = unlabelled.shape[1] if len(unlabelled) else SHAPES + RATES
    if len(positive) < 2 or len(unlabelled) < 2:
        return Model(np.zeros(d), np.ones(d), np.zeros(d + 1), 0.5)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 0.02
    one = lambda x: np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    p, u = one(positive), one(unlabelled)
    decay = np.append(np.full(d, l2), 0)

    def against(w: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
        return (-(_sigmoid(-(p @ w)) @ p) / len(p) + (_sigmoid(u @ w) @ u) / len(u)) / 2 + 10 * decay * w

    # Each half of the samples is scored by a model of the other.
    fitted = [_descend(lambda w, k=k: against(w, p[k::2], u[k::2]), d + 1, steps // 2, rate) for k in (0, 1)]
    prior = float(np.mean([estimate_prior(p[1 - k :: 2] @ w, u[1 - k :: 2] @ w) for k, w in enumerate(fitted)]))
    return Model(mean, scale, _descend(lambda w: risk_gradient(w, p, u, prior) + decay * w, d + 1, steps, rate), prior)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == 0, F.lit(False))


def _features(df: DataFrame) -> np.ndarray:
    """Rows of a sample, in the order of its hashes whatever the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in textkit.in_slices(batches, "text", SLICE_BYTES):
            x = features_of(t.column("text"))
            yield pa.RecordBatch.from_arrays([*(t.column(k).combine_chunks() for k in ("h", "th")), pa.array([r.tobytes() for r in x], pa.binary())], ["h", "th", "x"])

    rows = sorted(df.select("h", "th", "text").mapInArrow(run, "h long, th long, x binary").collect(), key=lambda r: (r.h, r.th))
    return np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float32).reshape(len(rows), SHAPES + RATES).astype(np.float64)


def _sample(docs: DataFrame, ids: DataFrame | None, most: int) -> DataFrame:
    """At most ``most`` distinct texts of ``ids`` (None: of all), by smallest hash of id and text; rows that repeat both count once."""
    hashes = [F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("th")]
    keys = docs.select("doc_id", *hashes)
    keys = keys if ids is None else keys.join(ids.select("doc_id"), "doc_id", "left_semi")
    few = keys.select("h", "th").distinct().orderBy("h", "th").limit(most)  # texts do not move but those of the sample
    return docs.select("text", *hashes).join(F.broadcast(few), ["h", "th"], "left_semi").dropDuplicates(["h", "th"])


def train(docs: DataFrame, labels: DataFrame, positives: int = MOST_POSITIVES, unlabelled: int = MOST_UNLABELLED) -> Model:
    """Model from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``, without the held-out fold of either."""
    seen = ~held_out(F.col("doc_id"))
    trusted = labels.where(seen & (F.col("quality") == 1)).select("doc_id").distinct()
    p = _features(_sample(docs, trusted, positives))
    u = _features(_sample(docs.where(seen), None, unlabelled))
    return fit(p, u)


def classify(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``score`` and ``predicted``."""
    df = df.drop(*[c for c in df.columns if c.lower() in ("score", "predicted")])
    schema = StructType([*df.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in textkit.in_slices(batches, text, SLICE_BYTES):
            yield from t.append_column("score", pa.array(model.score(features_of(t.column(text))))).to_batches()

    return df.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return classify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
