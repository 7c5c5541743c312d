"""Toxicity: FTRL-proximal logistic regression over hashed n-grams.

Features are the word unigrams, bigrams and skip-grams (one word left out) that
occur in a text, hashed to ``2**BITS`` coordinates; each counts once.  Training
is FTRL-proximal: every coordinate has its own rate, and the L1 term keeps the
weights sparse, so what is broadcast is the few nonzero weights.

The model is fitted on labelled rows of about ``TRAIN_BYTES`` of text chosen by
a hash of the id.  Scoring reads whole texts and nothing else.

Nulls: null text scores as empty text; null labels or ids do not train.  With
no label the score is 0.5.  A repeated id trains once per row, and repeated rows
are each answered.  An empty table gives no rows.  A very long text is scored
whole, in a slice of its own.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .frames import documents
from .quality_classifier import train

TRAIN_BYTES, BITS = 10 << 20, 22
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 20.0, 0.5, 10


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate) of every unigram, bigram and skip-gram."""
    words = tc.Words(texts, tc.ALNUM_LOWER)
    h = words.hashes()
    parts = [(words.doc, tc.mix(h + np.uint64(1)))]
    for d in (1, 2):
        a, b = h[:-d], h[d:]
        same = words.doc[:-d] == words.doc[d:]
        parts.append((words.doc[:-d][same], tc.mix(a[same] * np.uint64(3 + 2 * d) + tc.mix(b[same] + np.uint64(d)))))
    doc = np.concatenate([p[0] for p in parts])
    at = np.concatenate([p[1] for p in parts]) >> np.uint64(64 - BITS)
    return doc, at.astype(np.int64)


class Model:
    """Sparse weights: sorted coordinates and their values."""

    def __init__(self, at: np.ndarray, weight: np.ndarray, bias: float):
        self.at, self.weight, self.bias = at, weight, bias

    def score(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        logit = np.full(n, self.bias)
        if n and len(self.at):
            doc, at = features(texts)
            i = np.minimum(np.searchsorted(self.at, at), len(self.at) - 1)
            hit = self.at[i] == at
            pair = np.unique(doc[hit] * np.int64(len(self.at)) + i[hit])
            logit = logit + np.bincount(pair // len(self.at), self.weight[pair % len(self.at)], n)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(texts: list[str], labels: np.ndarray) -> Model:
    z, n = np.zeros((1 << BITS) + 1, np.float32), np.zeros((1 << BITS) + 1, np.float32)
    bias = 1 << BITS
    rows = []
    for t in texts:
        at = np.unique(features(pa.array([t], pa.large_string()))[1])
        rows.append(np.append(at, bias))
    l1 = np.float32(L1)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    # both classes weigh alike, so that 0.5 is a fair cut
    share = labels.mean()
    scale = {1: min(10.0, 0.5 / share), 0: 0.5 / (1 - share)}
    rng = np.random.default_rng(5)

    def weights(at):
        zz = z[at]
        w = -(zz - np.sign(zz) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(zz) <= l1] = 0
        return w

    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)).tolist():
            at = rows[i]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = np.float32((p - labels[i]) * scale[int(labels[i])])
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(bias + 1))
    at = np.flatnonzero(w[:bias])
    return Model(at, w[at].astype(np.float64), float(w[bias]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score."""
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = bc.value
        for batch in batches:
            texts = tc.column(batch, "text")
            for lo, hi in tc.slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(m.score(texts[lo:hi]), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def op6_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    texts, marks = train(docs.where(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", max_bytes=TRAIN_BYTES)
    model = fit(texts, marks)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
