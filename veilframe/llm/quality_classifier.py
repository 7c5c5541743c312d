"""Quality classifier: random-indexing word vectors and a two-layer network.

Each word has a sparse ternary index vector that its hash fixes.  A word's
vector is the sum of the index vectors of its neighbours within ``REACH``
words, over a sample of the labelled texts; a document is the mean of its words' vectors and of their shape
tokens (upper case, digits, symbols, same word again).  A two-layer network in
numpy gives a logit, and a temperature fitted on rows that did not train it
calibrates the probability.

Fitting takes labelled rows of about ``TRAIN_BYTES`` of text, chosen by a hash
of the id, and at most ``VOCABULARY`` words, so the model and the driver's work
are bounded.  Scoring reads whole texts and nothing else.

Nulls: null text scores as empty text; null labels or ids do not train.  With
no label, or labels of one kind, the score is that kind's smoothed share.  A
repeated id trains once per row, and repeated rows are each answered.  An empty
table gives no rows.  A very long text is scored whole; its words are pooled by
count.  Other columns are not read.
"""

from __future__ import annotations

import operator
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .frames import documents, sampled, written

TRAIN_BYTES, VOCABULARY, MIN_COUNT = 10 << 20, 20_000, 3
DIM, NONZERO, REACH, HIDDEN, EPOCHS = 128, 8, 2, 32, 80
REMEMBERED = 200_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SHAPES = ["<upper>", "<title>", "<lower>", "<digit>", "<symbol>", "<mixed>", "<again>"]


def shape(token: str) -> str:
    if token.isdigit():
        return "<digit>"
    if not (token[0].isalnum() or token[0] == "_"):
        return "<symbol>"
    if token.islower():
        return "<lower>"
    if len(token) > 1 and token.isupper():
        return "<upper>"
    return "<title>" if token.istitle() else "<mixed>"


def index_vector(word: str) -> np.ndarray:
    rng = np.random.default_rng(xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 7))
    v = np.zeros(DIM, np.float32)
    v[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return v


class Classifier:
    """Word vectors, network and temperature; ``features`` pools a whole text."""

    def __init__(self):
        self.row: dict[str, int] = {}
        self.vectors = np.zeros((0, DIM), np.float32)
        self.shape_row = {s: i for i, s in enumerate(_SHAPES)}
        self.layers, self.temperature, self.prior = None, 1.0, 0.5
        self.center = self.spread = None
        self.memory: dict[str, tuple[int, int]] = {}

    def _codes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        memory, row, shapes = self.memory, self.row, self.shape_row
        if len(memory) > REMEMBERED:
            memory.clear()
        codes = []
        for t in _TOKEN.findall(text):
            c = memory.get(t)
            if c is None:
                c = memory[t] = row.get(t, -1) * 16 + shapes[shape(t)]
            codes.append(c)
        a = np.array(codes, np.int64)
        return a >> 4, a & 15

    def index(self, texts: list[str]) -> None:
        count: Counter = Counter()
        for t in texts:
            count.update(_TOKEN.findall(t))
        kept = sorted((w for w in count if count[w] >= MIN_COUNT), key=lambda w: (-count[w], w))[:VOCABULARY]
        self.row = {w: i for i, w in enumerate(kept)}
        own = np.stack([index_vector(w) for w in kept]) if kept else np.zeros((0, DIM), np.float32)
        v = own.copy()
        weight = np.array([1.0 / np.sqrt(count[w]) for w in kept], np.float32)  # frequent neighbours say less
        for t in texts:
            r, _ = self._codes(t)
            r = r[r >= 0]
            for d in range(1, REACH + 1):
                a, b = r[:-d], r[d:]
                np.add.at(v, a, own[b] * weight[b, None])
                np.add.at(v, b, own[a] * weight[a, None])
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        self.vectors = np.where(norm > 0, v / np.maximum(norm, 1e-9), 0).astype(np.float32)

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(DIM + len(_SHAPES) + 2, np.float32)
        r, s = self._codes(text or "")
        n = len(r)
        if n:
            known = r[r >= 0]
            if len(known):
                rows, k = np.unique(known, return_counts=True)
                out[:DIM] = (k.astype(np.float32) @ self.vectors[rows]) / n
            out[DIM : DIM + len(_SHAPES)] = np.bincount(s, minlength=16)[: len(_SHAPES)] / n
            plain = (text or "").split()
            out[DIM + len(_SHAPES) - 1] = sum(map(operator.eq, plain, plain[1:])) / max(1, len(plain))
            out[DIM + len(_SHAPES)] = len(known) / n
        out[-1] = np.log1p(n) / 10
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(((x - self.center) / self.spread) @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, texts: list[str], labels: np.ndarray) -> Classifier:
        self.prior = float((labels.sum() + 1) / (len(labels) + 2))
        self.index(texts)
        self.memory = {}
        if len(set(labels.tolist())) < 2 or len(labels) < 10:
            return self
        x = np.stack([self.features(t) for t in texts]).astype(np.float64)
        y = labels.astype(np.float64)
        held = np.arange(len(y)) % 5 == 4  # calibrates the temperature
        if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
            held[:] = False
        self.center, self.spread = x.mean(0), x.std(0) + 0.02
        rng = np.random.default_rng(11)
        params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        z, t = (x[~held] - self.center) / self.spread, y[~held]
        weight = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean()))
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(t))
            for o in np.array_split(order, max(1, len(t) // 64)):
                hid = np.tanh(z[o] @ params[0] + params[1])
                p = 1 / (1 + np.exp(-np.clip(hid @ params[2] + params[3], -30, 30)))
                g = (p - t[o]) * weight[o] / len(o)
                back = np.outer(g, params[2]) * (1 - hid**2)
                grads = [z[o].T @ back + 1e-4 * params[0], back.sum(0), hid.T @ g + 1e-4 * params[2], g.sum()]
                step += 1
                for i, d in enumerate(grads):
                    first[i] = 0.9 * first[i] + 0.1 * d
                    second[i] = 0.999 * second[i] + 0.001 * d * d
                    params[i] = params[i] - 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        self.layers = params
        rows = held if held.any() else ~held
        logit = self.logits(x[rows])
        loss = lambda T: np.mean(np.logaddexp(0, -np.where(y[rows] == 1, 1, -1) * logit / T))
        self.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
        return self


def train(docs: DataFrame, labels: DataFrame, target: str, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = TRAIN_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of labelled rows of ``max_bytes`` of text, in the order of the ids' hashes.

    The bytes of the labelled rows alone are measured, by id, and their ids are
    sampled; texts are then fetched by the sample's ids, so none is shuffled.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("mark_id"), F.col(target).cast("int").alias("mark")).where("mark_id is not null and mark in (0, 1)")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id is not null")
    sizes = rows.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes"))
    labelled = written(marks.join(sizes, F.col("mark_id") == F.col("doc_id")).select("mark_id", "mark", "bytes"), "labelled-ids")
    chosen = sampled(labelled, F.col("bytes"), "mark_id", max_bytes).select("mark_id", "mark")
    got = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("mark_id")).select("doc_id", "text", "mark").toArrow().to_pylist()
    got.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"])), r["text"], r["mark"]))
    return [r["text"] for r in got], np.array([r["mark"] for r in got], np.int64)


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score."""
    model.memory = {}
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = bc.value
        for batch in batches:
            texts = tc.column(batch, "text")
            x = np.stack([m.features(texts[i].as_py()) for i in range(len(texts))]) if len(texts) else np.zeros((0, DIM + len(_SHAPES) + 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.probability(x).astype(np.float64) if len(x) else [], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def op5_quality_classifier(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    texts, marks = train(docs.where(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    model = Classifier().fit(texts, marks)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
