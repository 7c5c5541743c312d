"""Language identification, word first with back-off to character n-grams.

A known word is scored by its log frequency in each language.  An unseen word
falls back to the longest character n-grams (from 4 down to 1, with word ends)
of which any is known.  The per-word scores of a whole text are summed and a
softmax over them, tempered by the text's length, gives the score.

The tables are counted on a bounded sample of training rows:
``TRAIN_BYTES`` of text for each language, chosen by a hash of the id, and at
most ``VOCABULARY`` words of each.  Every language is learned: more than
``LANGUAGES`` share the bytes and words that so many would get.  A table holds
the known (word, language) pairs only, so the broadcast is bounded however large
the corpus is.  Prediction reads the text alone, all of it.

Nulls and ties: null text or a text without a letter is ``und`` with score 0;
rows with a null language or id do not train; equal scores take the language
that sorts first; without any training row everything is ``und``.  Empty tables
give no rows and a model without languages.  Rows that repeat are each answered
and, where they train, each counted.  A very long text is counted whole, its
distinct words scored ``CELLS`` cells at a time.  Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .frames import documents, group_sample

TRAIN_BYTES, LANGUAGES, VOCABULARY, LONGEST = 2 << 20, 64, 20_000, 4
#: Remembered scores of words in a worker, for ``LANGUAGES`` languages; cells of scores that are worked out at once.
REMEMBERED, CELLS = 200_000, 1 << 21
#: Python's word class also holds numbers that are no letters, such as ², ½, ① and Ⅷ.
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def grams(word: str, n: int) -> list[str]:
    w = f"_{word}_" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Model:
    """Per-language log frequencies of words and of character n-grams."""

    def __init__(self, counts: dict[str, Counter]):
        self.languages = sorted(counts)
        size = max(1, len(counts))
        words = max(1, min(VOCABULARY, VOCABULARY * LANGUAGES // size))
        self.most, self.step = max(1, min(REMEMBERED, REMEMBERED * LANGUAGES // size)), max(1, CELLS // size)
        self.tables = [self._table([dict(counts[x].most_common(words)) for x in self.languages])]
        for n in range(LONGEST, 0, -1):
            per = []
            for x in self.languages:
                c: Counter = Counter()
                for w, k in counts[x].items():
                    for g in grams(w, n):
                        c[g] += k
                per.append(dict(c.most_common(words)))
            self.tables.append(self._table(per))
        self.forget()

    @staticmethod
    def _table(per: list[dict]) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row of each key, log frequency of absent keys per language, and the present ones: bounds of each row, languages, log frequencies."""
        row = {k: i for i, k in enumerate(sorted(set().union(*per)))} if per else {}
        at = np.array([row[k] for c in per for k in c], np.int64)
        lang = np.repeat(np.arange(len(per), dtype=np.int32), [len(c) for c in per])
        count = np.array([n for c in per for n in c.values()], np.float64)
        total = np.array([sum(c.values()) for c in per], np.float64) + 0.1 * len(row)
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(len(row) + 1))
        absent = np.log(0.1 / total) if row else np.zeros(len(per))
        return row, absent.astype(np.float32), bounds, lang[order], np.log((count + 0.1) / total[lang]).astype(np.float32)[order]

    def forget(self) -> None:
        """Drop the remembered words; their scores are rows of one matrix."""
        self.memory: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.languages)), np.float32)

    def rows(self, words: dict[str, int]) -> list[int]:
        """The row of each distinct word in ``scores``; new words are scored first."""
        if len(self.memory) >= self.most:
            self.forget()
        found = list(map(self.memory.get, words))
        if None in found:
            new = [w for w, i in zip(words, found, strict=True) if i is None]
            first, size = len(self.memory), len(self.scores)
            self.memory.update(zip(new, range(first, first + len(new)), strict=True))
            if len(self.memory) > size:
                self.scores = np.concatenate([self.scores, np.zeros((max(min(1024, self.most), size, len(self.memory) - size), len(self.languages)), np.float32)])
            self.scores[first : first + len(new)] = self._score(new)
            found = list(map(self.memory.get, words))
        return found

    def _score(self, words: list[str]) -> np.ndarray:
        """Per-language scores of words: the known ones' own, else those of the longest n-grams of which any is known."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        left = list(enumerate(words))
        for n, (row, absent, bounds, lang, logs) in zip([0, *range(LONGEST, 0, -1)], self.tables, strict=True):
            at, flat, starts, rest = [], [], [], []
            for i, w in left:
                known = [r for r in map(row.get, grams(w, n) if n else (w,)) if r is not None]
                if known:
                    at.append(i), starts.append(len(flat))
                    flat += known
                else:
                    rest.append((i, w))
            if at:
                sizes = bounds[np.add(flat, 1)] - bounds[flat]
                entry = np.repeat(bounds[flat] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                each = np.repeat(absent[None, :], len(flat), axis=0)
                each[np.repeat(np.arange(len(flat)), sizes), lang[entry]] = logs[entry]
                v = np.add.reduceat(each, starts, axis=0)
                out[at] = (v - v.max(axis=1, keepdims=True)) / max(1, n)  # neighbouring n-grams share characters
            left = rest
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words_of(text or ""))
        if not counts or not self.languages:
            return "und", 0.0
        items, total = list(counts.items()), np.zeros(len(self.languages))
        for lo in range(0, len(items), self.step):
            part = dict(items[lo : lo + self.step])
            rows = self.rows(part)
            total += np.fromiter(part.values(), np.float64, len(part)) @ self.scores[rows]
        n = sum(counts.values())
        e = np.exp((total - total.max()) / max(1.0, math.sqrt(n)))
        i = int(np.argmax(total))
        return self.languages[i], float(e[i] / e.sum())


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_bytes: int = TRAIN_BYTES) -> Model:
    known = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def count(batches):
        for batch in batches:
            per: dict[str, Counter] = {}
            texts = tc.column(batch, "text")
            for i, lang in enumerate(batch.column(2).to_pylist()):
                per.setdefault(lang, Counter()).update(words_of(texts[i].as_py()))
            cells = [(x, w, n) for x, c in per.items() for w, n in c.items()]
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells]), pa.array([c[1] for c in cells]), pa.array([c[2] for c in cells], pa.int64())], names=["lang", "word", "n"])

    sample = group_sample(known, "text", "doc_id", max_bytes, "lang", LANGUAGES)
    counts: dict[str, Counter] = {}
    for r in sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    # ties among equally frequent words are cut in the order of the words
    return Model({x: Counter(dict(sorted(c.items()))) for x, c in counts.items()})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    model.forget()
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        m = bc.value
        for batch in batches:
            texts = tc.column(batch, "text")
            got = [m.predict(texts[i].as_py()) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(predict, "doc_id long, lang_pred string, score double")


def op3_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = train(docs.where(~held_out))
    return identify(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
