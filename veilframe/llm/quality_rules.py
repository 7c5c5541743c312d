"""Quality rules with risk-controlled thresholds.

Base measures come from whole texts.  Two base rules reject outright (too few
words, too many repeated words).  Further cutoffs are chosen on labelled
holdouts: for each stratum (the language) and each measure, candidate cutoffs
are tried, and one is accepted only if the exact (Clopper-Pearson) upper bound
of its false rejection rate, the share of good documents beyond it, stays below
``ALPHA``; that is so where at most so many rejections have a probability of no
more than the error level under a rate of ALPHA, which is what is computed.  All stratum x measure x candidate tests share the error level
``DELTA`` (Bonferroni), so with confidence 1 - DELTA every accepted cutoff
rejects at most ALPHA of a stratum's good documents.  Among the accepted ones
the cutoff that rejects most bad documents is taken; without evidence (few
labels, none accepted, nothing bad beyond it) a measure rejects nothing.

The measures, not the texts, are joined with the labels.  Exact copies are no
independent trials: a text counts once for each stratum and label.  Counts per
(stratum, measure, candidate) are aggregated over all labelled texts; what
reaches the driver is one row for each labelled stratum, however many there are,
and the accepted cutoffs are joined back as a small table.

Nulls: a null text has no words and fails; a null stratum is a stratum of its
own; a null label is no label; an id with several labels counts with each;
labels of unknown ids are ignored.  Repeated rows are each answered.  Empty
tables give no rows, and without labels only the base rules reject.  A very long
text is measured whole, in a slice of its own.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .frames import documents, written

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
ALPHA, DELTA = 0.02, 0.05
#: Candidate cutoffs; a document is rejected if its measure is above (below, for word length) the cutoff.
CANDIDATES = {
    "symbol_ratio": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0],
    "dup_line_ratio": [0.05, 0.1, 0.2, 0.3, 0.5],
    "repeat_ratio": [0.01, 0.02, 0.05, 0.1, 0.15],
    "mean_word_chars": [9.0, 10.0, 12.0, 15.0, 20.0],
    "upper_ratio": [0.2, 0.4, 0.6, 0.8],
}

_KEY = ["doc_id", "stratum", "text_hash"]
_BASE = "doc_id long, stratum string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_letters long, n_upper long"
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LETTER = _UPPER.copy()
_LETTER[97:123] = 1
_HEAD = np.ones(256, np.int64)  # first byte of a code point
_HEAD[0x80:0xC0] = 0


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def _measure(batches):
    for batch in batches:
        texts = tc.column(batch, "text")
        for lo, hi in tc.slices(texts):
            part, n = texts[lo:hi], hi - lo
            words = tc.Words(part, tc.PLAIN)
            raw = words._raw
            lo_b, hi_b = words.offsets[:-1], words.offsets[1:]
            chars = np.bincount(words.doc, _sums(_HEAD[raw], words.starts, words.ends), n).astype(np.int64) if len(words) else np.zeros(n, np.int64)
            at, h = words.windows(words.hashes(), REPEAT_WINDOW)
            repeats = np.zeros(n, np.int64)
            if len(at):
                key = tc.mix(h + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                _, back, count = np.unique(key, return_inverse=True, return_counts=True)
                twice = at[count[back] > 1]
                if len(twice):
                    repeats = np.bincount(words.doc[tc.covered(len(words), twice, REPEAT_WINDOW)], minlength=n)
            dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i in np.flatnonzero(_sums(raw == 10, lo_b, hi_b)).tolist():
                body = [x for x in words.bytes[lo_b[i] : hi_b[i]].split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
                lines[i], dup[i] = len(body), len(body) - len(set(body))
            lines = np.where((lines == 0) & (words.counts > 0), 1, lines)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i)[lo:hi] for i in range(len(_KEY))), *(pa.array(np.asarray(x, np.int64)) for x in (words.counts, chars, _sums(_SYMBOL[raw], lo_b, hi_b), dup, repeats, lines, _sums(_LETTER[raw], lo_b, hi_b), _sums(_UPPER[raw], lo_b, hi_b)))],
                names=[*_KEY, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper"],
            )


def _key(id_col: str, text_col: str, stratum_col: str) -> list:
    return [F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.xxhash64(text_col).alias("text_hash")]


def base_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    rows = docs.select(*_key(id_col, text_col, stratum_col), F.col(text_col).alias("text")).mapInArrow(_measure, _BASE)
    return _base_failed(rows)


def _base_failed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _ratios() -> dict:
    """What each measure's cutoffs are held against; a document passes if the value is at most the cutoff."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"symbol_ratio": per("n_symbols", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines"), "repeat_ratio": per("n_repeat_words", "n_words"), "mean_word_chars": per("word_chars", "n_words"), "upper_ratio": per("n_upper", "n_letters")}


def binomial_at_most(k: int, n: int, rate: float) -> float:
    """Probability of at most k of n at a rate, exact up to rounding.

    The terms are added from k downwards, where they shrink at least
    geometrically while k is below the mean, until none matters; so the work
    grows with the spread, not with n.
    """
    if k >= n:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate))
    total, i = term, k
    while i > 0 and (term > total * 1e-17 or i > n * rate):
        term *= i * (1 - rate) / ((n - i + 1) * rate)
        total += term
        i -= 1
    return min(1.0, total)


def fit_cutoffs(measures: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str | None, str], float]:
    """(stratum, measure) -> accepted cutoff."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    known = measures.where("not base_failed").join(marks, "doc_id").dropDuplicates(["stratum", "text_hash", "quality"])
    cells = [F.count_if((_ratios()[m] > c) & (F.col("quality") == q)).alias(f"{m}|{i}|{q}") for m, cs in CANDIDATES.items() for i, c in enumerate(cs) for q in (0, 1)]
    rows = known.groupBy("stratum").agg(F.count_if(F.col("quality") == 1).alias("good"), *cells).collect()
    level = delta / max(1, len(rows) * sum(map(len, CANDIDATES.values())))
    out = {}
    for r in rows:
        for m, cs in CANDIDATES.items():
            best = (0, None)
            for i, c in enumerate(cs):
                k, bad = r[f"{m}|{i}|1"], r[f"{m}|{i}|0"]
                if bad > best[0] and k < alpha * r["good"] and binomial_at_most(k, r["good"], alpha) <= level:
                    best = (bad, c)
            if best[1] is not None:
                out[r["stratum"], m] = best[1]
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per document: the base measures, base_failed, failed_rules and kept."""
    measures = written(base_measures(docs, id_col, text_col, stratum_col), "quality-measures")  # texts are measured once
    return _verdict(measures, fit_cutoffs(measures, labels))


def _verdict(measures: DataFrame, cutoffs: dict) -> DataFrame:
    measures = measures if "base_failed" in measures.columns else _base_failed(measures)
    names, kinds = sorted(CANDIDATES), sorted({m for _, m in cutoffs})
    given = measures.columns
    if cutoffs:  # one row for each stratum with a cutoff, beside its documents
        strata = sorted({s for s, _ in cutoffs}, key=str)
        table = measures.sparkSession.createDataFrame([(s, *(cutoffs.get((s, m)) for m in names)) for s in strata], ", ".join(["__stratum string", *(f"__{m} double" for m in names)]))
        measures = measures.join(F.broadcast(table), F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    failed = [F.when(_ratios()[m] > F.col(f"__{m}"), F.lit(m)) for m in kinds]
    rules = F.filter(F.array(F.when(F.col("base_failed"), F.lit("base")), *failed), lambda x: x.isNotNull())
    return measures.withColumn("failed_rules", rules).withColumn("kept", F.size("failed_rules") == 0).select(*given, "failed_rules", "kept")


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The documents that the rules keep, with the columns they have; no text is shuffled.

    Texts are measured twice, for the cutoffs and for the verdict: to write them
    beside their measures would cost a copy of the corpus.
    """
    cutoffs = fit_cutoffs(base_measures(docs, id_col, text_col, stratum_col), labels)
    given = docs.select(F.struct(*_key(id_col, text_col, stratum_col)).alias("by"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text_at = docs.columns.index(text_col)

    def beside(batches):
        for batch in batches:
            by, row = batch.column(0).flatten(), batch.column(1)
            text = row.flatten()[text_at]
            for lo, hi in tc.slices(pc.fill_null(text.cast(pa.large_string()), "")):
                part = pa.RecordBatch.from_arrays([*(c[lo:hi] for c in by), text[lo:hi]], names=[*_KEY, "text"])
                found = pa.Table.from_batches(_measure([part])).combine_chunks()
                yield pa.RecordBatch.from_arrays([*(c.chunk(0) for c in found.columns), row[lo:hi]], names=[*found.schema.names, "row"])
            pa.default_memory_pool().release_unused()

    measured = given.mapInArrow(beside, f"{_BASE}, row {given.schema['row'].dataType.simpleString()}")
    return _verdict(measured, cutoffs).where("kept").select("row.*")


def op10_quality_rules(spark, sf_dir):
    out = quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def _oracle() -> str:
    """The same in plain SQL: measures by lists of words, cutoffs by the binomial distribution of the labelled texts."""
    tests = sum(map(len, CANDIDATES.values()))
    grid = ", ".join(f"('{m}', {c}::DOUBLE)" for m, cs in CANDIDATES.items() for c in cs)
    ratios = {"symbol_ratio": ("n_symbols", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"), "mean_word_chars": ("word_chars", "n_words"), "upper_ratio": ("n_upper", "n_letters")}
    value = "CASE c.measure " + " ".join(f"WHEN '{m}' THEN CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END" for m, (a, b) in ratios.items()) + " END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09\x0B-\x0D]')) AS l FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + {REPEAT_WINDOW - 1}], ' ') AS body FROM (SELECT r, w, unnest(generate_series(1, len(w) - {REPEAT_WINDOW - 1})) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, body) AS n FROM g) WHERE n > 1),
cover AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + {REPEAT_WINDOW - 1})) AS p FROM twice) GROUP BY r),
m AS (SELECT doc_id, lang, text, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS n_upper FROM d LEFT JOIN cover USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
k AS (SELECT DISTINCT f.* EXCLUDE (doc_id), quality FROM f JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IN (0, 1)),
c AS (SELECT * FROM (VALUES {grid}) t(measure, cutoff)),
n AS (SELECT lang, measure, cutoff, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 1 AND {value} > cutoff) AS lost, count(*) FILTER (quality = 0 AND {value} > cutoff) AS bad FROM k, c GROUP BY ALL),
a AS (SELECT *, list_sum(list_transform(range(lost + 1), lambda i: exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({ALPHA}) + (good - i) * ln(1 - {ALPHA})))) AS p FROM n WHERE bad > 0 AND lost < {ALPHA} * good),
best AS (SELECT lang, measure, arg_max(cutoff, (bad, -cutoff)) AS cutoff FROM a WHERE p <= {DELTA} / (SELECT greatest(count(DISTINCT coalesce(lang, '')), 1) * {tests} FROM k) GROUP BY ALL),
failed AS (SELECT f.doc_id, f.text, f.lang, string_agg(DISTINCT c.measure, ',' ORDER BY c.measure) AS rules FROM f JOIN best c ON f.lang IS NOT DISTINCT FROM c.lang AND {value} > c.cutoff GROUP BY ALL)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rules IS NULL AS kept, concat_ws(',', CASE WHEN base_failed THEN 'base' END, rules) AS failed_rules
FROM f LEFT JOIN failed x ON f.doc_id = x.doc_id AND f.text IS NOT DISTINCT FROM x.text AND f.lang IS NOT DISTINCT FROM x.lang
"""


ORACLE = _oracle()
