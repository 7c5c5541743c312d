"""Benchmark decontamination by a broadcast hash set of benchmark n-grams.

Words are runs of a-z, 0-9 and non-ASCII characters after A-Z are lower-cased.
Each benchmark item gives its windows of ``window`` consecutive words; an item
of fewer words, but not none, is one window.  The hashes of all windows are
broadcast; documents are scanned window by window, hits are verified on the
words themselves, and every document word inside a verified occurrence is hit.

What is broadcast is the items' text once, and for each distinct window its
hash, its place in that text and its items: some six times the text.  The
benchmark is measured first and taken in parts of at most ``PART_BYTES`` of
text.  One part, the usual case, is one pass over the documents.  Of more, each
is a pass over a written table with what the earlier ones found, so one part
and one Python worker a task are held at a time, however large the benchmark is.

Nulls: a null text has no words and no hits; a null item text gives no window;
items with a null id are ignored.  Repeated items count once by id; rows that
repeat a document are each answered.  Without documents there are no rows,
without items no hits.  A very long text is scanned whole, in a slice of its
own.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped
from . import textcore as tc
from .frames import documents, written

WINDOW = 10
#: Benchmark text in one broadcast part.
PART_BYTES = 4 << 20

_STATE = "doc_id long, text string, hits binary, items array<string>"
_OUT = "doc_id long, n_words long, n_hit long, items array<string>, hit_spans array<struct<start:int,end:int>>, clean_text string"


@dataclass
class Grams:
    """The distinct windows of one length, by hash: place in the part's text, and bounds of each one's items in ``owners``."""

    size: int
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    owners: np.ndarray


@dataclass
class Part:
    """Items of a benchmark: their words joined by spaces, their ids, and their windows by length."""

    text: bytes
    items: list[str]
    grams: list[Grams]


def _distinct(size: int, text: bytes, found: list[tuple[np.ndarray, ...]]) -> Grams:
    """Windows (hash, start, end, item) merged where their words are equal; equal hashes of other words stay apart."""
    h, start, end, item = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((item, h))
    h, start, end, item = h[order], start[order], end[order], item[order]
    new = np.append(True, h[1:] != h[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    group = first.copy()
    for i in np.flatnonzero(~new).tolist():
        body = text[start[i] : end[i]]
        if text[start[first[i]] : end[first[i]]] != body:  # two windows of one hash
            group[i] = next((j for j in range(first[i] + 1, i) if text[start[j] : end[j]] == body), i)
    heads = np.unique(group)
    pairs = np.unique(np.stack([np.searchsorted(heads, group), item], 1), axis=0)
    return Grams(size, h[heads], start[heads], end[heads], np.searchsorted(pairs[:, 0], np.arange(len(heads) + 1)), pairs[:, 1].astype(np.int32))


def _part(rows: list[tuple[str, str]], window: int) -> Part:
    items = sorted({item for item, _ in rows})
    number = {item: i for i, item in enumerate(items)}
    found: dict[int, list] = {}
    lines, at = [], 0
    for item, text in rows:
        words = tc.Words(pa.array([text], pa.large_string()), tc.ALNUM_LOWER)
        n = len(words)
        if not n:
            continue
        k = min(n, window)
        first, h = words.windows(words.hashes(), k)
        ends = at + np.cumsum(words.ends - words.starts + 1) - 1
        starts = np.append(at, ends[:-1] + 1)
        found.setdefault(k, []).append((h, starts[first].astype(np.int32), ends[first + k - 1].astype(np.int32), np.full(len(first), number[item], np.int64)))
        lines.append(b" ".join(words.texts(0, n)))
        at += len(lines[-1]) + 1
    text = b" ".join(lines)
    return Part(text, items, [_distinct(k, text, found[k]) for k in sorted(found)])


def _parts(benchmark: DataFrame, item_col: str, text_col: str, window: int, part_bytes: int):
    """The benchmark's windows, part by part; each part is collected on its own."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 2 * (total // part_bytes) + 1
    for p in range(n):
        rows = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == p)
        part = _part([(r["item"], r["text"]) for r in rows.toLocalIterator()], window)
        if part.grams:
            yield part


def _hits(words: tc.Words, part: Part) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
    """Verified (first word, words) occurrences and items of each text of a slice that has any."""
    spans: dict[int, list[tuple[int, int]]] = {}
    seen: dict[int, set[tuple[int, int]]] = {}
    h = words.hashes()
    for number, g in enumerate(part.grams):
        at, x = words.windows(h, g.size)
        first = np.minimum(np.searchsorted(g.hashes, x), len(g.hashes) - 1)
        maybe = np.flatnonzero(g.hashes[first] == x)
        for a, j in zip(at[maybe].tolist(), first[maybe].tolist(), strict=True):
            body = b" ".join(words.texts(a, a + g.size))
            while part.text[g.start[j] : g.end[j]] != body and j + 1 < len(g.hashes) and g.hashes[j + 1] == g.hashes[j]:  # another window of this hash
                j += 1
            if part.text[g.start[j] : g.end[j]] == body:
                d = int(words.doc[a])
                spans.setdefault(d, []).append((a - int(words.bounds[d]), g.size))
                seen.setdefault(d, set()).add((number, j))
    items = {d: {part.items[o] for number, j in pairs for o in part.grams[number].owners[part.grams[number].bounds[j] : part.grams[number].bounds[j + 1]].tolist()} for d, pairs in seen.items()}
    return spans, items


def _scan(bc, last: bool):
    """One pass: what this part adds to the hits and items of each document; the last one also gives the result."""

    def scan(batches):
        for batch in batches:
            texts = tc.column(batch, "text")
            for lo, hi in tc.slices(texts):
                words = tc.Words(texts[lo:hi], tc.ALNUM_LOWER)
                spans, found = _hits(words, bc.value) if bc is not None else ({}, {})
                hits, names = [], []
                for i in range(hi - lo):
                    old = batch.column(2)[lo + i].as_py() or b""
                    hits.append(old + np.array(spans[i], np.int32).tobytes() if i in spans else old)
                    had = batch.column(3)[lo + i].as_py() or []
                    names.append(sorted(found[i].union(had)) if i in found else had)
                ids, text = batch.column(0)[lo:hi], batch.column(1)[lo:hi]
                if last:
                    yield _result(ids, text, texts[lo:hi], words, hits, names)
                else:
                    yield pa.RecordBatch.from_arrays([ids, text, pa.array(hits, pa.binary()), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "text", "hits", "items"])

    return scan


def _result(ids: pa.Array, given: pa.Array, texts: pa.Array, words: tc.Words, hits: list[bytes], names: list[list[str]]) -> pa.RecordBatch:
    n_hit, spans, clean = [], [], []
    for i, raw in enumerate(hits):
        if not raw:
            n_hit.append(0), spans.append([]), clean.append(given[i].as_py())
            continue
        a, n = int(words.bounds[i]), int(words.counts[i])
        pairs = np.frombuffer(raw, np.int32).reshape(-1, 2)
        d = np.zeros(n + 1, np.int32)
        np.add.at(d, pairs[:, 0], 1)
        np.add.at(d, pairs[:, 0] + pairs[:, 1], -1)
        hit = np.cumsum(d[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
        n_hit.append(int(hit.sum())), spans.append([{"start": s, "end": e} for s, e in edge])
        body, at, kept, base = texts[i].as_py().encode(), 0, [], int(words.offsets[i])
        for s, e in edge:
            kept.append(body[at : int(words.starts[a + s]) - base])
            at = int(words.ends[a + e - 1]) - base
        clean.append((b"".join(kept) + body[at:]).decode())
    columns = [ids, pa.array(words.counts.astype(np.int64)), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(clean, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "items", "hit_spans", "clean_text"])


def _passes(rows: DataFrame, parts, step, final):
    """``step`` for every part but the last, each written before the next; ``final`` for the last (None without parts)."""
    sc, part, table = rows.sparkSession.sparkContext, next(parts, None), None
    while part is not None and (following := next(parts, None)) is not None:
        bc = sc.broadcast(part)
        rows, before = written(step(rows, bc), "decontamination"), table
        bc.destroy()
        if before is not None:
            dropped(before)
        part, table = following, rows
    return final(rows, sc.broadcast(part) if part is not None else None)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items, hit_spans (word ranges), clean_text (without the hit spans)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(None).cast("binary").alias("hits"), F.array().cast("array<string>").alias("items"))
    parts = _parts(benchmark, item_col, item_text_col, window, part_bytes)
    return _passes(rows, parts, lambda df, bc: df.mapInArrow(_scan(bc, False), _STATE), lambda df, bc: df.mapInArrow(_scan(bc, True), _OUT))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents without a verified hit, with the columns they have; no text is shuffled."""

    def clean(df, bc):
        if bc is None:
            return df

        def run(batches):
            for batch in batches:
                texts, kept = tc.column(batch, text_col), []
                for lo, hi in tc.slices(texts):
                    hit, _ = _hits(tc.Words(texts[lo:hi], tc.ALNUM_LOWER), bc.value)
                    kept += [i for i in range(lo, hi) if i - lo not in hit]
                yield batch.take(pa.array(kept, pa.int64()))

        return df.mapInArrow(run, docs.schema)

    return _passes(docs, _parts(benchmark, item_col, item_text_col, window, part_bytes), clean, clean)


def op2_benchmark_decontamination(spark, sf_dir):
    out = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same in plain SQL: every window of every document against the items' windows.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS body FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM g),
o AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS body FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT o.doc_id, o.i, o.k, g.item FROM o JOIN g USING (k, body)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
