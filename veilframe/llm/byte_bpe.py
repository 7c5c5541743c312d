"""Byte-level BPE encoding and decoding by DuckDB queries in each partition.

The merge table holds every pair of tokens whose bytes together are a token.
A slice's distinct words (matches of the split pattern) that are not tokens
themselves enter a recursive query, which unnests them to token-position rows,
joins neighbours with the merge table and contracts each word's leftmost pair
of minimum rank, until no word has a pair left.  Decoding joins ids with the vocabulary
and aggregates their bytes in order.

One contraction a step makes a word of n bytes cost about n**2 / 2 rows, so a
word above ``LONG_WORD`` bytes is contracted in the same order with a heap
(n log n) instead; the result is the same.  Words already encoded are
remembered, about ``REMEMBERED`` of them in a worker.  Texts are handled in bounded slices, each text whole.

The rank file is read by the driver (a vocabulary is fixed and small) and
broadcast.  Nulls: a null text encodes as empty; a null id is kept.  Repeated
rows are each answered.  An empty table gives no rows.  A very long text is a
slice of its own.  An unknown id makes decoding fail.  Other columns are not
read.
"""

from __future__ import annotations

import base64
import heapq
import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .frames import documents

RANKS_FILE = "byte_bpe_multi_50k.tiktoken"
LONG_WORD, REMEMBERED = 192, 200_000
SLICE = 1 << 20

_ENCODE = """
WITH RECURSIVE s(step, word, toks) AS (
  SELECT 0::INT, word, toks FROM start
  UNION ALL
  SELECT step + 1, s.word, s.toks[:b.pos] || [b.id] || s.toks[b.pos + 3:]
  FROM s JOIN (
    SELECT word, (min(m.id * 1024 + p.pos) % 1024)::INT AS pos, (min(m.id * 1024 + p.pos) // 1024)::INT AS id
    FROM (SELECT word, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, unnest(range(len(toks) - 1)) AS pos FROM s WHERE len(toks) > 1) p
    JOIN merges m ON p.l = m.l AND p.r = m.r
    GROUP BY word
  ) b ON s.word = b.word
)
SELECT s.word, s.toks FROM s JOIN (SELECT word, max(step) AS step FROM s GROUP BY word) e ON s.word = e.word AND s.step = e.step ORDER BY s.word
"""
_DECODE = "SELECT doc, unhex(string_agg(v.hex, '' ORDER BY t.pos)) AS body FROM tokens t JOIN vocab v ON t.tok = v.id GROUP BY doc ORDER BY doc"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Places(dict):
    """Word -> its number; words met for the first time are listed in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": os.environ.get("TMPDIR", "/tmp")})
        left, right, out = [], [], []
        for body, rank in ranks.items():
            for i in range(1, len(body)):
                a, b = ranks.get(body[:i]), ranks.get(body[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), out.append(rank)
        merges = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "id": pa.array(out, pa.int64())})
        vocab = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": pa.array([x.hex() for x in ranks])})
        self.db.register("m_in", merges), self.db.register("v_in", vocab)
        self.db.execute("CREATE TABLE merges AS FROM m_in"), self.db.execute("CREATE TABLE vocab AS FROM v_in")
        self.known = set(ranks.values())
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.clear()

    def clear(self) -> None:
        self.place = _Places()
        self.ids: list[np.ndarray] = []
        self.offsets = np.zeros(1, np.int64)

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words that are not tokens themselves, all in one array, and each word's number of them, by the recursive query."""
        sizes = np.zeros(len(words), np.int64)
        short = np.array([i for i, w in enumerate(words) if len(w) <= LONG_WORD], np.int64)
        flat = np.zeros(0, np.int32)
        if len(short):
            data = np.frombuffer(b"".join(words[i] for i in short.tolist()), np.uint8)
            first = np.append(0, np.cumsum([len(words[i]) for i in short.tolist()])).astype(np.int32)
            start = pa.table({"word": pa.array(np.arange(len(short), dtype=np.int32)), "toks": pa.ListArray.from_arrays(pa.array(first), pa.array(self.byte_ids[data]))})
            self.db.register("start", start)
            toks = self.db.sql(_ENCODE).to_arrow_table()["toks"].combine_chunks()
            flat, sizes[short] = toks.flatten().to_numpy().astype(np.int32), toks.value_lengths().to_numpy()
        if len(short) < len(words):
            parts, at = [], 0
            for i, w in enumerate(words):
                parts.append(flat[at : at + sizes[i]] if len(w) <= LONG_WORD else self.by_heap(w))
                at += sizes[i]
                sizes[i] = len(parts[-1])
            flat = np.concatenate(parts)
        return flat, sizes

    def by_heap(self, word: bytes) -> np.ndarray:
        """The same contraction order for one long word."""
        ranks, n = self.ranks, len(word)
        start, end = list(range(n)), list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or end[j] != stop:
                continue  # one of its tokens is part of another by now
            end[i], alive[j], after[i] = end[j], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if (p := before[i]) >= 0 and (r := ranks.get(word[start[p] : end[i]])) is not None:
                heapq.heappush(heap, (r, p, end[i]))
            if (q := after[i]) >= 0 and (r := ranks.get(word[start[i] : end[q]])) is not None:
                heapq.heappush(heap, (r, i, end[q]))
        return np.array([ranks[word[start[i] : end[i]]] for i in range(n) if alive[i]], np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and each text's end in it."""
        parts = [self.split(t) for t in texts]
        if len(self.place) > REMEMBERED:
            self.clear()
        place = self.place
        counts = np.array([len(p) for p in parts], np.int64)
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        new, place.new = place.new, []
        if new:
            bodies = [w.encode() for w in new]
            direct = [self.ranks.get(b) for b in bodies]
            hard = [i for i, d in enumerate(direct) if d is None]
            ids, sizes = self.contract([bodies[i] for i in hard]) if hard else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            size = np.ones(len(new), np.int64)
            size[hard] = sizes
            first = np.cumsum(size) - size
            add = np.zeros(int(size.sum()), np.int32)
            add[first] = [d or 0 for d in direct]
            add[np.repeat(first[hard] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(ids))] = ids
            self.ids.append(add)
            self.offsets = np.append(self.offsets, self.offsets[-1] + np.cumsum(size))
            self.ids = [np.concatenate(self.ids)]
        size = self.offsets[at + 1] - self.offsets[at]
        ends = np.append(0, np.cumsum(size))
        flat = np.repeat(self.offsets[at] - ends[:-1], size) + np.arange(ends[-1])
        ids = self.ids[0][flat] if len(flat) else np.zeros(0, np.int32)
        return ids, ends[np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Bytes of each id sequence, by ordered aggregation."""
        sizes = np.diff(ends, prepend=0)
        out = [b""] * len(ends)
        if len(ids):
            if not self.known.issuperset(np.unique(ids).tolist()):
                raise ValueError("an id is not in the vocabulary")
            tokens = pa.table({"doc": pa.array(np.repeat(np.arange(len(ends), dtype=np.int32), sizes)), "pos": pa.array(np.arange(len(ids), dtype=np.int32)), "tok": pa.array(ids.astype(np.int32))})
            self.db.register("tokens", tokens)
            got = self.db.sql(_DECODE).to_arrow_table()
            for d, body in zip(got["doc"].to_pylist(), got["body"].to_pylist(), strict=True):
                out[d] = body
        return out


_codecs: dict[int, Codec] = {}


def _codec(bc) -> Codec:
    """The worker's codec for a broadcast vocabulary."""
    if bc.id not in _codecs:
        _codecs.clear()
        _codecs[bc.id] = Codec(*bc.value)
    return _codecs[bc.id]


class _Shared:
    """A broadcast with a number, so that a worker knows which codec it has made."""

    def __init__(self, spark, value):
        self.bc = spark.sparkContext.broadcast(value)
        self.id = hash(self.bc._jbroadcast.id()) if self.bc._jbroadcast is not None else 0

    @property
    def value(self):
        return self.bc.value


def vocabulary(spark, path: str | None = None, pattern: str | None = None) -> _Shared:
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(RANKS_FILE), pattern or public_tokenizers.PATTERN
    return _Shared(spark, (load_ranks(path), pattern))


def encode(docs: DataFrame, vocab: _Shared, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row."""

    def run(batches):
        codec = _codec(vocab)
        for batch in batches:
            texts = tc.column(batch, "text")
            for lo, hi in tc.slices(texts, SLICE):
                ids, ends = codec.encode(texts[lo:hi].to_pylist())
                flat = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], flat], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, vocab: _Shared, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and the decoded bytes of every row (null ids: empty)."""

    def run(batches):
        codec = _codec(vocab)
        for batch in batches:
            ids = batch.column(1)
            sizes = np.array([0 if x is None else x for x in pa.compute.list_value_length(ids).to_pylist()], np.int64)
            ends = np.cumsum(sizes)
            lo = 0
            while lo < len(ids):
                base = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, base + SLICE // 4, "right")))
                flat = ids[lo:hi].flatten().to_numpy(zero_copy_only=False)
                body = codec.decode(flat, ends[lo:hi] - base)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], ids[lo:hi], pa.array(body, pa.binary())], names=["doc_id", "ids", "decoded"])
                lo = hi

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def transcode(docs: DataFrame, vocab: _Shared, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and the bytes that the ids decode to, in one pass over the texts."""

    def run(batches):
        codec = _codec(vocab)
        for batch in batches:
            texts = tc.column(batch, "text")
            for lo, hi in tc.slices(texts, SLICE):
                ids, ends = codec.encode(texts[lo:hi].to_pylist())
                flat = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
                body = pa.array(codec.decode(ids, ends), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(ends, prepend=0).astype(np.int64)), flat, body], names=["doc_id", "n_tokens", "ids", "decoded"])
            pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, vocab: _Shared, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and whether the decoded bytes are the text's (null: empty), in one pass."""

    def run(batches):
        codec = _codec(vocab)
        for batch in batches:
            texts = tc.column(batch, "text")
            for lo, hi in tc.slices(texts, SLICE):
                part = texts[lo:hi].to_pylist()
                ids, ends = codec.encode(part)
                same = [a == b.encode() for a, b in zip(codec.decode(ids, ends), part, strict=True)]
                flat = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(ends, prepend=0).astype(np.int64)), flat, pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "round_trip"])
            pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def op4_byte_bpe(spark, sf_dir):
    out = transcode(documents(spark, sf_dir), vocabulary(spark))
    return out.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
