"""Exact substring dedup with suffix automata of reference shards.

A window is ``window`` consecutive words of one document.  A word is removed if
a window over it also starts in a document with a smaller id.

Every document is reference for those with larger ids, so the reference is the
corpus itself: broadcasting each shard's automaton to every task would cost
shards x documents.  The corpus is routed instead, so that a shard's automata
meet just the text that can match them: each window belongs to the smallest
hash (anchor) among its ``gram``-word pieces, consecutive windows with one
anchor form a segment, and a segment goes to the shard of its anchor.  Equal
windows have equal anchors, so a shard's automata see every occurrence.  In a
shard the reference segments are added to a word-level suffix automaton by
ascending id, and each segment is streamed against the automaton of the smaller
ids: the spans whose matching statistics are ``window`` or more are removed.
Nothing else decides what is removed.

Hot groups: within a slice of input a segment's text travels once, with the
places of all its occurrences, so a passage held by a third of all documents
costs one text per slice.  Anchors that many documents hold (found on a sample;
this changes the routing only, never the result) are routed window by window.
The number of shards, buckets and tasks follows from the bytes of the input.

A span comes back to its row by the id and a tag of the text's hash, which
splits rows that repeat an id, and is applied only where the words at its place
have the span's hash: whether words go depends on the id and the words alone,
so a span that fits another row of the same id is right for that row too.

Nulls: a null text has no words; a row with a null id is neither a reference
nor changed.  Rows that repeat an id are one document: they remove nothing of
each other.  Rows that are equal are each answered.  An empty table gives no
rows.  A very long text is a slice of its own.  Other columns of the input are not read.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .frames import documents, parts_for, plan_bytes, spread

WINDOW, GRAM = 13, 4
#: Parquet bytes of input per shard: bounds what one automaton task holds.
SHARD_BYTES = 8 << 20
#: Bytes that travel with the documents for a byte of input, spans included.
JOINED = 2.0
#: Documents looked at for hot anchors (1 of so many), the share of them that makes an anchor hot, and how many are kept.
HOT_EVERY, HOT_SHARE, HOT_MAX = 64, 0.004, 4096
#: Compression of what travels: zstd level, and the size and sample (pieces of so many characters) of its dictionary.
LEVEL, DICTIONARY_BYTES, PIECES, PIECE = 6, 1 << 17, 2000, 2048

_RANGES = pa.schema([("doc", pa.int64()), ("tag", pa.int32()), ("ranges", pa.binary())])
_SPAN = np.dtype([("start", "<i4"), ("n", "<i4"), ("hash", "<u8")])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


class SuffixAutomaton:
    """Suffix automaton over sequences of hashable symbols; several sequences may be added."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, seq) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in seq:
            q = nxt[last].get(c)
            if q is not None:  # the symbol is there already: generalised automaton
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, c, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = cur

    def _clone(self, p: int, c, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def matching(self, seq) -> list[int]:
        """Length of the longest known factor that ends at each symbol."""
        nxt, link, length = self.next, self.link, self.length
        at, n, out = 0, 0, []
        for c in seq:
            while c not in nxt[at] and at:
                at = link[at]
                n = length[at]
            if c in nxt[at]:
                at = nxt[at][c]
                n += 1
            out.append(n)
        return out


def anchors(words: tc.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, its anchor, window hash) for the windows of a slice."""
    h = words.hashes()
    at, whole = words.windows(h, window)
    if not len(at):
        return at, whole, whole
    g = np.full(len(h), np.uint64(2**64 - 1))
    starts, small = words.windows(h, gram)
    g[starts] = small
    n = len(h) - window + 1
    least = g[:n].copy()
    for j in range(1, window - gram + 1):
        np.minimum(least, g[j : j + n], out=least)
    return at, least[at], whole


def segments(words: tc.Words, window: int, gram: int, hot: np.ndarray):
    """(anchor, first word, number of words) of every segment; hot anchors give one per window."""
    at, least, whole = anchors(words, window, gram)
    if not len(at):
        return least, at, at
    split = np.zeros(len(at), bool)
    if len(hot):
        i = np.minimum(np.searchsorted(hot, least), len(hot) - 1)
        split = hot[i] == least
        least = np.where(split, whole, least)
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1) | split[1:] | split[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    return least[first], at[first], count + window - 1


def dictionary(rows: DataFrame) -> bytes:
    """A zstd dictionary from pieces of a sample: blobs shrink with the number of shards, and small ones compress badly alone.

    It changes the bytes that travel, never the result; without enough pieces there is none.
    """
    sample = rows.where(F.pmod(F.xxhash64(F.lit("hot"), "doc_id"), F.lit(HOT_EVERY)) == 0)
    pieces = sample.select("doc_id", F.substring("text", 1, PIECE).alias("piece")).orderBy(F.xxhash64("doc_id"), "piece").limit(PIECES).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r["piece"].encode() for r in pieces if r["piece"]]).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def _codec(words: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    known = zstandard.ZstdCompressionDict(words) if words else None
    return zstandard.ZstdCompressor(LEVEL, dict_data=known), zstandard.ZstdDecompressor(dict_data=known)


_OWN = (("anchor", np.uint32), ("doc", np.int64), ("tag", np.uint16), ("start", np.int32))
_REST = (("doc", np.int64), ("tag", np.uint16), ("start", np.int32), ("entry", np.int64))
_FOUND = (("doc", np.int64), ("tag", np.uint16), ("start", np.int32), ("n", np.int32), ("hash", np.uint64))


def _pack(codec, *parts) -> bytes:
    """One compressed blob of column groups and byte strings; ``doc`` and ``entry`` travel as differences."""
    out = []
    for part in parts:
        if isinstance(part, list):
            out.append(b"\n".join(part))
            continue
        layout, columns = part
        out.append(struct.pack("<i", len(columns[0])))
        out += [(np.diff(c, prepend=0) if name in ("doc", "entry") else c).astype(kind).tobytes() for (name, kind), c in zip(layout, columns, strict=True)]
    return codec[0].compress(b"".join(out))


def _unpack(codec, blob: bytes, *layouts):
    """The column groups of a blob and what follows them."""
    raw, at, out = codec[1].decompress(blob), 0, []
    for layout in layouts:
        (n,) = struct.unpack_from("<i", raw, at)
        at += 4
        group = {}
        for name, kind in layout:
            c = np.frombuffer(raw, kind, n, at)
            at += c.nbytes
            group[name] = np.cumsum(c) if name in ("doc", "entry") else c
        out.append(group)
    return out, raw[at:]


def _router(labels: np.ndarray, window: int, gram: int, hot: np.ndarray, words_bc):
    shards = len(labels)
    schema = pa.schema([("shard", pa.int32()), ("blob", pa.binary())])

    def route(batches):
        codec = _codec(words_bc.value)
        for batch in batches:
            texts = tc.column(batch, "text")
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in tc.slices(texts):
                yield from one(codec, texts[lo:hi], ids[lo:hi], tags[lo:hi])

    def one(codec, texts, ids, tags):
        words = tc.Words(texts, tc.PLAIN)
        key, first, n = segments(words, window, gram, hot)
        if not len(key):
            return
        doc = words.doc[first]
        start = first - words.bounds[doc]
        b = words.bytes
        body = [b[s:e] for s, e in zip(words.starts[first].tolist(), words.ends[first + n - 1].tolist(), strict=True)]
        gaps = words.starts[1:] - words.ends[:-1]  # canonical already if single spaces part all words
        odd = (gaps != 1) | (words._raw[np.minimum(words.ends[:-1], len(words._raw) - 1)] != 32)
        odd &= words.doc[1:] == words.doc[:-1]
        if odd.any():
            upto = np.append(0, np.cumsum(odd))
            for i in np.flatnonzero(upto[first + n - 1] - upto[first]).tolist():
                body[i] = b" ".join(body[i].split())
        uid, utag = ids[doc], tags[doc]
        number: dict[bytes, int] = {}
        code = np.fromiter((number.setdefault(x, len(number)) for x in body), np.int64, len(body))
        owner = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(owner, code, uid)
        ship = uid == owner[code]
        place = np.zeros(len(number), np.int64)
        shard = (key % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((first, ~ship, shard))
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        out_shard, out_blob = [], []
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            o = order[cuts[s] : cuts[s + 1]]
            own, rest = o[ship[o]], o[~ship[o]]
            place[code[own[::-1]]] = np.arange(len(own))[::-1]
            out_shard.append(int(labels[s]))
            out_blob.append(_pack(codec, (_OWN, (key[own] >> np.uint64(32), uid[own], utag[own], start[own])), (_REST, (uid[rest], utag[rest], start[rest], place[code[rest]])), [body[i] for i in own.tolist()]))
        yield pa.RecordBatch.from_arrays([pa.array(out_shard, pa.int32()), pa.array(out_blob, pa.binary())], schema=schema)

    return route


def _runs(ends: list[int], window: int) -> list[tuple[int, int]]:
    """(first word, number of words) of the spans that windows ending at these words cover."""
    out: list[tuple[int, int]] = []
    for e in ends:
        if out and e <= out[-1][0] + out[-1][1]:
            out[-1] = out[-1][0], e + 1 - out[-1][0]
        else:
            out.append((e - window + 1, window))
    return out


def _spans(rows: list[int], doc, body: list[bytes], copied, window: int):
    """(row, of its copies?, first word, number of words, hash) of every span to remove of one anchor's segments, given by ascending id."""
    automaton, i = SuffixAutomaton(), 0

    def statistics(seq):
        return [e for e, m in enumerate(automaton.matching(seq)) if m >= window]

    def told(r, copies, seq, ends):
        for at, n in _runs(ends, window):
            yield r, copies, at, n, xxhash.xxh64_intdigest(b" ".join(seq[at : at + n]))

    while i < len(rows):
        j = i
        while j < len(rows) and doc[rows[j]] == doc[rows[i]]:
            j += 1
        seen: dict[bytes, tuple[list[bytes], list[int]]] = {}
        for r in rows[i:j]:  # a document is streamed against smaller ids before it is added
            if body[r] not in seen:
                seq = body[r].split(b" ")
                seen[body[r]] = seq, statistics(seq)
            yield from told(r, False, *seen[body[r]])
        for seq, ends in seen.values():
            if len(ends) < len(seq) - window + 1:
                automaton.add(seq)
        for r in rows[i:j]:  # the same text under larger ids of the slice
            if copied[r]:
                seq = seen[body[r]][0]
                yield from told(r, True, seq, statistics(seq))
        i = j


def _settle(window: int, labels: np.ndarray, words_bc):
    """The task of a shard: automata over its reference segments.

    Gives the spans of removed words, one blob for each bucket of documents: a
    document meets many shards, so a row for each pair of the two is avoided.
    """

    buckets = len(labels)

    def settle(table: pa.Table) -> pa.Table:
        codec, plain = _codec(words_bc.value), _codec(b"")
        own, rest, body = [], [], []
        for blob in table.column("blob").to_pylist():
            (o, c), texts = _unpack(codec, blob, _OWN, _REST)
            c["entry"] = c["entry"] + len(body)
            own.append(o), rest.append(c)
            body += texts.split(b"\n") if len(o["doc"]) else []
        own, rest = ({k: np.concatenate([x[k] for x in parts]) for k in parts[0]} for parts in (own, rest))
        by_entry = np.argsort(rest["entry"], kind="stable")
        copies = np.searchsorted(rest["entry"][by_entry], np.arange(len(body) + 1))
        copied = np.diff(copies) > 0
        order = np.lexsort((own["doc"], own["anchor"]))
        anchor, doc = own["anchor"][order], own["doc"][order]
        cuts = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(order))
        met = (doc[cuts[:-1]] != doc[cuts[1:] - 1]) | np.logical_or.reduceat(copied[order], cuts[:-1])
        found = [x for g in np.flatnonzero(met).tolist() for x in _spans(order[cuts[g] : cuts[g + 1]].tolist(), own["doc"], body, copied, window)]
        row, copy, at, n, digest = (np.array([x[i] for x in found], kind) for i, kind in enumerate((np.int64, bool, np.int32, np.int32, np.uint64)))
        size = np.where(copy, (copies[1:] - copies[:-1])[row], 1) if len(row) else np.zeros(0, np.int64)
        which = np.repeat(np.arange(len(row)), size)  # each span once for each place that has it
        nth = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        as_copy = copy[which]
        at_rest = by_entry[np.where(as_copy, copies[row[which]] + nth, 0)] if len(by_entry) else np.zeros(len(which), np.int64)
        pick = lambda k: np.where(as_copy, rest[k][at_rest], own[k][row[which]]) if len(by_entry) else own[k][row[which]]
        out = dict(doc=pick("doc"), tag=pick("tag"), start=pick("start") + at[which], n=n[which], hash=digest[which])
        bucket = (tc.mix(out["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((out["start"], out["tag"], out["doc"], bucket))
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts)).tolist()
        blobs = [_pack(plain, (_FOUND, [out[k][o] for k, _ in _FOUND])) for o in (order[cuts[x] : cuts[x + 1]] for x in full)]
        return pa.table([pa.array(labels[full], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return settle


def _gather(table: pa.Table) -> pa.Table:
    """All spans of each document of a bucket."""
    plain = _codec(b"")
    parts = [_unpack(plain, x, _FOUND)[0][0] for x in table.column("blob").to_pylist()]
    all_ = {k: np.concatenate([p[k] for p in parts]) for k, _ in _FOUND}
    order = np.lexsort((all_["start"], all_["tag"], all_["doc"]))
    docs, tags = all_["doc"][order], all_["tag"][order]
    spans = np.zeros(len(order), _SPAN)
    for k in _SPAN.names:
        spans[k] = all_[k][order]
    cuts = np.append(np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1]))), len(docs))
    ranges = [spans[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return pa.table([pa.array(docs[cuts[:-1]], pa.int64()), pa.array(tags[cuts[:-1]].astype(np.int32)), pa.array(ranges, pa.binary())], schema=_RANGES)


def _fitting(words: tc.Words, i: int, spans: np.ndarray) -> np.ndarray:
    """The (start, number) of the spans whose words stand in text i of a slice; others are of another row of its id."""
    a, n = int(words.bounds[i]), int(words.counts[i])
    out = []
    for at, k, digest in spans.tolist():
        if at + k <= n:
            body = words.bytes[words.starts[a + at] : words.ends[a + at + k - 1]]
            if xxhash.xxh64_intdigest(body) == digest or xxhash.xxh64_intdigest(b" ".join(body.split())) == digest:
                out.append((at, k))
    return np.array(out, np.int32).reshape(-1, 2)


def _remove(batches):
    for batch in batches:
        texts = tc.column(batch, "text")
        ids, ranges = batch.column(0), batch.column(2)
        for lo, hi in tc.slices(texts):
            words = tc.Words(texts[lo:hi], tc.PLAIN)
            out = {"n_removed": [], "kept_text": [], "removed_spans": []}
            for i in range(hi - lo):
                a, n = int(words.bounds[i]), int(words.counts[i])
                got = ranges[lo + i].as_py()
                if not got:
                    out["n_removed"].append(0), out["removed_spans"].append([])
                    out["kept_text"].append(b" ".join(words.texts(a, a + n)))
                    continue
                pairs = _fitting(words, i, np.frombuffer(got, _SPAN))
                d = np.zeros(n + 1, np.int32)
                np.add.at(d, pairs[:, 0], 1)
                np.add.at(d, pairs[:, 0] + pairs[:, 1], -1)
                gone = np.cumsum(d[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                out["n_removed"].append(int(gone.sum()))
                out["removed_spans"].append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
                w = words.texts(a, a + n)
                out["kept_text"].append(b" ".join([w[k] for k in np.flatnonzero(~gone).tolist()]))
            kept = pa.array(out["kept_text"], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(words.counts.astype(np.int64)), pa.array(out["n_removed"], pa.int64()), kept, pa.array(out["removed_spans"], _KEPT.field("removed_spans").type)], schema=_KEPT)


def hot_anchors(rows: DataFrame, window: int, gram: int) -> np.ndarray:
    """Sorted anchors that a large share of a sample's documents hold, HOT_MAX at most."""

    def count(batches):
        for batch in batches:
            texts = tc.column(batch, "text")
            for lo, hi in tc.slices(texts):
                words = tc.Words(texts[lo:hi], tc.PLAIN)
                at, least, _ = anchors(words, window, gram)
                if len(at):
                    pairs = np.unique(np.stack([words.doc[at].astype(np.uint64), least], 1), axis=0)
                    key, n = np.unique(pairs[:, 1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    sample = rows.where(F.pmod(F.xxhash64(F.lit("hot"), "doc_id"), F.lit(HOT_EVERY)) == 0)
    n = sample.count()
    found = sample.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(16, HOT_SHARE * n)).orderBy(F.desc("n"), "key").limit(HOT_MAX).collect()
    return np.sort(np.array([r["key"] for r in found], np.int64).view(np.uint64))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, shards: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text, removed_spans (word ranges)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.shiftrightunsigned(F.xxhash64(F.col(text_col)), 48).cast("int").alias("tag"), F.col(text_col).alias("text"))
    known = rows.where("doc_id is not null and text is not null")
    size = plan_bytes(docs, text_col)
    shards = shards or parts_for(docs, size, SHARD_BYTES)
    joined = parts_for(docs, size * JOINED)
    hot = hot_anchors(known, window, gram)
    words = docs.sparkSession.sparkContext.broadcast(dictionary(known))
    ranges = (
        known.mapInArrow(_router(spread(shards, shards), window, gram, hot, words), "shard int, blob binary")
        .repartition(shards, "shard").groupBy("shard").applyInArrow(_settle(window, spread(joined, joined), words), "bucket int, blob binary")
        .repartition(joined, "bucket").groupBy("bucket").applyInArrow(_gather, "doc long, tag int, ranges binary")
    )
    texts = rows.repartition(joined, "doc_id", "tag")
    found = ranges.select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), "ranges").repartition(joined, "__doc", "__tag")
    both = texts.join(found, (F.col("doc_id") == F.col("__doc")) & (F.col("tag") == F.col("__tag")), "left").select("doc_id", "text", "ranges")
    return both.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_text string, removed_spans array<struct<start:int,end:int>>")


def op1_substring_dedup(spark, sf_dir):
    out = substring_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("removed_spans").cast("long").alias("n_spans"))


#: The same in plain SQL: every window with the smallest id that has it.
ORACLE = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
o AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS body FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY body) AS least FROM o) WHERE least < doc_id),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {WINDOW - 1})) AS p FROM f),
n AS (SELECT g.doc_id, count(*) AS n_removed, count(*) FILTER (b.p IS NULL) AS n_spans FROM g LEFT JOIN g b ON g.doc_id = b.doc_id AND g.p = b.p + 1 GROUP BY g.doc_id),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d) ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
