"""SimHash near-dedup over a byte-position inverted index.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes (seed 42)
of a text's four-word shingles.  Two fingerprints link at ``DISTANCE`` or fewer
differing bits; those touch at most four of the eight bytes, so linked
fingerprints agree in at least ``MATCHES`` = 4 byte positions.

Index: a posting list holds the fingerprints with given bytes at given
positions.  One-byte lists would hold N / 256 fingerprints each, and their
pairs grow with the square of N; so lists are keyed by three positions at once,
for 20 position sets such that any four positions contain one of them.  Every
pair with the guaranteed matches therefore meets in a list.  Inside a list the
shared positional bytes of two fingerprints are tallied, pairs below four are
dropped, and the rest are verified by their bits.

Hot groups: equal fingerprints are merged first.  A list is searched breadth
first: a fingerprint is held only against those not yet reached, and gives one
edge to its component's smallest, so a list of m near copies gives m edges and
not their pairs.  Lists that a sample shows to be hot are split by one more
position, and those parts again; where four positions are the list's already,
each fingerprint also goes to the eight parts one bit away, because a linked
pair without a fifth byte in common has one differing bit in each other byte.
A list of five positions has 2**24 fingerprints at most.  A long list is split
the same way inside its task.  Components are found by alternating star
contraction on edges, with a written table in the shared folder after each
round, until nothing changes; joins (whose large keys adaptive execution splits)
and partial sums only, no list of a vertex's edges.  Joins on a key that many
rows may share, a copied fingerprint or a large component's root, go through
``join_by_key``.

Nulls: a null text has no words (fingerprint zero, linked like any other).  A
null id takes part and never names a component unless nothing else does.
Repeated rows are each answered.  An empty table gives no rows.  A very long
text is fingerprinted whole, in a slice of its own.  Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .frames import documents, join_by_key, shuffle_partitions, spread, written

SHINGLE, SEED, DISTANCE, MATCHES = 4, 42, 4, 4
#: Bytes of text whose shingles are hashed at once; a longer single text is whole.
SLICE = 1 << 20
#: One of so many fingerprints is looked at for hot lists; a list with this many of the sample is split; so many lists
#: a pass, the largest first: any other holds less than one in so many of the entries.
HOT_EVERY, HOT_LIST, HOT_MAX = 16, 1024, 4096
#: Entries of a list from which it is split inside its task, after so many steps of the search have not emptied it.
LONG_LIST, STEPS = 2048, 64


def position_sets(size: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any four of the eight contain one."""
    if size == 4:
        return list(combinations(range(8), 4))
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [c for g in groups for c in combinations(g, 3)]
    for i, g in enumerate(groups):
        out += [(*c, x) for c in combinations(g, 2) for x in groups[(i + 1) % 3]]
    return out


def _fingerprints(batches):
    for batch in batches:
        texts = tc.column(batch, "text")
        for lo, hi in tc.slices(texts, SLICE):
            words = tc.Words(texts[lo:hi], tc.PLAIN_LOWER)
            out = np.zeros(hi - lo, np.uint64)
            flat, sizes, owner = [], [], []
            for i in range(hi - lo):
                a, n = int(words.bounds[i]), int(words.counts[i])
                if not n:
                    continue
                w = words.texts(a, a + n)
                k = min(n, SHINGLE)
                line = b" ".join(w)
                ends = np.cumsum([len(x) + 1 for x in w]) - 1
                starts = np.append(0, ends[:-1] + 1)
                flat += [xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
                sizes.append(n - k + 1)
                owner.append(i)
            if flat:
                bits = np.unpackbits(np.array(flat, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                count = np.add.reduceat(bits, np.append(0, np.cumsum(sizes)[:-1]), axis=0, dtype=np.int32)
                one = (2 * count > np.array(sizes)[:, None]).astype(np.uint8)
                out[owner] = np.packbits(one, axis=1, bitorder="little").view(np.uint64).ravel()
            given = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n)[lo:hi] for n in given), pa.array(out.view(np.int64))], names=[*given, "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longs: list[str] | None = None) -> DataFrame:
    """doc_id, the columns ``longs`` and fp (the 64 bits as a signed long) of every row."""
    longs = longs or []
    schema = ", ".join(f"{n} long" for n in ["doc_id", *longs, "fp"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *longs, F.col(text_col).alias("text")).mapInArrow(_fingerprints, schema)


def _key(byte: np.ndarray, positions: tuple[int, ...]) -> np.ndarray:
    """A list's number: which positions, and the bytes there."""
    key = np.full(len(byte), sum(1 << p for p in positions), np.uint64)
    for p in positions:
        key = (key << np.uint64(8)) | byte[:, p].astype(np.uint64)
    return key << np.uint64(8 * (MATCHES + 1 - len(positions)))


def _positions(key: int) -> tuple[int, ...]:
    return tuple(p for p in range(8) if key >> 8 * (MATCHES + 1) >> p & 1)


def _bytes(fp: np.ndarray) -> np.ndarray:
    return fp[:, None].view(np.uint8)  # little endian: byte p is bits 8p..8p+7


def _finer(fp: np.ndarray, positions: tuple[int, ...]) -> list[tuple[tuple[int, ...], np.ndarray, np.ndarray]]:
    """(positions, list keys, fingerprints) of the parts of a list, of which every linked pair has one in common."""
    byte = _bytes(fp)
    others = [p for p in range(8) if p not in positions]
    more = {p: tuple(sorted((*positions, p))) for p in others}
    out = [(more[p], _key(byte, more[p]), fp) for p in others]
    if len(positions) == MATCHES:  # a pair that agrees in no other byte has one bit of each of them
        for bit in range(8):
            turned = byte.copy()
            turned[:, others[0]] ^= np.uint8(1 << bit)
            out.append((more[others[0]], _key(turned, more[others[0]]), fp))
    return out


def postings(fp: np.ndarray, sets: list[tuple[int, ...]], hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list key, fingerprint) of every entry; a hot list's entries go to finer lists instead."""
    keys, fps = [], []
    todo = [(positions, _key(_bytes(fp), positions), fp) for positions in sets]
    while todo:
        positions, key, own = todo.pop()
        if len(hot) and len(positions) <= MATCHES:
            split = np.isin(key, hot)
            if split.any():
                todo += _finer(own[split], positions)
                key, own = key[~split], own[~split]
        keys.append(key)
        fps.append(own)
    return np.concatenate(keys), np.concatenate(fps)


def search(fp: np.ndarray, steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint of a list (sorted, distinct) the smallest one that it reaches, and the places of those that ``steps`` steps left open."""
    root, left, queue = fp.copy(), np.arange(len(fp)), []
    while len(left):
        first, left = left[0], left[1:]
        queue = [first]
        while queue and len(left):
            if steps is not None:
                if not steps:
                    return root, np.append(np.array(queue, np.int64), left)
                steps -= 1
            x = fp[left] ^ fp[queue.pop()]
            same = (_bytes(x) == 0).sum(1, dtype=np.uint8)  # shared positional bytes
            near = same >= MATCHES
            near[near] = np.bitwise_count(x[near]) <= DISTANCE
            if near.any():
                found = left[near]
                root[found] = fp[first]
                queue += found.tolist()
                left = left[~near]
    return root, left


def _groups(key: np.ndarray, fp: np.ndarray):
    """(list key, its distinct fingerprints, ascending) of every list of two or more."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) if len(key) else np.zeros(1, np.int64)
    for g in np.flatnonzero(np.diff(cuts) > 1).tolist():
        yield int(key[cuts[g]]), np.unique(fp[cuts[g] : cuts[g + 1]])


def list_edges(positions: tuple[int, ...], fp: np.ndarray):
    """(a, b) arrays of edges that connect a list's linked fingerprints."""
    long = len(fp) > LONG_LIST and len(positions) <= MATCHES
    root, rest = search(fp, STEPS if long else None)
    moved = root != fp
    yield fp[moved], root[moved]
    if len(rest):
        parts = _finer(fp[rest], positions)
        for key, part in _groups(np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])):
            yield from list_edges(_positions(key), part)


def _edges(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, np.uint64) for x in table.column("entries").to_pylist()]
    pairs = np.concatenate(parts).reshape(-1, 2) if parts else np.zeros((0, 2), np.uint64)
    found = [x for key, fp in _groups(pairs[:, 0], pairs[:, 1]) for x in list_edges(_positions(key), fp)]
    edges = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)], 1), axis=0) if found else np.zeros((0, 2), np.uint64)
    return pa.table([pa.array(edges[:, 0].copy().view(np.int64)), pa.array(edges[:, 1].copy().view(np.int64))], names=["a", "b"])


def hot_lists(distinct: DataFrame, sets: list[tuple[int, ...]]) -> np.ndarray:
    """Keys of the lists to split, found on a sample; then those of their parts that are hot still."""
    sample = distinct.where(F.pmod(F.xxhash64(F.lit("hot"), "fp"), F.lit(HOT_EVERY)) == 0).select("fp")
    hot = np.zeros(0, np.uint64)

    def count(batches):
        for batch in batches:
            k, c = np.unique(postings(batch.column(0).to_numpy().view(np.uint64), sets, hot)[0], return_counts=True)
            splits = np.bitwise_count(k >> np.uint64(8 * (MATCHES + 1))) <= MATCHES
            yield pa.RecordBatch.from_arrays([pa.array(k[splits].view(np.int64)), pa.array(c[splits].astype(np.int64))], names=["k", "n"])

    while True:
        found = sample.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LIST).orderBy(F.desc("n"), "k").limit(HOT_MAX).collect()
        if not found:
            return hot
        hot = np.union1d(hot, np.array([r["k"] for r in found], np.int64).view(np.uint64))


def links(distinct: DataFrame, size: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect whatever links connect; lists are keyed by ``size`` positions."""
    sets = position_sets(size)
    hot = hot_lists(distinct, sets)
    # parts of the index: enough of them that one holds some 100,000 fingerprints' share
    parts = max(shuffle_partitions(distinct), distinct.count() * len(sets) // 2_000_000)
    labels = spread(parts, parts)

    def index(batches):
        for batch in batches:
            k, fp = postings(batch.column(0).to_numpy().view(np.uint64), sets, hot)
            part = (tc.mix(k) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            full = np.flatnonzero(np.diff(cuts)).tolist()
            pairs = np.stack([k[order], fp[order]], 1)
            yield pa.RecordBatch.from_arrays([pa.array(labels[full], pa.int32()), pa.array([pairs[cuts[p] : cuts[p + 1]].tobytes() for p in full], pa.binary())], names=["part", "entries"])

    return distinct.select("fp").mapInArrow(index, "part int, entries binary").repartition(parts, "part").groupBy("part").applyInArrow(_edges, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each vertex that is not its component's smallest, and that smallest one."""
    edges = written(edges.select("a", "b").distinct(), "simhash-edges")
    mark = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = written(small, "simhash-edges")
        r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (r["n"], r["h"]) == mark:
            return edges
        mark = r["n"], r["h"]


def _components(rows: DataFrame, first: Column, index_bytes: int = 3) -> DataFrame:
    """(fp, root, first, n): for each distinct fingerprint its component's smallest, the least ``first`` of the component's rows, and its own rows' number."""
    distinct = written(rows.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")), "simhash-distinct")
    member = components(links(distinct, index_bytes)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    of = distinct.join(member, "fp").select("fp", "first", "n", "root")
    below = of.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("size"))
    roots = distinct.join(below.withColumnRenamed("root", "fp"), "fp", "left").join(member.select("fp"), "fp", "left_anti").select("fp", F.least("first", F.coalesce("least", "first")).alias("least"), "n", "size")
    roots = written(roots, "simhash-roots")
    named = roots.where("size is not null").select(F.col("fp").alias("root"), "least", "size")
    rest = join_by_key(of, named, "root", "size").select("fp", "root", F.col("least").alias("first"), "n")
    return written(roots.select("fp", F.col("fp").alias("root"), F.col("least").alias("first"), "n").unionByName(rest), "simhash-components")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index_bytes: int = 3) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (smallest id reachable)."""
    rows = written(fingerprints(docs, id_col, text_col), "simhash-fingerprints")
    answer = _components(rows, F.col("doc_id"), index_bytes).select("fp", F.col("first").alias("component_id"), "n")
    return join_by_key(rows, answer, "fp", "n").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component with the columns it has: that of the smallest id, text hash and row hash.

    An id may repeat with other texts: rows are known by all three.  A row with a
    null id is known by a hash of its text, above any usual id; of rows that are
    equal in all columns (maps aside) one stays.
    """
    uid = F.coalesce(F.col(id_col).cast("long"), F.shiftrightunsigned(F.xxhash64(F.lit("null id"), F.col(text_col)), 2).bitwiseOR(F.lit(1 << 62)))
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    ids = {"__uid": uid, "__text": F.xxhash64(F.col(text_col)), "__row": whole}
    rows = written(fingerprints(docs.select(*[x.alias(n) for n, x in ids.items()], F.col(text_col).alias("body")), "__uid", "body", ["__text", "__row"]), "simhash-fingerprints")
    found = _components(rows, F.struct("doc_id", "__text", "__row"))
    keep = found.where("fp = root").select(F.col("first.doc_id").alias("__uid"), "first.__text", "first.__row")
    equal = Window.partitionBy(*ids).orderBy("__uid")
    return docs.withColumns(ids).join(keep, list(ids)).withColumn("__n", F.row_number().over(equal)).where("__n = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_simhash_near_dedup(spark, sf_dir):
    out = near_dedup(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
