"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from veilframe.llm import byte_bpe, decontamination, language_id, pii, quality_classifier, quality_rules, queries, sharding, simhash, substring_dedup, textcore, toxicity

SF = "/root/testdata/sf0.001"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def corpus(seed=3, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "Ünder", "a,b"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([3, 20, 60, 200]))) for _ in range(n)]
    passage = " ".join(rnd.choice(words) for _ in range(40))
    for i in range(0, n, 3):
        at = rnd.randrange(len(texts[i]) + 1)
        texts[i] = texts[i][:at] + " " + passage + "\t\n" + texts[i][at:]
    texts[7] = texts[2]
    texts[11] = texts[2].replace(" ", "  ")
    texts[13] = "x " * 300
    texts[14] = "x " * 200 + passage
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    return rows + [(100, None, None, None), (101, "", "en", "s"), (102, " \n\t ", "en", "s"), (None, texts[2], "en", "s"), (5, texts[5], "en", "s"), (103, "x" * 300_000, "en", "s"), (104, "one two", "de", "s")]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "'z' as n_words", "1 as score", "'q' as ranges", "2 as fp") if extra else df


def empty(spark):
    return frame(spark, [])


def removed(rows, window=13):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return Counter(out)


def test_substring_dedup_is_exact(spark):
    rows = corpus()
    got = substring_dedup.substring_dedup(frame(spark, rows), shards=5).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert Counter(map(tuple, got)) == removed(rows)
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


def test_substring_dedup_of_rows_that_share_an_id_and_a_tag(spark):
    long = " ".join(f"v{i}" for i in range(60))
    tag = lambda t: xxhash.xxh64_intdigest(t, 42) >> 48
    want = tag(long)
    short = next(t for t in (f"tiny text {i}" for i in range(1 << 20)) if tag(t) == want)
    clash = next(t for t in (f"w{i} " + " ".join(f"u{k}" for k in range(80)) for i in range(1 << 20)) if tag(t) == want)
    rows = [(1, long, "", ""), (2, long, "", ""), (2, short, "", ""), (2, clash, "", "")]
    got = substring_dedup.substring_dedup(frame(spark, rows), shards=2).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert Counter(map(tuple, got)) == removed(rows)


def test_only_matching_statistics_remove(spark, monkeypatch):
    rows = [(i, t, "", "") for i, t in enumerate([" ".join(f"v{k}" for k in range(60))] * 4)]
    docs = frame(spark, rows)
    monkeypatch.setattr(substring_dedup.SuffixAutomaton, "matching", lambda self, seq: [0] * len(seq))
    row = {"anchor": 0, "doc": [1, 2], "body": [b" ".join(b"v%d" % k for k in range(20))] * 2}
    assert list(substring_dedup._spans([0, 1], np.array(row["doc"]), row["body"], np.array([True, False]), 13)) == []
    monkeypatch.undo()
    assert substring_dedup.substring_dedup(docs).where("n_removed = 60").count() == 3


def test_hot_anchors_change_the_routing_only(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_EVERY", 1)
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 0.0)
    rows = corpus(5)
    got = substring_dedup.substring_dedup(frame(spark, rows), shards=3).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert Counter(map(tuple, got)) == removed(rows)


def test_suffix_automaton_matching_statistics():
    rnd = random.Random(1)
    for _ in range(100):
        known = [[rnd.choice("abc") for _ in range(rnd.randrange(1, 12))] for _ in range(3)]
        a = substring_dedup.SuffixAutomaton()
        for k in known:
            a.add(k)
        s = [rnd.choice("abcd") for _ in range(15)]
        factors = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i + 1, len(k) + 1)}
        assert a.matching(s) == [max([n for n in range(1, e + 2) if tuple(s[e + 1 - n : e + 1]) in factors], default=0) for e in range(len(s))]


def contaminated(rows, items, window=10):
    def words(t):
        t = (t or "").encode().translate(LOWER)
        return bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in t).split()

    grams = {}
    for item, t in items:
        w = words(t)
        k = min(len(w), window)
        if item is not None and k:
            for a in range(len(w) - k + 1):
                grams.setdefault(tuple(w[a : a + k]), set()).add(str(item))
    sizes = {len(g) for g in grams}
    out = []
    for i, t, *_ in rows:
        w = words(t)
        hit, found = set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (o := grams.get(tuple(w[a : a + k]))) is not None:
                    hit.update(range(a, a + k))
                    found |= o
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


@pytest.mark.parametrize("part_bytes", [1 << 20, 200])
def test_decontamination(spark, part_bytes):
    rows = corpus()
    items = [(1, " ".join(rows[0][1].split()[:30])), (2, "ONE, two!"), (3, None), (None, "x x x"), (4, ""), (2, "one two"), (9, rows[3][1]), (10, "Ünder")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'c' as doc_id")
    got = decontamination.decontaminate(frame(spark, rows), bench, part_bytes=part_bytes).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == contaminated(rows, items)
    kept = decontamination.drop_contaminated(frame(spark, rows), bench, part_bytes=part_bytes)
    assert kept.columns == frame(spark, rows).columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if not r.n_hit)
    clean = decontamination.decontaminate(spark.createDataFrame([(1, "a b. One -two; c")], "doc_id long, text string"), spark.createDataFrame([(1, "one two")], "item_id long, text string")).first()
    assert clean.clean_text == "a b. ; c" and clean.hit_spans[0].asDict() == {"start": 2, "end": 4}
    assert decontamination.decontaminate(empty(spark), bench).count() == 0
    assert decontamination.decontaminate(frame(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns) and Counter(map(tuple, df.select(*names).collect())) == Counter(want.fetchall())


def test_position_sets_meet_every_four_positions():
    for size in (3, 4):
        sets = simhash.position_sets(size)
        assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(8), 4))


def fingerprint(t):
    w = (t or "").encode().translate(LOWER).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(fps))]


@pytest.mark.parametrize("index_bytes", [3, 4])
def test_simhash(spark, index_bytes):
    rows = corpus()
    fps = [fingerprint(r[1]) for r in rows]
    got = simhash.near_dedup(frame(spark, rows), index_bytes=index_bytes).collect()
    want = Counter(zip([r[0] for r in rows], fps, classes([r[0] for r in rows], fps)))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_dedup(empty(spark)).count() == 0


def test_simhash_hot_lists_and_chains(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_EVERY", 1)
    monkeypatch.setattr(simhash, "HOT_LIST", 4)
    rnd = random.Random(2)
    base, fps = rnd.getrandbits(64), []
    for _ in range(120):  # a chain: ends far apart, neighbours close
        base ^= 1 << rnd.randrange(64)
        fps.append(base ^ (1 << rnd.randrange(64)))
    fps = sorted(set(fps)) + [rnd.getrandbits(64) for _ in range(50)]
    ids = list(range(len(fps)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    monkeypatch.setattr(simhash, "LONG_LIST", 3)
    monkeypatch.setattr(simhash, "STEPS", 1)
    edges = simhash.links(spark.createDataFrame(list(zip(signed)), "fp long"))
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 64 for r in edges.collect())
    comp = {r.a: r.b for r in simhash.components(edges).collect()}
    want = classes(ids, fps)
    by = {}
    for f, c in zip(signed, want):
        by.setdefault(c, set()).add(comp.get(f, f))
    assert all(len(v) == 1 for v in by.values()) and len(set().union(*by.values())) == len(by)


@pytest.mark.parametrize("size", [3, 4])
def test_split_hot_lists_lose_no_pair(size):
    rnd = random.Random(size)
    sets = simhash.position_sets(size)
    for trial in range(40):
        a = rnd.getrandbits(64)
        places = rnd.sample(range(8), 4)  # four bytes differ by one bit each, or fewer by more
        bits = [8 * p + rnd.randrange(8) for p in places] if trial % 2 else rnd.sample(range(64), 4)
        b = a
        for x in bits:
            b ^= 1 << x
        fp = np.array([a, b], np.uint64)
        hot = np.unique(simhash.postings(fp, sets, np.zeros(0, np.uint64))[0])
        keys, fps = simhash.postings(fp, sets, hot)
        lists = {}
        for k, f in zip(keys.tolist(), fps.tolist()):
            lists.setdefault(k, set()).add(f)
        assert {a, b} in lists.values()


def test_keep_one(spark):
    rows = corpus()
    got = simhash.keep_one(frame(spark, rows))
    fps = [fingerprint(r[1]) for r in rows]
    want = {c for c in classes([r[0] for r in rows], fps)}
    assert got.columns == frame(spark, rows).columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(want)


def test_long_lists_are_split_in_their_task(monkeypatch):
    monkeypatch.setattr(simhash, "LONG_LIST", 20)
    monkeypatch.setattr(simhash, "STEPS", 3)
    rnd = random.Random(9)
    for positions in ((0, 1, 2), (0, 1, 2, 5)):
        fixed = sum(0xA5 << 8 * p for p in positions)
        free = [8 * p + b for p in range(8) if p not in positions for b in range(8)]
        fps = []
        for _ in range(40):
            x = fixed | sum(1 << b for b in rnd.sample(free, 12))
            for _ in range(rnd.randrange(6)):
                fps.append(x)
                for b in rnd.sample(free, rnd.randrange(1, 5)):
                    x ^= 1 << b
            fps.append(x)
        fp = np.unique(np.array(fps, np.uint64))
        want = classes(list(range(len(fp))), fp.tolist())
        root = {int(x): int(x) for x in fp}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in simhash.list_edges(positions, fp):
            for x, y in zip(a.tolist(), b.tolist()):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
        assert [find(int(x)) for x in fp] == [int(fp[w]) for w in want]


@pytest.mark.parametrize("n, parts", [(1, 1), (7, 7), (40, 7), (51, 211)])
def test_spread_keys_take_turns(spark, n, parts):
    from pyspark.sql import functions as F
    from veilframe.llm import frames

    keys = frames.spread(n, parts).tolist()
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k int").repartition(parts, "k")
    assert {r.i: r.p for r in df.select("i", F.spark_partition_id().alias("p")).collect()} == {i: i % parts for i in range(n)} and len(set(keys)) == n


def test_join_by_key_splits_hot_keys(spark, monkeypatch):
    from veilframe.llm import frames
    from veilframe.operators import tables

    monkeypatch.setattr(tables, "HOT_KEYS", 2)
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(200)], "k long, v long")
    table = spark.createDataFrame([(k, f"t{k}", 10 - k) for k in range(6)], "k long, t string, n long")
    got = frames.join_by_key(rows, table, "k", "n")
    assert got.columns == ["k", "v", "t"] and Counter(map(tuple, got.collect())) == Counter((k, i, f"t{k}") for i in range(200) if (k := i % 7 if i % 3 else 0) < 6)


def test_keep_one_knows_rows_by_text_too(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    rows = [(7, a, "en", "s"), (7, b, "en", "s"), (7, c, "en", "s"), (7, c, "en", "s"), (7, c, "de", "s"), (3, b, "en", "s"), (None, a, "en", "s")]
    got = Counter((r.doc_id, r.text) for r in simhash.keep_one(frame(spark, rows)).collect())
    few = frame(spark, [(3, a, "en", "s"), (5, b, "en", "s"), (5, a, "en", "s")])
    assert Counter((r.doc_id, r.text) for r in simhash.keep_one(few).collect()) == Counter([(3, a), (5, b)])
    assert got == Counter([(7, a), (3, b), (7, c)])  # b went with id 3, and takes neither a nor c along
    again = [sorted(map(tuple, simhash.keep_one(frame(spark, x).repartition(n)).collect())) for x, n in ((rows, 3), (rows[::-1], 1))]
    assert again[0] == again[1]


def test_bpe_equals_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = byte_bpe.load_ranks(P.path(byte_bpe.RANKS_FILE))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*corpus(n=20), (200, "aaaa" * 100 + "ß" * 300 + "<|endoftext|>\r\n\n  日本語 don't 123456", "", "")]
    vocab = byte_bpe.vocabulary(spark)
    ids = byte_bpe.encode(frame(spark, rows), vocab)
    got = byte_bpe.decode(ids, vocab).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == Counter((r[0], tuple(enc.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows)
    assert all(r.round_trip for r in byte_bpe.round_trip(frame(spark, rows), vocab).collect())
    codec = byte_bpe.Codec(ranks, P.PATTERN)
    for w in ("x" * 150, "ab" * 90, "thethe" * 20, "äöü" * 30):
        assert codec.contract([w.encode()])[0].tolist() == codec.by_heap(w.encode()).tolist()
    with pytest.raises(ValueError):
        codec.decode(np.array([60_000]), np.array([1]))
    assert byte_bpe.encode(empty(spark), vocab).count() == 0


def test_sharding(spark):
    rows = corpus()
    df = frame(spark, rows)
    slotted = sharding.with_slots(df)
    one = sharding.slot_map(slotted, 7)
    got = sharding.assign(slotted, one).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    # the greedy fold by hand
    load = sorted(((r.bytes, r.slot) for r in one.collect()), key=lambda x: (-x[0], x[1]))
    loads, owner = [0] * 7, {}
    for size, slot in load:
        k = loads.index(min(loads))
        owner[slot], loads[k] = k, loads[k] + size
    assert owner == {r.slot: r.shard for r in one.collect()}
    two = {r.slot: r for r in sharding.add_shard(one).collect()}
    assert all(r.shard in (owner[s], 7) and r.version == 2 for s, r in two.items()) and any(r.shard == 7 for r in two.values())
    none = sharding.with_slots(empty(spark))
    assert sharding.assign(none, sharding.slot_map(none)).count() == 0


KEY = "test-key"


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def test_pii_formats_and_links(spark):
    secret = 'token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"'
    texts = [
        "card 4111111111111111, again 4111-1111-1111-1111 and 4111 1111 1111 1112.", "9 4111111111111111 x", "+1 (415) 555-2671 70.23.22.57 999.1.1.1 1.2.3.4.5", "2024-02-29 2023-02-29 123-45-6789 000-12-3456 666-12-3456",
        "IBAN GB82 WEST 1234 5698 7654 32 GB82 WEST 1234 5698 7654 33", f"mail A.b-c1@mail.example.com {secret}###", None, "", " 4111111111111111 ", "nothing here: 12 apples",
    ]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kinds string").selectExpr("*", "1 as value", "2 as __pii")
    got = {r.doc_id: r for r in pii.pseudonymise(df, key=KEY, kinds_col="found").collect()}
    a = got[0].text.split()
    assert luhn(a[1].strip(",")) and a[1].strip(",") != "4111111111111111" and a[3].replace("-", "") == a[1].strip(",")
    assert got[0].text.endswith("4111 1111 1111 1112.")
    assert got[1].text == f"9 {a[1].strip(',')} x" and got[8].text == f" {a[1].strip(',')} "
    phone, ip = got[2].text[:17], got[2].text.split()[3]
    assert phone[:4] == "+1 (" and phone != texts[2][:17] and phone[4] in "23456789" and phone[9] in "23456789"
    assert all(0 <= int(x) < 256 for x in ip.split(".")) and got[2].text.endswith("999.1.1.1 1.2.3.4.5")
    day, same, ssn, *rest = got[3].text.split()
    assert np.datetime64(day) and day != "2024-02-29" and same == "2023-02-29" and ssn != "123-45-6789" and rest == ["000-12-3456", "666-12-3456"]
    iban = got[4].text[5:32].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and got[4].text.endswith("33")
    assert "@mail.example.com" in got[5].text and "A.b-c1" not in got[5].text and secret not in got[5].text and len(got[5].text) == len(texts[5])
    assert got[6].text is None and got[7].text == "" and got[9].text == texts[9] and got[9].found == [] and got[9].kinds == "k"
    other = pii.pseudonymise(df, key="another").where("doc_id = 1").first().text
    assert other != got[1].text


def test_pii_phones_with_any_code(spark):
    shapes = ["+1 (017) 555-7713", "+1 (132) 555-1352", "+1 (415) 155-2671", "+1 4150552671", "(212) 555-1234", "212-555-1234", "212.555.1234", "212 555-1234", "1-212-555-1234"]
    got = [r.text for r in pii.pseudonymise(key=KEY, docs=frame(spark, [(i, f"call {x}, now", "en", "s") for i, x in enumerate(shapes)])).orderBy("doc_id").collect()]
    for old, new in zip(shapes, got, strict=True):
        new = new[5:-5]
        form = lambda x: "".join("d" if c.isdigit() else c for c in x)
        digits = lambda x: "".join(filter(str.isdigit, x))[-10:]
        valid = lambda x: (digits(x)[0] > "1", digits(x)[0] < "2" or digits(x)[3] > "1")
        assert new != old and form(new) == form(old) and valid(new) == valid(old)
    assert len({"".join(filter(str.isdigit, x))[-10:] for x in got[4:]}) == 1  # one number, however it is written
    stay = ["2024-02-29123", "123-456-7890-1", "12345678901234567", "1234-456-7890", "212 555 1234"]
    assert [r.text for r in pii.pseudonymise(key=KEY, docs=frame(spark, [(i, x, "en", "s") for i, x in enumerate(stay)])).orderBy("doc_id").collect()] == stay


def test_pii_neighbours_hide_nothing(spark):
    es, at, gb = "ES91 2100 0418 4502 0005 1332", "AT611904300234573201", "GB82 WEST 1234 5698 7654 32"
    marks = "".join(map(chr, range(0xE000, 0xE006)))
    texts = [f"{es} 2024", f"{at} IS", f"{gb} {es} 4111 1111 1111 1111", f"AT12 3456 7890 {es}", "2024-02-29T10:00:00Z", "2023-02-29T10:00:00Z 2024-02-29X", "ES91 4111 1111 1111 1111", f"{marks}2 {at} {marks}0 {es}."]
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), key=KEY, kinds_col="found").collect()}
    assert [got[i].found for i in range(len(texts))] == [["iban"], ["iban"], ["iban", "iban", "card"], ["iban"], ["date"], [], ["card"], ["iban", "iban"]]
    mod = lambda x: int("".join(str(int(c, 36)) for c in x.replace(" ", "")[4:] + x[:4])) % 97
    new = got[0].text[:29]
    assert got[0].text == new + " 2024" and new != es and mod(new) == 1
    assert got[1].text.endswith(" IS") and got[1].text[:20] != at and mod(got[1].text[:20]) == 1
    assert got[2].text[28:57] == new and luhn(got[2].text[58:].replace(" ", "")) and got[3].text == f"AT12 3456 7890 {new}"
    assert got[4].text.endswith("T10:00:00Z") and np.datetime64(got[4].text[:10]) != np.datetime64("2024-02-29")
    assert got[5].text == texts[5]
    assert got[7].text == f"{marks}2 {got[1].text[:20]} {marks}0 {new}."


# An independent finder and permuter: plain Python over one text.
def halves(l, r, a, b, kind, secret):
    for i in range(10):
        x = hashlib.sha256("\x1f".join([secret, kind, str(i), str(l if i % 2 else r), str(a), str(b)]).encode()).hexdigest()
        l, r = (l, (r + int(x[:13], 16)) % b) if i % 2 else ((l + int(x[:13], 16)) % a, r)
    return l, r


def digit_halves(d, kind, secret):
    h = len(d) // 2
    l, r = halves(int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h), kind, secret)
    return f"{l:0{h}}{r:0{len(d) - h}}"


def refill(shape, chars, what=str.isdigit):
    it = iter(chars)
    return "".join(next(it) if what(c) else c for c in shape)


def text_halves(x, kind, alphabets, secret):
    l, r = x[: len(x) // 2], x[len(x) // 2 :]

    def moved(half, other, i):
        seed = hashlib.sha512("\x1f".join([secret, kind, str(i), other]).encode()).digest()
        return "".join(next((a[(a.index(c) + seed[j]) % len(a)] for a in alphabets if c in a), c) for j, c in enumerate(half))

    for i in range(10):
        l, r = (l, moved(r, l, i)) if i % 2 else (moved(l, r, i), r)
    return l + r


def remainder97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def one_value(x, secret):
    digits = "".join(c for c in x if c in "0123456789")
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    if m := re.fullmatch(r"(?is)(.*?[=:] ?)([\"'])([^\"']+)([\"'])", x):
        v = m[3]
        sets = ["0123456789abcdef"] if re.fullmatch("[0-9a-f]+", v) else ["0123456789ABCDEF"] if re.fullmatch("[0-9A-F]+", v) else ["0123456789", lower, upper]
        return "secret", m[1] + m[2] + text_halves(v, "secret", sets, secret) + m[4]
    if "@" in x:
        local, _, domain = x.partition("@")
        return "email", text_halves(local, "email", ["0123456789", lower, upper], secret) + "@" + domain
    if re.fullmatch(r"\+1.*|(1[ .\-])?(\(\d{3}\)[ .\-]?\d{3}[ .\-]?|\d{3}[ .\-]\d{3}[.\-])\d{4}", x):
        area, rest = int(digits[-10:-7]), int(digits[-7:])
        (a0, a1), (b0, b1) = ((0, 200), (0, 10**7)) if area < 200 else ((200, 1000), (0, 2 * 10**6) if rest < 2 * 10**6 else (2 * 10**6, 10**7))
        l, r = halves(area - a0, rest - b0, a1 - a0, b1 - b0, "phone", secret)
        return "phone", refill(x, f"{digits[:-10]}{l + a0:03}{r + b0:07}")
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", x):
        o = list(map(int, x.split(".")))
        l, r = halves(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ipv4", secret)
        return "ipv4", f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"
    if re.fullmatch(r"\d{4}-\d\d-\d\d", x):
        try:
            n = (datetime.date.fromisoformat(x) - datetime.date(1800, 1, 1)).days
        except ValueError:
            return None, x
        l, r = halves(n // 16233, n % 16233, 9, 16233, "date", secret)
        return "date", str(datetime.date(1800, 1, 1) + datetime.timedelta(l * 16233 + r))
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", x):
        a, g, n = map(int, x.split("-"))
        if not (1 <= a <= 899 and a != 666 and g and n):
            return None, x
        areas = [v for v in range(1, 900) if v != 666]
        l, r = halves(areas.index(a), (g - 1) * 9999 + n - 1, 898, 99 * 9999, "ssn", secret)
        return "ssn", f"{areas[l]:03}-{r // 9999 + 1:02}-{r % 9999 + 1:04}"
    if 13 <= len(digits) <= 19 and set(digits) != {"0"} and luhn(digits):
        body = digit_halves(digits[:-1], "card", secret)
        return "card", refill(x, body + next(c for c in "0123456789" if luhn(body + c)))
    return None, x


def plain_pseudonyms(text, secret):
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    before, after = r"(?<![A-Za-z0-9_.%+\-])", r"(?![A-Za-z0-9_]|[.\-][0-9])"
    date = r"(?:18|19|20|21)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
    shapes = [
        r"(?i:token|secret|api_?key|password) ?[=:] ?[\"'][A-Za-z0-9_\-]{16,128}[\"']", r"[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}",
        r"\+1[ .\-]?\(?[0-9]{3}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}", r"(?:1[ .\-])?(?:\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-]?|[0-9]{3}[ .\-][0-9]{3}[.\-])[0-9]{4}",
        octet + r"(?:\." + octet + "){3}", date, r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{13,19}", r"[0-9]{4}(?:[ \-][0-9]{4}){2}[ \-][0-9]{1,7}", r"[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}",
    ]
    lengths = {c: n for n, cs in pii.IBAN_LENGTH.items() for c in cs.split()}
    done, kinds, at = [], [], 0
    while at < len(text):  # IBANs first, at every start
        m = re.compile(before + "[A-Z]{2}[0-9]{2}").match(text, at)
        tries = []
        if m and (n := lengths.get(text[at : at + 2])):
            tries.append(rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else ""))
        tries.append(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
        got = next((g for t in tries if m and (g := re.compile(t + after).match(text, at))), None)
        flat = got[0].replace(" ", "") if got else ""
        if got and len(flat) >= 15 and sum(map(str.isdigit, flat)) >= 8 and remainder97(flat[4:] + flat[:4]) == 1:
            body = refill(flat[4:], digit_halves("".join(c for c in flat[4:] if c.isdigit()), "iban", secret))
            check = 98 - remainder97(body + flat[:2] + "00")
            done.append(("iban", refill(got[0], f"{flat[:2]}{check:02}{body}", str.isalnum)))
            at = got.end()
        else:
            done.append((None, text[at]))
            at += 1
    marked = "".join(c if k is None else "\uf000" + c + "\uf001" for k, c in done)
    scan = re.compile("\uf000([^\uf001]*)\uf001|" + before + "(?:" + "|".join(shapes) + ")" + after + "|" + before + date + "(?=[Tt][0-9])")

    def turn(m):
        kind, value = ("iban", m[1]) if m[1] is not None else one_value(m[0], secret)
        if kind:
            kinds.append(kind)
        return value

    return scan.sub(turn, marked), ",".join(kinds)


def test_pii_equals_a_plain_finder_and_permuter(spark, recwarn):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r.doc_id: (r.text, r.kinds) for r in pii.op9_feistel_pii(spark, "/root/testdata/sf0.01").collect()}
    secret = hashlib.sha256(b"feistel pseudonyms\x1f" + pii.QUERY_KEY.encode()).hexdigest()
    assert any("published key" in str(w.message) for w in recwarn.list)
    assert got == {i: plain_pseudonyms(t, secret) for i, t in docs.items()} and len({k for _, x in got.values() for k in x.split(",")}) > 5


def test_pii_never_joins_two_values(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{a}{b}@x.example.com" for a in letters for b in letters]
    got = {r.text for r in pii.pseudonymise(frame(spark, [(i, t, "", "") for i, t in enumerate(mails)]), key=KEY).collect()}
    assert len(got) == len(mails) and got == set(mails)
    with pytest.raises(ValueError):
        pii.pseudonymise(frame(spark, []))
    assert pii.pseudonymise(empty(spark), key=KEY).count() == 0
    twice = frame(spark, [(1, mails[0], "", ""), (1, mails[0], "", ""), (2, "x " * 200_000 + mails[0], "", "")])
    out = [r.text for r in pii.pseudonymise(twice, key=KEY).orderBy("doc_id").collect()]
    assert out[0] == out[1] and out[2] == "x " * 200_000 + out[0]


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    df = spark.range(9 * 17).select((F.col("id") % 9).alias("l"), F.floor(F.col("id") / 9).alias("r"))
    out = df.select(pii.feistel(F.col("l"), F.col("r"), F.lit(9).cast("long"), F.lit(17).cast("long"), "k", "t").alias("p")).collect()
    assert {(x.p.l, x.p.r) for x in out} == {(l, r) for l in range(9) for r in range(17)}


def measures(t):
    t = t or ""
    w = t.encode().split()
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {p for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_quality_measures(spark):
    rows = [*corpus(), (300, "a b c\na b c\n\na b c \n#*$%&|<> é日\n a b c", "fr", "s"), (301, "p q r s t " * 5, "fr", "s")]
    got = quality_rules.base_measures(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((r[0], *(m := measures(r[1])), m[0] < 10 or 100 * m[4] > 20 * m[0]) for r in rows)


def test_quality_cutoffs_are_exact_binomial(spark):
    for k, n, rate in ((0, 100, 0.02), (3, 50, 0.1), (40, 50, 0.5), (19, 1000, 0.02)):
        assert quality_rules.binomial_at_most(k, n, rate) == pytest.approx(sum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1)), rel=1e-9)
    assert quality_rules.binomial_at_most(5, 5, 0.05) == quality_rules.binomial_at_most(0, 0, 0.05) == 1.0
    assert 0.49 < quality_rules.binomial_at_most(2 * 10**7, 10**9, 0.02) < 0.51 and quality_rules.binomial_at_most(0, 10**9, 0.02) == 0.0
    rnd = random.Random(4)
    good = [(i, " ".join(f"g{rnd.randrange(5000)}" for _ in range(30)), "en", "s") for i in range(900)]
    bad = [(1000 + i, " ".join(f"b{rnd.randrange(5000)}###" for _ in range(30)), "en", "s") for i in range(60)]
    few = [(2000 + i, " ".join(f"b{rnd.randrange(5000)}###" for _ in range(30)), "xx", "s") for i in range(10)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in good + bad + few] + [(None, 1), (5, None), (99999, 0)], "doc_id long, quality int").selectExpr("*", "0 as toxic")
    df = frame(spark, good + bad + few)
    out = {r.doc_id: r for r in quality_rules.quality_rules(df, labels).collect()}
    assert all(out[r[0]].kept for r in good) and not any(out[r[0]].kept for r in bad) and all(out[r[0]].kept for r in few)
    kept = quality_rules.reject(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k, r in out.items() if r.kept}
    assert quality_rules.quality_rules(empty(spark), labels).count() == 0
    assert all(r.kept for r in quality_rules.quality_rules(frame(spark, bad), labels.limit(0)).collect())


def test_quality_cutoffs_of_every_stratum(spark):
    good = [(s * 1000 + i, f"{s} plain words of good prose that stand in row {i} here", f"l{s:03}", "s") for s in range(70) for i in range(700)]
    bad = [(100_000 + s, "### ### ### junk junky words of the row stand in here", f"l{s:03}", "s") for s in range(70)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 100_000)) for r in good + bad], "doc_id long, quality int")
    out = quality_rules.quality_rules(frame(spark, good + bad), labels).collect()
    assert Counter((r.doc_id < 100_000, r.kept) for r in out) == {(True, True): len(good), (False, False): len(bad)}


def test_language_id_learns_every_language(spark):
    names = [f"a{i:03}" for i in range(150)] + ["zh"]
    rows = [(i * 10 + k, f"{x}wort {x}satz".translate(str.maketrans("0123456789", "bcdfghjkmn")), x, "s") for i, x in enumerate(names) for k in range(3)]
    model = language_id.train(frame(spark, rows))
    assert model.languages == names and [model.predict(r[1])[0] for r in rows] == [r[2] for r in rows]
    model.most, model.step = 5, 2
    model.forget()
    assert [model.predict(f"{a[1]} {b[1]} {b[1]}")[0] for a, b in zip(rows[3:], rows)] == [b[2] for b in rows[:-3]]
    limited = {f"a{i:03}": Counter({f"w{i}x{k}": 1 for k in range(9)}) for i in range(language_id.LANGUAGES * 2)}
    assert len(language_id.Model(limited).languages) == language_id.LANGUAGES * 2


def test_language_id(spark):
    got = {r.doc_id: r for r in language_id.op3_language_id(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [d for d in got if got[d].held_out]
    assert len(held) > 200 and np.mean([got[d].lang_pred == truth[d] for d in held]) > 0.98
    two = language_id.Model({"de": Counter({"der": 1}), "en": Counter({"the": 1})})
    assert [two.predict(t) for t in ("²½", "①", "Ⅷ ٣", "_ 12")] == [("und", 0.0)] * 4 and language_id.words_of("m² 五 aⅧb") == ["m", "五", "a", "b"]
    model = language_id.Model({"de": Counter({"und": 5, "der": 4}), "en": Counter({"and": 5, "the": 4})})
    assert model.predict("und der")[0] == "de" and model.predict("thez")[0] == "en"
    assert model.predict(None) == model.predict("") == model.predict("12 !?") == ("und", 0.0)
    assert language_id.Model({}).predict("word") == ("und", 0.0)
    rows = [(1, None, None, None), (2, "der und", None, ""), (2, "der und", None, ""), (None, "the", "en", ""), (3, "und " * 100_000 + "the", "", "")]
    assert Counter((r.doc_id, r.lang_pred) for r in language_id.identify(frame(spark, rows), model).collect()) == Counter([(1, "und"), (2, "de"), (2, "de"), (None, "en"), (3, "de")])
    assert language_id.identify(empty(spark), language_id.train(empty(spark))).count() == 0


@pytest.mark.parametrize("query, label, low", [(quality_classifier.op5_quality_classifier, "quality", 0.95), (toxicity.op6_toxicity, "toxic", 0.9)])
def test_classifiers_on_held_out_rows(spark, query, label, low):
    got = query(spark, "/root/testdata/sf0.01").collect()
    marks = {r.doc_id: r[label] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in got if r.held_out and marks.get(r.doc_id) is not None]
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 1000
    assert np.mean([r.predicted == marks[r.doc_id] for r in held]) >= low


def plain_language(counts, text):
    """The languages' sums by dictionaries, one word at a time."""
    names = sorted(counts)
    levels = [{x: dict(counts[x].most_common(language_id.VOCABULARY)) for x in names}]
    for n in (4, 3, 2, 1):
        per = {}
        for x in names:
            c = Counter()
            for w, k in counts[x].items():
                w = f"_{w}_" if n > 1 else w
                for i in range(len(w) - n + 1):
                    c[w[i : i + n]] += k
            per[x] = dict(c.most_common(language_id.VOCABULARY))
        levels.append(per)
    sums, total = dict.fromkeys(names, 0.0), 0
    for w in re.findall("[a-zäöüéèßñ]+", text.lower()):
        total += 1
        for n, per in zip((0, 4, 3, 2, 1), levels):
            body = f"_{w}_" if n > 1 else w
            keys = [k for k in ([w] if not n else [body[i : i + n] for i in range(len(body) - n + 1)]) if any(k in c for c in per.values())]
            if keys:
                size = len(set().union(*per.values()))
                v = {x: sum(math.log((per[x].get(k, 0) + 0.1) / (sum(per[x].values()) + 0.1 * size)) for k in keys) for x in names}
                for x in names:
                    sums[x] += (v[x] - max(v.values())) / max(1, n)
                break
    if not total:
        return "und", 0.0
    e = {x: math.exp((sums[x] - max(sums.values())) / max(1, math.sqrt(total))) for x in names}
    best = min(names, key=lambda x: (-sums[x], x))
    return best, e[best] / sum(e.values())


def test_language_scores_equal_plain_ones(spark):
    rnd = random.Random(6)
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text and r.lang]
    counts = {}
    for r in docs[:60]:
        counts.setdefault(r.lang, Counter()).update(language_id.words_of(r.text))
    model = language_id.Model({x: Counter(dict(sorted(c.items()))) for x, c in counts.items()})
    counts = {x: Counter(dict(sorted(c.items()))) for x, c in counts.items()}
    texts = ["", "12 ²", "zzqx", "häuserß ñu"] + [" ".join(rnd.sample(r.text.split(), min(12, len(r.text.split())))) for r in docs[60:110]]
    for t in texts:
        t = re.sub("[^a-zA-ZäöüéèßñÄÖÜÉÈÑ ]", " ", t)
        (a, p), (b, q) = model.predict(t), plain_language(counts, t)
        assert p == pytest.approx(q, rel=2e-3, abs=1e-5) and (a == b or abs(p - 0.5) < 1e-3)


def plain_toxicity(model, text):
    m = (1 << 64) - 1

    def mix(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & m
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 & m
        return x ^ x >> 33

    def word(w):
        return mix(sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(w)) + len(w) & m)

    t = (text or "").encode().translate(LOWER)
    h = [word(w) for w in bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in t).split()]
    found = {mix(x + 1 & m) for x in h}
    for d in (1, 2):
        found |= {mix(a * (3 + 2 * d) + mix(b + d & m) & m) for a, b in zip(h, h[d:])}
    weight = dict(zip(model.at.tolist(), model.weight.tolist()))
    return 1 / (1 + math.exp(-(model.bias + sum(weight.get(c, 0.0) for c in {f >> 64 - toxicity.BITS for f in found}))))


def test_toxicity_scores_equal_plain_ones(spark):
    texts = ["you utter fool"] * 40 + ["a kind word, É so kind"] * 60
    model = toxicity.fit(texts, np.array([1] * 40 + [0] * 60))
    rows = [*corpus(n=15), (900, "Utter FOOL kind é", "", ""), (900, "Utter FOOL kind é", "", "")]
    got = toxicity.score(frame(spark, rows), model).collect()
    assert len(model.at) and sorted((r.doc_id or -1, round(r.score, 9)) for r in got) == sorted((r[0] or -1, round(plain_toxicity(model, r[1]), 9)) for r in rows)


def plain_quality(model, text):
    shapes = ["<upper>", "<title>", "<lower>", "<digit>", "<symbol>", "<mixed>", "<again>"]
    tokens = re.findall(r"\w+|[^\w\s]+", text or "")
    x = np.zeros(quality_classifier.DIM + len(shapes) + 2)
    for t in tokens:
        if t in model.row:
            x[: quality_classifier.DIM] += model.vectors[model.row[t]]
            x[-2] += 1
        kind = "<digit>" if t.isdigit() else "<symbol>" if not (t[0].isalnum() or t[0] == "_") else "<lower>" if t.islower() else "<upper>" if len(t) > 1 and t.isupper() else "<title>" if t.istitle() else "<mixed>"
        x[quality_classifier.DIM + shapes.index(kind)] += 1
    x /= max(1, len(tokens))
    plain = (text or "").split()
    x[quality_classifier.DIM + 6] = sum(a == b for a, b in zip(plain, plain[1:])) / max(1, len(plain)) if tokens else 0
    x[-1] = math.log1p(len(tokens)) / 10
    w1, b1, w2, b2 = model.layers
    z = [(v - c) / s for v, c, s in zip(x, model.center, model.spread)]
    hidden = [math.tanh(sum(a * w1[i][k] for i, a in enumerate(z)) + b1[k]) for k in range(len(b1))]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(hidden, w2)) + b2) / model.temperature))


def test_quality_scores_equal_plain_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts, marks = quality_classifier.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), "quality")
    model = quality_classifier.Classifier().fit(texts, marks)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()][:40] + [(900, None, "", ""), (901, "", "", ""), (902, "AB ab Ab aB 12 ## ab ab", "", "")] * 2
    got = quality_classifier.score(frame(spark, rows), model).collect()
    assert model.layers is not None
    for a, b in zip(sorted((r.doc_id, r.score) for r in got), sorted((r[0], plain_quality(model, r[1])) for r in rows)):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-4)


def test_training_takes_labelled_rows_however_few(spark):
    rows = [(i, f"row {i} " + "x" * 92, "en", "s") for i in range(20_000)]
    labels = spark.createDataFrame([(i, i // 400 % 2) for i in range(0, 20_000, 400)] + [(3, None), (None, 1), (99_999, 1)], "doc_id long, quality int")
    for max_bytes, low, high in ((6000, 50, 50), (2000, 5, 45)):
        texts, marks = quality_classifier.train(frame(spark, rows), labels, "quality", max_bytes=max_bytes)
        assert low <= len(texts) <= high and set(marks.tolist()) == {0, 1} and all(int(t.split()[1]) % 400 == 0 for t in texts)


def test_classifier_edges(spark):
    empty_model = quality_classifier.Classifier().fit([], np.zeros(0, np.int64))
    rows = [(1, None, None, None), (2, "", "", ""), (None, "word " * 50_000, "", "")]
    assert [0 <= r.score <= 1 for r in quality_classifier.score(frame(spark, rows), empty_model).collect()] == [True] * 3
    tox = toxicity.fit([], np.zeros(0, np.int64))
    assert [r.score for r in toxicity.score(frame(spark, rows), tox).collect()] == [0.5] * 3
    texts = ["you utter fool"] * 40 + ["a kind word"] * 60
    tox = toxicity.fit(texts, np.array([1] * 40 + [0] * 60))
    s = tox.score(pa.array(["such a Fool!", "kind people", ""], pa.large_string()))
    assert s[0] > s[1]
    assert quality_classifier.score(empty(spark), empty_model).count() == toxicity.score(empty(spark), tox).count() == 0


def test_words_never_span_texts():
    col = pa.array(["ab", "cd ef", "", " ", "gh"], pa.large_string())
    w = textcore.Words(col, textcore.PLAIN)
    assert w.texts(0, len(w)) == [b"ab", b"cd", b"ef", b"gh"] and w.doc.tolist() == [0, 1, 1, 4]
    h = w.hashes()
    assert len(set(h.tolist())) == 4 and (h[0] == textcore.Words(pa.array(["x ab"], pa.large_string()), textcore.PLAIN).hashes()[1])


def test_digests_of_the_registered_queries(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: (n, k, hashlib.sha256(x.encode()).hexdigest()) for i, n, k, x in removed(list(docs.items()))}
    got = substring_dedup.op1_substring_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    for r in byte_bpe.op4_byte_bpe(spark, SF).collect():
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    got = simhash.op8_simhash_near_dedup(spark, SF).collect()
    assert all(r.fingerprint == f"{fingerprint(docs[r.doc_id]):016x}" for r in got)
