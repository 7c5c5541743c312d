"""The pipeline against its parts by brute force."""

from pathlib import Path

import pytest

pytest.importorskip("veilframe.llm.queries")

import sys

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
import duckdb
from test_operators import classes, contaminated, fingerprint, plain_pseudonyms

from veilframe.llm import pii, quality_rules

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    kept = {i for (i,) in db.execute(f"SELECT doc_id FROM ({quality_rules.ORACLE}) WHERE kept").fetchall()}
    ids = sorted(i for i in rows if i in kept)
    comp = classes(ids, [fingerprint(rows[i]) for i in ids])
    ids = [i for i, c in zip(ids, comp) if i == c]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    ids = {k[0] for k in contaminated([(i, rows[i]) for i in ids], items) if k[2] == 0}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == ids and all(r.round_trip for r in got.values())
    import public_tokenizers as P
    import tiktoken

    from veilframe.llm import byte_bpe

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path(byte_bpe.RANKS_FILE)), special_tokens={})
    masked = {i: plain_pseudonyms(t, pii.derived_key(pii.QUERY_KEY))[0] for i, t in rows.items()}
    assert all(got[i].ids == enc.encode_ordinary(masked[i]) for i in ids)


def test_odd_rows_pass_every_stage(spark):
    good = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    mail = good + " write to someone@mail.example.com"
    rows = [(1, good), (1, mail), (1, mail), (None, good + " again and again"), (2, None), (3, ""), (4, "x " * 100_000), (5, good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars", "1 as __pii", "'z' as stratum", "2 as row", "3 as fp", "4 as __n")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        got = docs.collect()
        if name == "quality rules":  # too few words, or one word over and over
            assert sorted((r.doc_id or 0, len(r.text)) for r in got) == sorted((i or 0, len(t)) for i, t in rows if t and not t.startswith("x"))
    assert len(docs.columns) == 10 and sorted((r.doc_id or 0) for r in got) in ([0, 1, 1], [0, 1], [1, 1], [1])
    assert all("someone@" not in r.text for r in got)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).where("round_trip").count() == len(got)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
