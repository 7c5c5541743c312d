"""A training-data pipeline: rules, near-dedup, decontamination, pseudonyms, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; what it returns is written as Parquet and read again as the next one's
documents.  All stages but the last return the columns of documents, further
ones included, whatever their names.

A null text fails the rules and goes.  A null id is no reason to go.  Rows that
share an id are told apart by their texts; of equal rows, and of a group of near
copies, one stays (the smallest id, text hash and row hash).  An empty table
gives no rows at every stage.  Very long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import byte_bpe, decontamination, pii, quality_rules, simhash
from veilframe.llm.frames import documents, written
from veilframe.session import ship_package


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ship_package(spark)
    return quality_rules.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ship_package(spark)
    return simhash.keep_one(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    ship_package(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced."""
    out = pii.pseudonymise(docs, key=pii.session_key(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding gave the text back."""
    ship_package(spark)
    vocab = byte_bpe.vocabulary(spark)
    return byte_bpe.round_trip(docs, vocab)


STAGES = [("quality rules", rules), ("near duplicates", near_duplicates), ("decontamination", contamination), ("pseudonyms", pseudonyms), ("tokens", tokens)]
#: The chosen cutoffs, components and tokens are not expressible in SQL; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
