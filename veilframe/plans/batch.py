"""Corpus jobs: summaries, folder scans, folder redaction."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text
from ..model import Policy
from ..operators import bodies, restore, tokens
from ..operators import detect as D
from ..session import stored
from ..sources import formats


def kind_counts(found: DataFrame, key: str) -> DataFrame:
    """Detections by key and kind."""
    return found.groupBy(key, "kind").agg(F.count("*").alias("n"))


def file_summaries(found: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Each file's total and its kinds in the fixed order; files without detections too."""
    rank = F.array_position(F.array(*map(F.lit, fixed.KINDS)), F.col("kind"))
    per = kind_counts(found, key).groupBy(key).agg(F.sum("n").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("o"), "kind", "n"))), lambda x: F.struct(x["kind"].alias("kind"), x["n"].alias("count"))).alias("by_kind"))
    return files.select(key).join(per, key, "left").withColumns({"total": F.coalesce("total", F.lit(0).cast("long")), "by_kind": F.coalesce("by_kind", F.array().cast("array<struct<kind:string,count:bigint>>"))})


def corpus_summary(found: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Totals of a corpus: one row for each kind and one, with a null kind, for all."""
    base = files.agg(F.count("*").alias("files"))
    hits = found.rollup("kind").agg(F.count("*").alias("detections"), F.countDistinct(key).alias("files_with"))
    return hits.crossJoin(F.broadcast(base))


def top_files(summaries: DataFrame, key: str, n: int = fixed.TOP_FILES) -> DataFrame:
    return summaries.where("total > 0").orderBy(F.desc("total"), key).limit(n)


def scan_folder(spark: SparkSession, path: str, extensions: list[str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(file summaries, detections) of a folder of text files; files that cannot be read have an error and count nothing."""
    files = formats.read_documents(spark, path, extensions).select(text.path_hash(F.col("path")).alias("path_hash"), F.when(F.is_valid_utf8(F.col("content").cast("string")), F.replace(F.decode("content", "UTF-8"), F.lit("\r\n"), F.lit("\n"))).alias("text"))
    found = stored(D.detect_rows(files, "path_hash", **options), "scan")
    return file_summaries(found, files, "path_hash"), found


def redact_documents(files: DataFrame, secret: str, tenant: str = "", policy: Policy = Policy(), which=D.DETECTORS, tables: bool = False, adapters=formats.ADAPTERS, **options) -> DataFrame:
    """Documents (path, content, kind) redacted in their own format: path, kind, redacted, records, detections, total, error.

    JSON goes by its keys, so bare identifiers under telling keys are found, and
    counts its records; with ``tables`` CSV goes by its headers; other kinds are
    extracted, anonymised as one text and put back.  A document that cannot be
    read or put back has an error and no content.
    """
    walk = F.when(F.col("kind") == "JSON", "keys")
    walk = walk.when(F.col("kind") == "CSV", "headers") if tables else walk
    files = files.select("path", "content", "kind", walk.alias("walk"))
    body = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8"))
    keyed = files.where("walk is not null").select("path", "kind", "walk", body.alias("body"))
    keyed = bodies.redact_bodies(keyed, "body", F.col("walk"), secret, tenant, policy, which, indent=F.when(F.col("kind") == "JSON", 2))
    bad = F.when(F.col("body").isNull(), F.coalesce("error", F.lit("not UTF-8")))
    keyed = keyed.select("path", "kind", F.encode("body", "UTF-8").alias("redacted"), "records", "detections", F.size("records").alias("total"), bad.alias("error"))
    read = stored(files.where("walk is null").select("path", "content", "kind", formats.extracting(adapters)("content", "kind").alias("x")), "extracted")
    done = tokens.anonymize(read.withColumn("text", F.col("x.text")), "text", secret, tenant, policy=policy, which=which, **options)
    done = stored(done.select("path", "content", "kind", "text", "records", "detections", F.col("x.error").alias("bad")), "anonymised")
    out = done.withColumn("e", formats.emitting(adapters)("content", "kind", "text"))
    return out.select("path", "kind", F.col("e.content").alias("redacted"), "records", "detections", F.size("detections").alias("total"), F.coalesce("bad", "e.error").alias("error")).unionByName(keyed)


def restore_documents(files: DataFrame, vault: DataFrame, fuzzy: bool = True, adapters=formats.ADAPTERS) -> DataFrame:
    """Documents (path, content, kind) with their tokens restored in their own format: path, kind, restored, error."""
    read = stored(files.select("path", "content", "kind", formats.extracting(adapters)("content", "kind").alias("x")), "extracted")
    done = restore.restore(read.withColumn("text", F.col("x.text")), vault, "text", fuzzy, "__names", "__left")
    done = stored(done.select("path", "content", "kind", "text", F.col("x.error").alias("bad")), "restored")
    out = done.withColumn("e", formats.emitting(adapters)("content", "kind", "text"))
    return out.select("path", "kind", F.col("e.content").alias("restored"), F.coalesce("bad", "e.error").alias("error"))


def write_files(df: DataFrame, folder: str, name: str = "output", content: str = "content") -> int:
    """Each row's bytes as one file of a folder that all executors have mounted; a task that runs again writes the same files. Gives their number."""

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for n, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = os.path.join(folder, f".{n}.{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(body)
                os.replace(part, os.path.join(folder, n))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return df.select(name, content).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def redact_folder(spark: SparkSession, path: str, out: str, secret: str, tenant: str = "", extensions: list[str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(manifest, vault) of a folder; redacted files go to ``out`` as <sha256 of the path>.<extension>, unreadable ones are left out."""
    done = stored(redact_documents(formats.read_documents(spark, path, extensions).select("path", "content", "kind"), secret, tenant, **options), "redacted")
    good = done.where("error is null").withColumn("path_hash", text.path_hash(F.col("path"))).withColumn("output", F.concat("path_hash", F.lit("."), formats.output_extension(F.col("kind"))))
    write_files(good, out, "output", "redacted")
    manifest = good.select("path_hash", F.octet_length("redacted").alias("size"), "output", "total").orderBy("path_hash")
    return manifest, tokens.vault(good, "path")


def detections_json(found: str = "detections"):
    """A row's detections as a JSON array, confidence rounded to four places."""
    return F.to_json(F.transform(found, lambda d: F.struct(d["kind"].alias("kind"), d["start"].alias("start"), d["end"].alias("end"), d["text"].alias("text"), F.round(d["confidence"], 4).alias("confidence"), d["source"].alias("source"))))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line; fields that are null are written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
