"""Scoring detections against gold spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _touch(a: str, b: str):
    return (F.col(f"{a}.key") == F.col(f"{b}.key")) & (F.col(f"{a}.kind") == F.col(f"{b}.kind")) & (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{b}.start") < F.col(f"{a}.end"))


def outcomes(found: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """One row per outcome: key, kind, source, what (tp and fp count detections, fn gold spans)."""
    d = found.withColumnRenamed(key, "key").alias("d")
    g = gold.withColumnRenamed(key, "key").alias("g")
    hit = d.join(g, _touch("d", "g"), "left_semi").select("key", "kind", "source", F.lit("tp").alias("what"))
    wrong = d.join(g, _touch("d", "g"), "left_anti").select("key", "kind", "source", F.lit("fp").alias("what"))
    missed = g.join(d, _touch("g", "d"), "left_anti").select("key", "kind", F.lit(None).cast("string").alias("source"), F.lit("fn").alias("what"))
    return hit.unionByName(wrong).unionByName(missed)


def scores(results: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, precision and recall; a rate without cases is 0."""
    n = lambda w: F.count_if(F.col("what") == w)
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(F.lit(0.0))
    return results.groupBy(*by).agg(n("tp").alias("tp"), n("fp").alias("fp"), n("fn").alias("fn")).withColumns({"precision": rate("tp", "fp"), "recall": rate("tp", "fn")})
