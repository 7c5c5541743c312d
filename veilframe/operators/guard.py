"""Checks on what is about to leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import checks, text
from . import bodies, spans
from .detect import DETECTORS, detect
from .tables import free
from .tokens import prefix_of


def leaks(s: Column) -> Column:
    """Whether raw personal data is left in a text; own tokens do not count."""
    return checks.raw_shape(text.stable_view(text.scrub(s)))


def residual(df: DataFrame, text_col: str = "text", strict: bool = False, **options) -> DataFrame:
    """Adds ``residual``, the number of detections left; strict makes a row that has any fail the query.

    Digits inside an own token do not count, even where they look like a phone number.
    """
    free(df, "residual")
    own = spans.find(spans.unmarked(F.col(text_col)), fixed.PRIVATE_TOKEN, False, 0)
    out = detect(df, text_col, "__left", **options).withColumn("__own", own)
    inside = lambda d: F.exists("__own", lambda t: (t["start"] <= d["start"]) & (t["start"] + F.length(t["text"]) >= d["end"]))
    n = F.size(F.filter("__left", lambda d: ~inside(d)))
    if strict:
        n = F.when(n > 0, F.raise_error(F.concat(F.lit("residual personal data: "), n.cast("string"))).cast("int")).otherwise(n)
    return out.withColumn("residual", n).drop("__left", "__own")


def hook_decision(df: DataFrame, event: str = "event", tool: str = "tool", payload: str = "payload", secret: str = "", tenant: str = "", vault: DataFrame | None = None, which=DETECTORS) -> DataFrame:
    """What an agent may do with an event: adds ``decision`` (block, restore, deny, replace, or null: go on), ``summary`` and ``new_payload``.

    A payload is a text, or a JSON object or array of which every string counts.
    A restored payload is the tool's input with the vault's values (without a
    vault there is none to restore), a replaced one the tool's result with tokens.
    """
    free(df, "decision", "summary", "new_payload")
    body, names = F.col(f"`{payload}`"), df.columns
    is_json = body.rlike(r"\A\s*[\[{]") & F.try_parse_json(body).isNotNull()
    df = df.withColumn("__json", F.coalesce(is_json, F.lit(False))).withColumn("__body", F.when(F.col("__json"), body).otherwise(F.to_json(F.array(F.coalesce(body, F.lit(""))))))
    out = bodies.redact_bodies(df, "__body", "strings", secret, tenant, which=which, out="__clean", records="__r", detections="__d", error="__e")
    if vault is not None:
        out = bodies.restore_bodies(out, "__body", vault, out="__real")
    else:
        out = out.withColumn("__real", F.col("__body"))
    own = lambda c: F.when(F.col("__json"), F.col(c)).otherwise(F.get(F.from_json(c, "array<string>"), F.lit(0)))
    found, write = F.size("__d") > 0, (F.col(event) == "PreToolUse") & F.col(tool).isin(*fixed.WRITE_TOOLS)
    same = F.to_json(F.try_parse_json("__body")) == F.to_json(F.try_parse_json("__real"))
    decision = (
        F.when(F.col(event) == "UserPromptSubmit", F.when(found, "block"))
        .when(write, F.when(~same if vault is not None else body.rlike(fixed.PRIVATE_TOKEN), "restore"))
        .when(F.col(event) == "PreToolUse", F.when(found, "deny"))
        .when(F.col(event) == "PostToolUse", F.when(found, "replace"))
    )
    counts = F.transform(F.array(*[F.lit(k) for k in fixed.KINDS]), lambda k: F.struct(k.alias("kind"), F.size(F.filter("__d", lambda d: d["kind"] == k)).alias("n")))
    summary = F.array_join(F.array_sort(F.transform(F.filter(counts, lambda c: c["n"] > 0), lambda c: F.concat(prefix_of(c["kind"]), F.lit(":"), c["n"].cast("string")))), ", ")
    out = out.withColumn("decision", decision)
    new = F.when(F.col("decision") == "replace", own("__clean")).when((F.col("decision") == "restore") & F.lit(vault is not None), own("__real"))
    return out.select(*[F.col(f"`{c}`") for c in names], "decision", F.when(found, summary).alias("summary"), new.alias("new_payload"))
