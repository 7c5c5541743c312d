"""Keyed tokens, anonymisation and the vault.

A token is PREFIX_ and 16 hex digits of HMAC-SHA256 over tenant, optional
session, prefix and the normalised value.  There is no HMAC built-in, so it is
two nested SHA-256 over padded key literals, which the driver makes.  The pads
are literals of the plan: who may read plans may derive tokens.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text
from ..model import Policy
from ..session import stored
from . import spans
from .detect import detect
from .tables import free, join_by_key

RECORD = "struct<kind:string,token:string,value:string,normalized:string>"


def _pads(secret: str) -> tuple[bytes, bytes]:
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def prefix_of(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, p in fixed.PREFIX.items():
        out = F.when(kind == k, p).otherwise(out)
    return out


def derive(kind: Column, normalized: Column, secret: str, tenant: str = "", session: str | None = None) -> Column:
    """The token of a normalised value."""
    inner, outer = _pads(secret)
    fields = [F.lit(tenant), *([F.lit("session"), F.lit(session)] if session is not None else []), prefix_of(kind), normalized]
    message = F.concat(F.lit(inner), F.encode(F.concat_ws(fixed.FIELD_END, *fields), "UTF-8"))
    digest = F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(message, 256))), 256)
    return F.when(normalized.isNotNull(), F.concat(prefix_of(kind), F.lit("_"), F.upper(F.substring(digest, 1, 16))))


def token_for(kind: str | Column, value: Column, secret: str, tenant: str = "", session: str | None = None) -> Column:
    """The token of one explicit value."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    if kind in ("PERSON", "ORGANIZATION", "ADDRESS") or not isinstance(kind, str):
        return derive(k, text.normalize_for_kind(k, value), secret, tenant, session)
    return derive(k, text.normalize_for_kind(k, value, value), secret, tenant, session)


def replaced(policy: Policy, kind: Column, folded: Column) -> Column:
    """Whether a detection is replaced under a policy; ``folded`` is its comparing form."""
    if policy.mode == "audit":
        return F.lit(False)
    out = kind.isin(*sorted(policy.kinds)) if policy.kinds else F.lit(True)
    if policy.mode == "balanced" and policy.allow:
        allowed = F.transform(F.array(*map(F.lit, policy.allow)), lambda t: text.public_key(text.fold_arabic(t)))
        out = out & ~F.array_contains(F.filter(allowed, lambda t: t != ""), text.public_key(folded))
    return out


def edits_of(scrubbed: Column, found: Column, secret: str, tenant: str = "", session: str | None = None, policy: Policy = Policy()) -> Column:
    """What a policy replaces in a text: (start, end, new, kind, value, normalized) of each detection."""

    def edit(d):
        value = F.substr(scrubbed, d["start"] + 1, d["end"] - d["start"])
        compat = F.coalesce(d["compat"], value)
        normalized = text.normalize_for_kind(d["kind"], value, compat)
        return F.struct(d["start"].alias("start"), d["end"].alias("end"), derive(d["kind"], normalized, secret, tenant, session).alias("new"), d["kind"].alias("kind"), value.alias("value"), normalized.alias("normalized"), replaced(policy, d["kind"], text.fold_arabic(compat)).alias("replace"))

    return F.filter(F.transform(found, edit), lambda e: e["replace"])


def records_of(edits: Column) -> Column:
    """The records of what was replaced: the first form of each token, by token."""
    pairs = F.transform(edits, lambda e: F.struct(e["new"].alias("token"), e["kind"].alias("kind"), e["value"].alias("value"), e["normalized"].alias("normalized")))
    first = F.aggregate(pairs, F.array().cast("array<struct<token:string,kind:string,value:string,normalized:string>>"), lambda seen, r: F.when(F.exists(seen, lambda s: s["token"] == r["token"]), seen).otherwise(F.concat(seen, F.array(r))))
    return F.transform(F.array_sort(first), lambda r: F.struct(r["kind"].alias("kind"), r["token"].alias("token"), r["value"].alias("value"), r["normalized"].alias("normalized")))


def anonymize(df: DataFrame, text_col: str = "text", secret: str = "", tenant: str = "", session: str | None = None, policy: Policy = Policy(), out: str | None = None, detections: str = "detections", records: str = "records", known: DataFrame | None = None, **options) -> DataFrame:
    """Scrubs, detects, and replaces with tokens; adds the detections and the records of what was replaced.

    ``known`` is a vault (kind, normalized, token) of an earlier secret or
    tenant: its tokens go on being used for its values, which are looked up with
    a join, however large it is.
    """
    free(df, detections, records, *([out] if out and out != text_col else []))
    df = detect(df.withColumn("__scrubbed", text.scrub(F.col(f"`{text_col}`"))), "__scrubbed", detections, **options)
    df = df.withColumn("__edits", edits_of(F.col("__scrubbed"), F.col(detections), secret, tenant, session, policy))
    if known is not None:
        df = _known_tokens(df, known)
    df = df.withColumn(records, records_of(F.col("__edits")))
    return df.withColumn(out or text_col, spans.splice(F.col("__scrubbed"), F.col("__edits"))).drop("__scrubbed", "__edits")


def _known_tokens(df: DataFrame, known: DataFrame) -> DataFrame:
    """The edits with the tokens of an earlier vault where it has their values.

    The edits alone decide, so a digest of them stands for the row; rows without
    edits do not move.  What was detected is stored first: it is read more than once.
    """
    df = stored(df, "detected")
    first = known.groupBy("kind", "normalized").agg(F.min("token").alias("old"))
    key = F.col("__edits").cast("string")
    held = df.where(F.size("__edits") > 0).withColumn("__of", F.unhex(F.sha2(key, 256)))
    pairs = held.select("__of", F.explode("__edits").alias("e")).select("__of", F.struct("e.kind", "e.normalized").alias("__value")).distinct()
    asked = pairs.groupBy("__value").agg(F.count("*").alias("n"))
    names = asked.join(first, (F.col("__value.kind") == first.kind) & (F.col("__value.normalized") == first.normalized)).select("__value", "old", "n")
    found = join_by_key(pairs, names, "__value", "n").groupBy("__of").agg(F.map_from_entries(F.collect_list(F.struct("__value", "old"))).alias("__old"))
    rows = held.groupBy("__of").agg(F.count("*").alias("n")).join(found, "__of", "left")
    old = lambda e: F.try_element_at(F.col("__old"), F.struct(e["kind"].alias("kind"), e["normalized"].alias("normalized")))
    done = join_by_key(held, rows, "__of", "n").withColumn("__edits", F.transform("__edits", lambda e: e.withField("new", F.coalesce(old(e), e["new"]))))
    return done.drop("__of", "__old").unionByName(df.where(~F.coalesce(F.size("__edits") > 0, F.lit(False))))


def vault(df: DataFrame, order_col: str, records: str = "records") -> DataFrame:
    """One row per token: the first surface form in the order of the documents."""
    rows = df.select(F.col(order_col).alias("__o"), F.posexplode(records).alias("__i", "r")).select("__o", "__i", "r.*")
    return rows.groupBy("token").agg(F.min_by(F.struct("kind", "value", "normalized"), F.struct("__o", "__i")).alias("r")).select("r.kind", "token", "r.value", "r.normalized")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old vault and those of the new records whose token it lacks."""
    return old.select("kind", "token", "value", "normalized").unionByName(new.select("kind", "token", "value", "normalized").join(old.select("token"), "token", "left_anti"))


def replace_longest_first(source: Column, pairs: Column) -> Column:
    """struct(text, hits) of literal replacements, the longest needle first, each on what the earlier ones left.

    ``pairs`` is an array of struct(needle, value), which may differ by row;
    ``hits`` is an array of (needle, n) for the needles found.  Empty needles
    are passed over; of equally long ones the first given goes first.
    """
    ranked = F.array_sort(F.transform(F.filter(pairs, lambda p: F.length(p["needle"]) > 0), lambda p, i: F.struct((-F.length(p["needle"])).alias("n"), i.alias("i"), p["needle"].alias("needle"), p["value"].alias("value"))))
    start = F.struct(source.alias("text"), F.array().cast("array<struct<needle:string,n:int>>").alias("hits"))

    def step(s, p):
        without = F.length(F.replace(s["text"], p["needle"], F.lit("")))
        n = F.floor((F.length(s["text"]) - without) / F.length(p["needle"])).cast("int")
        hit = F.array(F.struct(p["needle"].alias("needle"), n.alias("n")))
        return F.when(n > 0, F.struct(F.replace(s["text"], p["needle"], p["value"]).alias("text"), F.concat(s["hits"], hit).alias("hits"))).otherwise(s)

    return F.aggregate(ranked, start, step)
