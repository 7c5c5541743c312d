"""Span arrays: extraction by marks, resolution, merging, splicing.

A match is wrapped in two private-use marks, the text is split at them, and
prefix sums of the parts' lengths are the offsets, so no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import DETECTIONS

OPEN, CLOSE = "\ue000", "\ue001"


def unmarked(s: Column) -> Column:
    """The text with the marks replaced one to one."""
    return F.when(s.contains(OPEN) | s.contains(CLOSE), F.translate(s, OPEN + CLOSE, "��")).otherwise(s)


#: A match of one pattern: where it starts in the view, its number (pattern and place), and its text there.
_MATCHES = "array<struct<start:int,ord:int,text:string>>"
#: Numbers of one pattern's matches.
PER_PATTERN = 1_000_000


def no_matches() -> Column:
    return F.array().cast(_MATCHES)


def no_detections() -> Column:
    return F.array().cast(DETECTIONS)


def find(view: Column, pattern: str, cued: bool, number: int, gate: Callable | None = None, prefilter: Callable | None = None) -> Column:
    """Matches of one pattern in the view; ``gate(value, before, after)`` decides each.

    ``cued`` patterns have three groups, of which the second is the value.  A
    match is kept small here; ``detections`` makes detections of all of them at once.
    """
    marked = F.regexp_replace(view, pattern, f"$1{OPEN}$2{CLOSE}$3" if cued else f"{OPEN}$0{CLOSE}")
    parts = F.split(marked, f"[{OPEN}{CLOSE}]", -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), no_matches().alias("out"))

    def step(s, p):
        good = (s["i"] % 2 == 1) & p.rlike(r"(?U)[^\s\x1c-\x1f]")
        if gate is not None:
            good = good & gate(p, F.substr(view, s["at"], F.when(s["at"] > 0, 1).otherwise(0)), F.substr(view, s["at"] + F.length(p) + 1, F.lit(1)))
        found = F.array(F.struct(s["at"].alias("start"), (F.lit(number * PER_PATTERN) + s["i"]).alias("ord"), p.alias("text")))
        return F.struct((s["at"] + F.length(p)).alias("at"), (s["i"] + 1).alias("i"), F.when(good, F.concat(s["out"], found)).otherwise(s["out"]).alias("out"))

    found = F.aggregate(parts, start, step, lambda s: s["out"])
    hit = F.size(parts) > 1 if prefilter is None else prefilter(view) & (F.size(parts) > 1)
    return F.when(hit, found).otherwise(no_matches())


def detections(found: Column, source: Column, src: Column, kinds: list[tuple[str, float, str, bool | None]]) -> Column:
    """Detections of matches in a view: their kind, confidence, source and passed check by pattern, their place and text in the source.

    ``src`` has the source place of each character of the view; null: the same place.
    """
    by = [F.array(*map(F.lit, x)) for x in zip(*[(k, float(c), s) for k, c, s, _ in kinds], strict=True)]
    passed = F.array(*[F.lit(p).cast("boolean") for *_, p in kinds])
    none = F.lit(None)

    def one(m):
        pattern = F.floor(m["ord"] / PER_PATTERN).cast("int") + 1
        stop = m["start"] + F.length(m["text"])
        start = F.when(src.isNull(), m["start"]).otherwise(F.element_at(src, m["start"] + 1)).cast("int")
        end = F.when(src.isNull(), stop).otherwise(F.element_at(src, F.least(stop, F.size(src))) + 1).cast("int")
        kind, confidence, name = (F.element_at(x, pattern) for x in by)
        return F.struct(
            start.alias("start"), end.alias("end"), kind.alias("kind"), F.substr(source, start + 1, end - start).alias("text"), confidence.alias("confidence"), name.alias("source"), m["ord"].alias("ord"),
            F.element_at(passed, pattern).alias("passed"), none.cast("double").alias("base"), none.cast("double").alias("boost"), none.cast("array<string>").alias("matched_terms"), m["text"].alias("compat"),
        )

    return F.transform(found, one)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def by_start(spans: Column) -> Column:
    return F.transform(F.array_sort(F.transform(spans, lambda d: F.struct(d["start"].alias("s"), d["ord"].alias("o"), d.alias("d")))), lambda x: x["d"])


def resolve(spans: Column) -> Column:
    """Disjoint spans: exact repeats dropped (first emitted wins), then best confidence, longest, leftmost, first emitted."""
    first = F.transform(F.array_sort(F.transform(spans, lambda d: F.struct(d["ord"].alias("o"), d.alias("d")))), lambda x: x["d"])

    def fresh(out, d):
        return F.when(F.exists(out, lambda e: (e["kind"] == d["kind"]) & (e["start"] == d["start"]) & (e["end"] == d["end"])), out).otherwise(F.concat(out, F.array(d)))

    unique = F.aggregate(first, no_detections(), fresh)
    ranked = F.transform(F.array_sort(F.transform(unique, lambda d: F.struct((-d["confidence"]).alias("c"), (d["start"] - d["end"]).alias("n"), d["start"].alias("s"), d["ord"].alias("o"), d.alias("d")))), lambda x: x["d"])
    return by_start(merge_into(no_detections(), F.filter(ranked, lambda d: d["start"] < d["end"])))


def merge_into(kept: Column, more: Column) -> Column:
    """``more`` in its order, each only if it overlaps nothing kept so far."""
    return F.aggregate(more, kept, lambda out, d: F.when(F.exists(out, lambda e: overlaps(e, d)), out).otherwise(F.concat(out, F.array(d))))


def merge(kept: Column, more: Column) -> Column:
    return by_start(merge_into(kept, more))


def splice(text: Column, edits: Column) -> Column:
    """The text with (start, end, new) edits, which are disjoint and sorted, applied."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, e: F.struct(F.concat(s["out"], F.substr(text, s["at"] + 1, F.greatest(e["start"] - s["at"], F.lit(0))), e["new"]).alias("out"), e["end"].alias("at"))
    return F.aggregate(edits, start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))))


def segments(text: Column, spans: Column) -> Column:
    """Alternating plain and entity pieces of a text."""
    piece = lambda kind, body: F.struct(F.lit(None).cast("string").alias("kind") if kind is None else kind.alias("kind"), body.alias("text"))
    start = F.struct(F.array().cast("array<struct<kind:string,text:string>>").alias("out"), F.lit(0).alias("at"))
    step = lambda s, d: F.struct(F.concat(s["out"], F.array(piece(None, F.substr(text, s["at"] + 1, d["start"] - s["at"])), piece(d["kind"], F.substr(text, d["start"] + 1, d["end"] - d["start"])))).alias("out"), d["end"].alias("at"))
    return F.filter(F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.array(piece(None, F.substr(text, s["at"] + 1, F.length(text)))))), lambda p: F.length(p["text"]) > 0)
