"""Detection: declarative detectors compiled to Columns, and the whole pipeline.

A detector is a pattern with a gate; ``find`` turns it into an array of matches.
A row's texts (one, or the cells of a table) are one array, of which each element
is read as it stands and, where Arabic runs may be written backwards, turned:
one expression holds every pattern once, however many texts and readings there
are, and one Python step gives the views of texts that built-ins cannot fold.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions import checks, text
from . import spans
from .tables import free


@dataclass(frozen=True)
class Detector:
    """One detector pass: what it matches, how sure it is, and its gates."""

    name: str
    kind: str
    pattern: str
    confidence: float
    cued: bool = False
    gate: Callable[[Column, Column, Column], Column] | None = None
    prefilter: Callable[[Column], Column] | None = None
    passed: bool | None = None

    def find(self, view: Column, number: int = 0) -> Column:
        return spans.find(view, self.pattern, self.cued, number, self.gate, self.prefilter)

    def told(self) -> tuple[str, float, str, bool | None]:
        return self.kind, self.confidence, self.name, self.passed


def _digits(n: int) -> Callable[[Column], Column]:
    """Cheap test: some n digits with few characters between them (a pattern of n digits with up to six others in each gap implies it)."""
    return lambda v: v.rlike(rf"[0-9{fixed.ARABIC_INDIC}{fixed.PERSIAN}](?:[^0-9{fixed.ARABIC_INDIC}{fixed.PERSIAN}]{{0,6}}[0-9{fixed.ARABIC_INDIC}{fixed.PERSIAN}]){{{n - 1}}}")


#: A country and a digit after it: an IBAN's account may be all letters, and any number of spaces may part its characters.
_IBAN_START = lambda v: v.rlike(rf"(?iU)(?:{'|'.join(fixed.IBAN_LENGTH)})[\s\-]*[0-9{fixed.ARABIC_INDIC}{fixed.PERSIAN}]")
_ADDRESS = lambda v, b, a: checks.address_value(v)
_A_DIGIT = lambda v: v.rlike(r"(?U)\d")
_ARABIC = text.has_arabic

DETECTORS: tuple[Detector, ...] = (
    Detector("regex.email", "EMAIL", fixed.EMAIL, 0.99, prefilter=lambda v: v.contains("@")),
    Detector("regex.gcc.iban.mod97", "IBAN", fixed.IBAN, 0.99, gate=lambda v, b, a: checks.valid_iban(v), prefilter=_IBAN_START, passed=True),
    Detector("regex.gcc.phone", "PHONE", fixed.PHONE, 0.93, gate=lambda v, b, a: checks.plausible_phone(v) & checks.no_digit_beside(b, a), prefilter=_digits(6)),
    Detector("regex.gcc.uae_id", "NATIONAL_ID", fixed.UAE_ID, 0.98, prefilter=lambda v: v.contains("784")),
    Detector("regex.gcc.saudi_id_context", "NATIONAL_ID", fixed.SAUDI_ID, 0.95, True, prefilter=_digits(8)),
    Detector("regex.gcc.id_context", "NATIONAL_ID", fixed.GULF_ID, 0.90, True, prefilter=_digits(8)),
    Detector("regex.shareholder_id", "NATIONAL_ID", fixed.SHAREHOLDER_ID, 0.78, True, prefilter=_digits(9)),
    Detector("regex.gcc.commercial_registration_context", "COMMERCIAL_REGISTRATION", fixed.REGISTRATION, 0.93, True, gate=lambda v, b, a: checks.registration_shape(v), prefilter=_A_DIGIT),
    Detector("regex.gcc.tax_number_context", "TAX_NUMBER", fixed.TAX, 0.93, True, prefilter=_digits(10)),
    Detector("regex.saudi_vat_bare", "TAX_NUMBER", fixed.VAT_BARE, 0.86, prefilter=_digits(15)),
    Detector("regex.tax_context_bare_15", "TAX_NUMBER", fixed.BARE_15, 0.80, gate=lambda v, b, a: ~checks.one_character(text.digits_only(v)), prefilter=lambda v: _digits(15)(v) & checks.tax_document(v)),
    Detector("regex.address_context", "ADDRESS", fixed.ADDRESS_CUE, 0.82, True, _ADDRESS, lambda v: v.contains("address") | v.contains("العنوان") | v.contains("عنوان العميل")),
    Detector("regex.address_building", "ADDRESS", fixed.BUILDING, 0.80, True, _ADDRESS),
    Detector("regex.address_po_box", "ADDRESS", fixed.PO_BOX, 0.85, True, _ADDRESS, _A_DIGIT),
    Detector("regex.address_postal_code", "ADDRESS", fixed.POSTAL_CODE, 0.82, True, _ADDRESS, _A_DIGIT),
    Detector("regex.address_district", "ADDRESS", fixed.DISTRICT, 0.75, prefilter=lambda v: v.contains("Dist") | v.contains("Neighborhood")),
    Detector("regex.address_street", "ADDRESS", fixed.STREET, 0.78, True, _ADDRESS),
    Detector("regex.address_arabic_keyword", "ADDRESS", fixed.ARABIC_STREET, 0.78, prefilter=_ARABIC),
    Detector("regex.address_compound", "ADDRESS", fixed.ARABIC_COMPOUND, 0.92, prefilter=_ARABIC),
    Detector("regex.address_city_anchor", "ADDRESS", fixed.CITY_ANCHOR, 0.86, prefilter=lambda v: (v.contains(",") | v.contains("،")) & v.rlike(fixed.CITY_AFTER_COMMA)),
    Detector("regex.address_english_street", "ADDRESS", fixed.ENGLISH_STREET, 0.86, prefilter=lambda v: v.rlike(fixed.STREET_NOUN)),
    Detector("regex.address_city_postal", "ADDRESS", fixed.CITY_POSTAL, 0.90, prefilter=_digits(5)),
)


def detectors(*kinds: str) -> tuple[Detector, ...]:
    return tuple(d for d in DETECTORS if not kinds or d.kind in kinds)


class Gazetteer:
    """Place names; longest first, two characters at least."""

    def __init__(self, surfaces: Sequence[str] = ()):
        self.surfaces = sorted({s.strip() for s in surfaces if len(s.strip()) >= fixed.GEO_MIN}, key=lambda s: (-len(s), s))

    @classmethod
    def from_data(cls, data: dict) -> Gazetteer:
        return cls([s for part in ("countries", "cities") for e in data.get(part, []) for lang in ("ar", "en") for s in e.get(lang, [])])

    def find(self, source: Column, number: int) -> Column:
        if not self.surfaces:
            return spans.no_detections()
        pattern = "(?iu)(?:" + "|".join("\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E" for s in self.surfaces) + ")"
        found = spans.detections(spans.find(source, pattern, False, 0), source, F.lit(None).cast("array<int>"), [("ADDRESS", fixed.GEO_CONFIDENCE, "geo.gazetteer_address_gated", None)])
        found = F.transform(found, lambda d: d.withField("ord", d["ord"] + number * spans.PER_PATTERN))
        window = lambda d: F.substr(source, F.greatest(d["start"] - fixed.GEO_WINDOW, F.lit(0)) + 1, d["end"] + fixed.GEO_WINDOW - F.greatest(d["start"] - fixed.GEO_WINDOW, F.lit(0)))
        return F.filter(found, lambda d: window(d).rlike(fixed.GEO_HEAD) | window(d).rlike(fixed.GEO_POSTAL) | window(d).rlike(fixed.GEO_BUILDING))


def scan(source: Column, body: Column, src: Column, which: Sequence[Detector], gazetteer: Gazetteer | None = None) -> Column:
    """Resolved detections of one reading of a text: its view, and the source place of each of the view's characters."""
    found = spans.no_detections()
    if which:
        matches = F.concat(*[d.find(body, i) for i, d in enumerate(which)])
        found = spans.detections(matches, source, src, [d.told() for d in which])
    if gazetteer is not None and gazetteer.surfaces:
        found = F.concat(found, gazetteer.find(source, len(which)))
    return spans.resolve(found)


def _folded(term: str) -> str:
    """``text.fold_arabic`` of a fixed term."""
    plain = "".join(fixed.LETTER_FOLD.get(c, c) for c in term if not re.match(fixed.MARKS, c))
    return " ".join("".join(str(int(c)) if c.isdecimal() else c for c in plain).split()).lower()


def context_boost(source: Column, found: Column) -> Column:
    """Higher confidence where a cue of the kind is among the last words before the span."""
    terms = F.create_map(*[x for kind, cues in fixed.CONTEXT_TERMS.items() for x in (F.lit(kind), F.array(*map(F.lit, sorted({_folded(c) for c in cues}))))])

    def one(d):
        words = F.filter(F.split(F.substr(source, F.lit(1), d["start"]), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        last = F.transform(F.slice(words, F.greatest(F.size(words) - fixed.CONTEXT_WORDS, F.lit(0)) + 1, F.lit(fixed.CONTEXT_WORDS)), text.fold_arabic)
        mine = F.try_element_at(terms, d["kind"])
        hits = F.array_distinct(F.filter(last, lambda w: F.array_contains(mine, w)))
        new = F.greatest(F.least(d["confidence"] + fixed.CONTEXT_BOOST, F.lit(1.0)), F.lit(fixed.CONTEXT_LEAST))
        up = (F.size(hits) > 0) & d["passed"].isNull() & mine.isNotNull()
        return F.when(up, d.withField("confidence", new).withField("base", d["confidence"]).withField("boost", new - d["confidence"]).withField("matched_terms", hits)).otherwise(d)

    return F.transform(found, one)


class Suppressor:
    """Phrases that are never personal data: (kind or None, lower-case text)."""

    def __init__(self, entries: Sequence[tuple[str | None, str]] = ()):
        self.entries = sorted({(k, t.lower()) for k, t in entries}, key=str)

    @classmethod
    def from_text(cls, raw: str) -> Suppressor:
        out = []
        for line in map(str.strip, raw.splitlines()):
            if not line or line.startswith("#"):
                continue
            kind, sep, rest = line.partition(":")
            if sep and kind.strip().upper() not in fixed.KINDS:
                continue  # a kind that is never found
            entry = (kind.strip().upper(), rest.strip()) if sep else (None, line)
            if entry[1]:
                out.append(entry)
        return cls(out)

    def keep(self, found: Column) -> Column:
        if not self.entries:
            return found
        listed = F.array(*[F.lit(f"{k or ''}\x1f{t}") for k, t in self.entries])
        return F.filter(found, lambda d: ~F.array_contains(listed, F.concat(F.lit("\x1f"), F.lower(d["text"]))) & ~F.array_contains(listed, F.concat(d["kind"], F.lit("\x1f"), F.lower(d["text"]))))


def _readings(source: Column, views: Column, at: Column) -> Column:
    """A text's readings (source, body, src, turned?): as it stands, and turned where that changes anything."""
    turned = text.reverse_arabic_runs(source)
    reading = lambda s, v, back: F.struct(s.alias("source"), F.transform(F.array(F.coalesce(v["text"], text.stable_view(s))), spans.unmarked)[0].alias("body"), v["src"].alias("src"), F.lit(back).alias("turned"))
    plain = reading(source, F.get(views, at * 2), False)
    return F.when(turned != source, F.array(plain, reading(turned, F.get(views, at * 2 + 1), True))).otherwise(F.array(plain))


def detect_all(df: DataFrame, texts: Column, out: str, which: Sequence[Detector] = DETECTORS, gazetteer: Gazetteer | None = None) -> DataFrame:
    """Adds, for an array of texts, the array of each one's pattern detections, boosted by context; null for a null text."""
    df = df.withColumn("__texts", texts)
    turned = lambda s: F.when(text.has_arabic(s), text.reverse_arabic_runs(s))
    both = F.flatten(F.transform("__texts", lambda s: F.array(s, turned(s))))
    df = df.withColumn("__views", F.coalesce(text.unstable_views(both), F.array().cast(T.ArrayType(text.VIEW))))

    def of(source, at):
        def read(r):
            # spans of a turned reading index the text as it stands, and so do their values
            own = lambda d: F.when(r["turned"], F.substr(source, d["start"] + 1, d["end"] - d["start"])).otherwise(d["compat"])
            return F.transform(scan(r["source"], r["body"], r["src"], which, gazetteer), lambda d: d.withField("compat", own(d)))

        found = F.transform(_readings(source, F.col("__views"), at), read)
        merged = F.transform(F.array(found), lambda f: F.when(F.size(f) > 1, spans.merge(f[0], F.get(f, F.lit(1)))).otherwise(f[0]))
        return F.when(source.isNotNull(), context_boost(source, merged[0]))

    return df.withColumn(out, F.transform("__texts", of)).drop("__texts", "__views")


def detect(df: DataFrame, text_col: str = "text", out: str = "detections", which: Sequence[Detector] = DETECTORS, gazetteer: Gazetteer | None = None, suppressor: Suppressor | None = None, engines: Sequence[Callable[[Column], Column]] = ()) -> DataFrame:
    """Adds the array of detections of a text column.

    ``engines`` are Columns of model detections (see ``ner``), merged in order
    after the context boost and before tokens and phrases are dropped.
    """
    free(df, out)
    source = F.col(f"`{text_col}`")
    df = detect_all(df, F.array(source), "__all", which, gazetteer).withColumn(out, F.get("__all", F.lit(0))).drop("__all")
    for i, engine in enumerate(engines):
        df = df.withColumn(f"__engine{i}", engine(source))
    if engines:
        df = df.withColumn(out, spans.merge(F.col(out), F.concat(*[F.coalesce(F.col(f"__engine{i}"), spans.no_detections()) for i in range(len(engines))])))
    return df.withColumn(out, kept(F.col(out), suppressor)).drop(*[f"__engine{i}" for i in range(len(engines))])


def kept(found: Column, suppressor: Suppressor | None = None) -> Column:
    """Detections that are no tokens and no suppressed phrases."""
    return (suppressor or Suppressor()).keep(F.filter(found, lambda d: ~checks.is_placeholder(d["text"])))


def detect_rows(df: DataFrame, id_col: str, text_col: str = "text", **options) -> DataFrame:
    """One row per detection: the id and the detection's fields."""
    return detect(df, text_col, "__found", **options).select(F.col(id_col), F.explode("__found").alias("d")).select(id_col, "d.*")
