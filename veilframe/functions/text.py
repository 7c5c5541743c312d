"""Text functions as Column expressions.

All are null in, null out.  Compatibility normalisation has no built-in: one
Arrow UDF does it, and texts of characters that it leaves as they are (ASCII,
plain Arabic, most of Latin, Greek, Cyrillic, CJK) are given to it as null, so
they do not pay for it.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .. import fixed

_FOREIGN = fixed.ARABIC_INDIC + fixed.PERSIAN


def is_ascii(s: Column) -> Column:
    """As many bytes as characters; the text is not decoded for it."""
    return F.octet_length(s) == F.length(s)


def _stable_ranges() -> list[tuple[int, int]]:
    """Ranges of characters of common scripts that are their own compatibility form, no marks and no tatweel."""
    out: list[tuple[int, int]] = []
    for lo, hi in ((0x600, 0x6FF), (0x80, 0x17F), (0x370, 0x4FF), (0x2010, 0x203F), (0x20A0, 0x20BF), (0x3001, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)):
        for n in range(lo, hi + 1):
            c = chr(n)
            if unicodedata.normalize("NFKC", c) == c and unicodedata.category(c)[0] != "M" and unicodedata.category(c) != "Cn" and n != 0x640:
                out[-1:] = [(out[-1][0], n)] if out and out[-1][1] == n - 1 else [*out[-1:], (n, n)]
    return out


_STABLE = "\\A[\\x00-\\x7F" + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in _stable_ranges()) + "]*\\z"


def is_stable(s: Column) -> Column:
    """Whether every character is its own compatibility form and none is dropped for matching (sound, not complete)."""
    return is_ascii(s) | s.rlike(_STABLE)


def fold_digits(s: Column) -> Column:
    return F.translate(s, _FOREIGN, "0123456789" * 2)


def ascii_digit(c: Column) -> Column:
    folded = fold_digits(c)
    return F.when(folded.rlike(r"\A[0-9]\z"), folded)


def digits_only(s: Column) -> Column:
    return F.regexp_replace(fold_digits(s), "[^0-9]", "")


def alnum_upper(s: Column) -> Column:
    return F.upper(F.regexp_replace(fold_digits(s), "[^0-9A-Za-z]", ""))


def is_arabic_letter(c: Column) -> Column:
    return c.rlike(rf"\A[{fixed.ARABIC_LETTERS}]\z")


def has_arabic(s: Column) -> Column:
    return ~is_ascii(s) & s.rlike(f"[{fixed.ARABIC_LETTERS}]")


def is_arabic_word(s: Column) -> Column:
    """Arabic letters, spaces, dashes, joiners and marks only, one Arabic letter at least."""
    return has_arabic(s) & s.rlike(rf"\A[{fixed.ARABIC_LETTERS}\s\-\u200c\u200d\p{{M}}]*\z")


def scrub(s: Column) -> Column:
    """Without invisible characters, Cyrillic look-alikes as Latin letters."""
    return F.when(is_ascii(s), s).otherwise(F.translate(F.regexp_replace(s, fixed.INVISIBLE, ""), "".join(fixed.LOOKALIKES), "".join(fixed.LOOKALIKES.values())))


def reverse_arabic_runs(s: Column) -> Column:
    """Every run of Arabic letters back to front, in place."""
    parts = F.split(F.regexp_replace(s, f"([{fixed.ARABIC_LETTERS}]+)", "\ue000$1\ue000"), "\ue000", -1)
    return F.when(has_arabic(s), F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.reverse(p)).otherwise(p)), "")).otherwise(s)


def strip_particles(s: Column) -> Column:
    """Without one Arabic prefix particle, where three characters remain."""
    out = s
    for particle in reversed(fixed.PARTICLES):
        out = F.when(s.startswith(particle) & (F.length(s) >= len(particle) + 3), F.substr(s, F.lit(len(particle) + 1), F.length(s))).otherwise(out)
    return F.when(s.isNotNull(), out)


@pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def fold_arabic(s: Column) -> Column:
    """Marks and tatweel dropped, letters unified, digits folded, white space collapsed, lower case (input: compatibility-normal)."""
    plain = F.translate(F.regexp_replace(s, fixed.MARKS, ""), "".join(fixed.LETTER_FOLD), "".join(fixed.LETTER_FOLD.values()))
    return F.lower(F.trim(F.regexp_replace(fold_digits(plain), r"(?U)[\s\x1c-\x1f]+", " ")))


def normalize_arabic(s: Column) -> Column:
    """Canonical form for comparing; the UDF sees rows with unstable characters only."""
    return fold_arabic(F.coalesce(nfkc(F.when(~is_stable(s), s)), s))


VIEW = T.StructType([T.StructField("text", T.StringType()), T.StructField("src", T.ArrayType(T.IntegerType()))])


def _folded_form(x: str) -> tuple[str, list[int]]:
    """The matching view of one text and the source place of each of its characters."""
    out, src = [], []
    for i, ch in enumerate(x):
        for c in ch if ch < "\x80" else _form(ch):
            out.append(c), src.append(i)
    return "".join(out), src


@functools.lru_cache(1 << 16)
def _form(ch: str) -> str:
    fold = {c: str(i % 10) for i, c in enumerate(_FOREIGN)}
    return "".join(fold.get(c, c) for c in unicodedata.normalize("NFKC", ch) if not (0x64B <= ord(c) <= 0x65F or ord(c) == 0x670 or 0x6D6 <= ord(c) <= 0x6ED or ord(c) == 0x640))


@pandas_udf(T.ArrayType(VIEW))
def _views(s: pd.Series) -> pd.Series:
    def one(x):
        if x is None:
            return None
        text, src = _folded_form(x)
        return {"text": text, "src": src}

    return s.map(lambda xs: None if xs is None else [one(x) for x in xs])


#: Marked non-deterministic so that the planner keeps it a column of its own: a view of a
#: text that itself comes from a view (a second pass over redacted text) is then not
#: merged into one projection, which cannot be split into two Python steps again.
_bound_views = _views.asNondeterministic()


def unstable_views(texts: Column) -> Column:
    """For an array of texts: struct(text, src) of what detectors read, null where the text is stable (see ``stable_view``); null where all are."""
    asked = F.transform(texts, lambda s: F.when(~is_stable(s), s))
    return _bound_views(F.when(F.exists(asked, lambda s: s.isNotNull()), asked))


def stable_view(s: Column) -> Column:
    """The matching view of a text of stable characters: digits folded, every character in its place."""
    return F.when(is_ascii(s) | ~s.rlike(f"[{_FOREIGN}]"), s).otherwise(fold_digits(s))


def normalize_for_kind(kind: Column, value: Column, compat: Column | None = None) -> Column:
    """The form that tokens are keyed on; ``compat`` is the compatibility-normal value."""
    whole = fold_arabic(compat if compat is not None else F.coalesce(nfkc(F.when(~is_stable(value), value)), value))
    strip = F.regexp_replace(value, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    return F.when(kind == "EMAIL", F.lower(strip)).when(kind.isin("PHONE", "COMMERCIAL_REGISTRATION", "TAX_NUMBER", "NATIONAL_ID"), digits_only(value)).when(kind == "IBAN", alnum_upper(value)).otherwise(whole)


def public_key(folded: Column) -> Column:
    """Words of a folded term, upper case, joined by a space."""
    kept = F.upper(F.regexp_replace(folded, r"[^0-9A-Za-z؀-ۿ]+", " "))
    return F.trim(kept)


def title_variant(s: Column) -> Column:
    """The first letter of each run of A-Z or a-z in upper case, all else as it is."""
    parts = F.split(F.regexp_replace(s, "([A-Za-z]+)", "\ue000$1"), "\ue000", -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i > 0, F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2), F.length(p)))).otherwise(p)), "")


def should_augment(s: Column, mode: str = "auto") -> Column:
    if mode == "off":
        return F.lit(False)
    return s.rlike("[a-z]") if mode == "always" else s.rlike("[a-z]") & ~s.rlike("[A-Z]")


def safe_split(s: Column) -> Column:
    """How many characters may leave now: all but a last run that may be a token in the making."""
    run = F.length(F.regexp_extract(s, r"[A-Z0-9_]*\z", 0))
    return F.when(run > fixed.CARRY_LIMIT, F.length(s)).otherwise(F.length(s) - run)


def pointer_escape(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def xml_escape(s: Column) -> Column:
    out = s
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def path_hash(s: Column) -> Column:
    return F.sha2(s, 256)


def folder_name(s: Column) -> Column:
    """A working folder as a name: everything but letters and digits is a dash."""
    return F.regexp_replace(s, "[^A-Za-z0-9]", "-")


def json_int(value: Column, default: int = 0) -> Column:
    """A whole JSON number's text as an int; anything else (a string, a bool, a fraction) gives the default."""
    return F.when(value.rlike(r"\A-?[0-9]{1,18}\z"), value.cast("long")).otherwise(F.lit(default).cast("long"))


def lf_lines(s: Column) -> Column:
    """Lines that end at a line feed alone, not at other separators."""
    return F.split(s, "\n", -1)


def byte_to_char(text: Column, offset: Column) -> Column:
    """The code point at a UTF-8 byte offset; null inside a character."""
    head = F.substr(F.encode(text, "UTF-8"), F.lit(1), offset)
    return F.when(F.is_valid_utf8(head.cast("string")), F.length(F.decode(head, "UTF-8")))


def normalize_header(h: str) -> str:
    return " ".join(h.strip().lower().split()).lstrip("\ufeff")
