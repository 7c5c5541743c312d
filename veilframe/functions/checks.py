"""Checksums and gates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import alnum_upper, digits_only, fold_arabic, fold_digits, is_ascii


def luhn(digits: Column) -> Column:
    """ASCII digits with a valid check digit; all zeros are not."""
    return F.when(digits.rlike(r"\A[0-9]*[1-9][0-9]*\z"), F.call_function("luhn_check", digits)).otherwise(F.lit(False))


def mod97(s: Column) -> Column:
    """Remainder of digits and capitals, A as 10; -1 for any other character."""
    step = lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.when(s.rlike(r"\A[0-9A-Z]*\z"), F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), step)).otherwise(-1)


def valid_iban(value: Column) -> Column:
    s = alnum_upper(value)
    length = F.lit(None).cast("int")
    for country, n in fixed.IBAN_LENGTH.items():
        length = F.when(F.substring(s, 1, 2) == country, n).otherwise(length)
    return F.coalesce((F.length(s) == length) & (mod97(F.concat(F.substr(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1), F.lit(False))


def kuwait_mod11(digits: Column) -> Column:
    total = F.lit(0)
    for i, w in enumerate(fixed.KUWAIT_WEIGHTS):
        total = total + F.substring(digits, i + 1, 1).cast("int") * w
    check = 11 - total % 11
    return F.when(digits.rlike(r"\A[23][0-9]{11}\z"), (check <= 9) & (check == F.substring(digits, 12, 1).cast("int"))).otherwise(F.lit(False))


def plausible_phone(raw: Column) -> Column:
    """A Gulf number by its marker and code, or a local mobile shape."""
    folded, d = fold_digits(raw), digits_only(raw)
    codes = "|".join(fixed.GULF_CODES)
    marked = (folded.contains("+") | d.startswith("00") | F.substring(folded, 1, 5).contains("(")) & d.rlike(rf"\A(?:00)?(?:{codes})")
    local = ~folded.contains(".") & (d.rlike(r"\A0?5") | ((F.length(d) == 12) & d.rlike(rf"\A(?:{codes})")))
    return F.length(d).between(8, 14) & F.when(marked, F.length(d) >= 9).otherwise(local)


def no_digit_beside(before: Column, after: Column) -> Column:
    digit = f"[0-9{fixed.ARABIC_INDIC}{fixed.PERSIAN}]"
    return ~before.rlike(digit) & ~after.rlike(digit)


def registration_shape(value: Column) -> Column:
    """Some ASCII or Arabic-Indic digit, but not 15 of them and nothing else."""
    return value.rlike(f"[0-9{fixed.ARABIC_INDIC}]") & ~value.rlike(rf"\A[0-9{fixed.ARABIC_INDIC}]{{15}}\z")


def tax_document(text: Column) -> Column:
    low, out = F.lower(text), F.lit(False)
    for t in fixed.TAX_DOCUMENT_LATIN:
        out = out | low.contains(t)
    for t in fixed.TAX_DOCUMENT_ARABIC:
        out = out | text.contains(t)
    return out


def one_character(value: Column) -> Column:
    return value == F.repeat(F.substring(value, 1, 1), F.length(value))


def address_value(value: Column) -> Column:
    """Not a form label or boilerplate (the value comes from the matching view, which is compatibility-normal)."""
    folded, low, bad = fold_arabic(value), F.lower(value), F.lit(False)
    for t in fixed.ADDRESS_STOP_NORMAL:
        bad = bad | folded.contains(t)
    for t in fixed.ADDRESS_STOP_LOWER:
        bad = bad | low.contains(t)
    return ~bad


def is_placeholder(value: Column) -> Column:
    return F.trim(value).rlike(rf"\A(?:{fixed.PLACEHOLDER_BARE})\z")


def kept_value(value: Column) -> Column:
    """A whole value that is a token already."""
    return F.trim(value).rlike(fixed.KEPT_VALUE)


def may_be_personal(cell: Column) -> Column:
    """A cell worth scanning: an @ or seven digits."""
    return cell.contains("@") | (F.length(F.regexp_replace(cell, r"[^\p{Nd}]", "")) >= 7)


def raw_shape(text: Column) -> Column:
    """Whether raw personal data is left once tokens are taken out (text: scrubbed and digit-folded).

    A shape is looked for where what it cannot do without is there; in ASCII text
    the Unicode classes are the plain ones, which are faster.
    """
    bare, out = F.regexp_replace(text, fixed.PLACEHOLDER, ""), F.lit(False)
    bare = F.when(text.contains("_"), bare).otherwise(text)
    ascii_only, digits = is_ascii(text), text.rlike(r"(?U)\d")
    needs = [bare.contains("@"), digits, digits, digits, bare.contains("784"), digits, bare.rlike("(?iU)sk-|akia|key|secret|token")]
    for p, need in zip(fixed.LEAK_SHAPES, needs, strict=True):
        plain = p.replace("(?U)", "").replace("(?iU)", "(?i)")
        out = out | (need & F.when(ascii_only, bare.rlike(plain)).otherwise(bare.rlike(p)))
    return out
