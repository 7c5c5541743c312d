"""Format-preserving pseudonyms for personal data (DataFrame and SQL functions only).

Numbers and dates are found by shape, validated, and permuted with a keyed
Feistel network within their own format, so equal values stay linked across
documents and the result is a valid value of the kind:

* card numbers (13 to 19 digits, Luhn valid): the digits but the last are permuted, the check digit is computed
* North American phones (ten digits after +1, or domestic (ddd) ddd-dddd, ddd-ddd-dddd and the like): area, exchange and
  line are permuted within the valid codes; numbers with an invalid area, or else exchange, within those that have one
* IPv4 addresses (octets up to 255): permuted as one 32-bit number
* social security numbers (valid areas): permuted within the valid numbers
* ISO dates (valid days of 1800 to 2199), alone or before a time: permuted among the days of these 400 years
* IBANs (valid mod 97): the account digits are permuted, the check digits computed; each start of an IBAN is tried at
  its country's length first, so what stands before or after one neither hides it nor is hidden by it
* mail addresses: the local part's digits, lower and upper letters are permuted within their classes, the domain stays
* assigned secrets (token, key, secret, password = long value): hex digits, else each class, are permuted the same way

Values that fail validation are not personal data of these kinds and stay as
they are, as does everything else in the text.  Every permutation is one of its
whole format, so different values never share a pseudonym; one may
map a value to itself with the odds of chance.

The key is a parameter, else the session setting ``spark.veilframe.pii.key``; without either it is an error.
What stands in the plan is a key derived from it for this operator.

Nulls: a null text stays null; a null id is kept.  Empty texts stay empty and empty tables empty;
texts may hold the marks U+E000 to U+E004 that the scan uses (they are escaped).  A very long text is
scanned whole.  Repeated rows are each answered.  Columns other than the text are kept as they are,
whatever their names.
"""

from __future__ import annotations

import hashlib
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import documents

ROUNDS = 10
KEY_SETTING = "spark.veilframe.pii.key"
#: Key of the registered queries where the session names none; it is published here, so it hides nothing.
QUERY_KEY = "registered-queries"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Around a candidate, escape, and around an IBAN that is permuted already.
_A, _B, _E, _C, _D = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Shapes of candidates, most specific first; word boundaries are explicit.
SHAPES = {
    "secret": r"(?i:token|secret|api_?key|password)[ ]?[=:][ ]?[\"'][A-Za-z0-9_\-]{16,128}[\"']",
    "email": r"[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "phone": r"(?:\+1[ .\-]?\(?[0-9]{3}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}|(?:1[ .\-])?(?:\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-]?|[0-9]{3}[ .\-][0-9]{3}[.\-])[0-9]{4})",
    "ipv4": rf"{_OCTET}(?:\.{_OCTET}){{3}}",
    "date": r"(?:18|19|20|21)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?",
    "card": r"(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){2}[ \-][0-9]{1,7}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})",
}
#: Characters of an IBAN by country (SWIFT registry).
IBAN_LENGTH = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_BEFORE, _AFTER = r"(?<![A-Za-z0-9_.%+\-])", r"(?![A-Za-z0-9_]|[.\-][0-9])"
_COUNTRIES = [rf"(?:{x.replace(' ', '|')})[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"[ ]?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, x in IBAN_LENGTH.items()]
#: At every start, overlapping ones too, what an IBAN there would be.
_IBANS = rf"{_BEFORE}(?=((?:{'|'.join(_COUNTRIES)}){_AFTER}|{SHAPES['iban']}{_AFTER}))"
_SCAN = rf"{_C}[^{_D}]*{_D}|{_BEFORE}(?:{'|'.join(v for k, v in SHAPES.items() if k != 'iban')}){_AFTER}|{_BEFORE}{SHAPES['date']}(?=[Tt][0-9])"


def _digest(key: str, kind: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), *parts), 256)


def _number(hexes: Column) -> Column:
    return F.conv(F.substring(hexes, 1, 13), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """Keyed permutation of Z_a x Z_b: struct (l, r)."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(s, i):
        f = lambda half: _number(_digest(key, kind, i.cast("string"), half.cast("string"), a.cast("string"), b.cast("string")))
        return F.struct(F.when(i % 2 == 0, F.pmod(s["l"] + F.pmod(f(s["r"]), a), a)).otherwise(s["l"]).alias("l"), F.when(i % 2 == 1, F.pmod(s["r"] + F.pmod(f(s["l"]), b), b)).otherwise(s["r"]).alias("r"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn)


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _put(shape: Column, chars: Column, what: str) -> Column:
    """``shape`` with its characters of the class replaced, in order, by those of ``chars``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda s, c: F.when(c.rlike(what), F.struct(F.concat(s["out"], F.substr(chars, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def _permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Digits of any even spread up to 36: both halves are permuted together."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    left, right = F.substr(digits, F.lit(1), h), F.substr(digits, h + 1, n)
    a, b = F.pow(F.lit(10.0), h).cast("long"), F.pow(F.lit(10.0), n - h).cast("long")
    p = feistel(left.cast("long"), right.cast("long"), a, b, key, kind)
    return F.concat(F.lpad(p["l"].cast("string"), h, F.lit("0")), F.lpad(p["r"].cast("string"), n - h, F.lit("0")))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits that a check digit still follows."""
    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, F.element_at(F.array(*map(F.lit, [0, 2, 4, 6, 8, 1, 3, 5, 7, 9])), c.cast("int") + 1)).otherwise(c.cast("int"))), F.lit(0), lambda s, x: s + x)


def _card(x: Column, key: str) -> Column:
    d = _digits(x)
    body = _permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
    return F.transform(F.array(body), lambda p: _put(x, F.concat(p, F.pmod(F.lit(10) - luhn_sum(p) % 10, F.lit(10)).cast("string")), "[0-9]"))[0]


def _phone(x: Column, key: str) -> Column:
    """Three domains: valid area and exchange, area below 200, and exchange below 200 after a valid area."""
    digits = _digits(x)
    d = F.substring(digits, -10, 10)
    area, rest = F.substring(d, 1, 3).cast("long"), F.substring(d, 4, 7).cast("long")
    low_area, low_exchange = area < 200, rest < 2_000_000
    first = F.when(low_area, _long(0)).otherwise(_long(200))
    second = F.when(low_area | low_exchange, _long(0)).otherwise(_long(2_000_000))
    a = F.when(low_area, _long(200)).otherwise(_long(800))
    b = F.when(low_area, _long(10_000_000)).when(low_exchange, _long(2_000_000)).otherwise(_long(8_000_000))
    p = feistel(area - first, rest - second, a, b, key, "phone")
    new = lambda q: F.concat(F.substr(digits, F.lit(1), F.length(digits) - 10), F.lpad((q["l"] + first).cast("string"), 3, "0"), F.lpad((q["r"] + second).cast("string"), 7, "0"))
    return F.transform(F.array(p), lambda q: _put(x, new(q), "[0-9]"))[0]


def _ipv4(x: Column, key: str) -> Column:
    o = F.transform(F.split(x, r"\."), lambda v: v.cast("long"))
    p = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], _long(65536), _long(65536), key, "ipv4")
    return F.transform(F.array(p), lambda q: F.concat_ws(".", *[v.cast("string") for v in (F.floor(q["l"] / 256), q["l"] % 256, F.floor(q["r"] / 256), q["r"] % 256)]))[0]


def _date(x: Column, key: str) -> Column:
    """The 146,097 days from 1800 to 2199 are 9 x 16,233."""
    n = F.datediff(F.try_to_date(x, "yyyy-MM-dd"), F.lit("1800-01-01").cast("date")).cast("long")
    p = feistel(F.floor(n / 16233), n % 16233, _long(9), _long(16233), key, "date")
    return F.transform(F.array(p), lambda q: F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), (q["l"] * 16233 + q["r"]).cast("int")), "yyyy-MM-dd"))[0]


def _area(x: Column) -> Column:
    """Valid areas 1 to 899 without 666, as 0 to 897."""
    return F.when(x > 666, x - 2).otherwise(x - 1)


def _ssn(x: Column, key: str) -> Column:
    area, rest = F.substring(x, 1, 3).cast("long"), (F.substring(x, 5, 2).cast("long") - 1) * 9999 + F.substring(x, 8, 4).cast("long") - 1
    p = feistel(_area(area), rest, _long(898), _long(99 * 9999), key, "ssn")
    back = lambda q: F.concat_ws("-", F.lpad(F.when(q["l"] >= 665, q["l"] + 2).otherwise(q["l"] + 1).cast("string"), 3, "0"), F.lpad((F.floor(q["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((q["r"] % 9999 + 1).cast("string"), 4, "0"))
    return F.transform(F.array(p), back)[0]


def mod97(s: Column) -> Column:
    """The remainder of a string of digits and capitals (A is 10)."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(s, ""), F.lit(0), lambda r, c: (r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def _iban(x: Column, key: str) -> Column:
    s = F.replace(x, F.lit(" "), F.lit(""))
    country, account = F.substring(s, 1, 2), F.substr(s, F.lit(5), F.length(s))
    body = _put(account, _permuted_digits(_digits(account), key, "iban"), "[0-9]")
    whole = lambda b: F.concat(country, F.lpad((F.lit(98) - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)
    return F.transform(F.array(body), lambda b: _put(x, whole(b), "[0-9A-Z]"))[0]


def _iban_valid(x: Column) -> Column:
    s = F.replace(x, F.lit(" "), F.lit(""))
    return (F.length(s) >= 15) & (F.length(_digits(x)) >= 8) & (mod97(F.concat(F.substr(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1)


def _ibans(text: Column, key: str) -> Column:
    """The text with its IBANs permuted, each between marks."""
    found = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(_IBANS), 1)), _iban_valid)
    put = lambda t, x: F.regexp_replace(t, F.concat(F.lit(_BEFORE.replace("_", "_" + _C)), x, F.lit(_AFTER)), F.concat(F.lit(_C), _iban(x, key), F.lit(_D)))
    return F.when(text.rlike(_IBANS), F.aggregate(found, text, put)).otherwise(text)


def _moved(half: Column, seed: Column, classes: tuple[str, ...]) -> Column:
    """Each character moved within its class by a byte of the seed."""

    def move(c, j):
        by, out = F.conv(F.substr(seed, j * 2 + 1, F.lit(2)), 16, 10).cast("int"), c
        for chars in classes:
            at = F.instr(F.lit(chars), c)
            out = F.when((c != "") & (at > 0), F.substr(F.lit(chars), F.pmod(at - 1 + by, F.lit(len(chars))) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(half, ""), move), "")


def _permuted_text(x: Column, key: str, kind: str, classes: tuple[str, ...]) -> Column:
    """Keyed permutation of the texts of one pattern of classes (128 characters at most): a half moves by a digest of the other."""
    h = F.floor(F.length(x) / 2).cast("int")
    start = F.struct(F.substr(x, F.lit(1), h).alias("l"), F.substr(x, h + 1, F.length(x)).alias("r"))

    def turn(s, i):
        seed = lambda half: F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), i.cast("string"), half), 512)
        return F.struct(F.when(i % 2 == 0, _moved(s["l"], seed(s["r"]), classes)).otherwise(s["l"]).alias("l"), F.when(i % 2 == 1, _moved(s["r"], seed(s["l"]), classes)).otherwise(s["r"]).alias("r"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _email(x: Column, key: str) -> Column:
    at = F.instr(x, "@")
    return F.concat(_permuted_text(F.substr(x, F.lit(1), at - 1), key, "email", (_DIGITS, _LOWER, _UPPER)), F.substr(x, at, F.length(x)))


def _secret(x: Column, key: str) -> Column:
    value = F.regexp_extract(x, "[\"']([^\"']+)[\"']$", 1)
    new = (
        F.when(value.rlike("^[0-9a-f]+$"), _permuted_text(value, key, "secret", (_DIGITS + _LOWER[:6],)))
        .when(value.rlike("^[0-9A-F]+$"), _permuted_text(value, key, "secret", (_DIGITS + _UPPER[:6],)))
        .otherwise(_permuted_text(value, key, "secret", (_DIGITS, _LOWER, _UPPER)))
    )
    return F.concat(F.substr(x, F.lit(1), F.length(x) - F.length(value) - 1), new, F.substr(x, F.length(x), F.lit(1)))


def _kinds(key: str) -> list[tuple[str, Column, callable]]:
    """(kind, validity of a candidate, its pseudonym) in the order of trial."""

    def build(x):
        digits = _digits(x)
        whole = lambda name: x.rlike("^(?:" + SHAPES[name] + ")$")
        area = F.substring(x, 1, 3).cast("int")
        return [
            ("secret", whole("secret"), _secret(x, key)),
            ("email", x.contains("@"), _email(x, key)),
            ("phone", whole("phone"), _phone(x, key)),
            ("ipv4", whole("ipv4"), _ipv4(x, key)),
            ("date", whole("date") & F.try_to_date(x, "yyyy-MM-dd").isNotNull(), _date(x, key)),
            ("ssn", whole("ssn") & area.between(1, 899) & (area != 666) & (F.substring(x, 5, 2) != "00") & (F.substring(x, 8, 4) != "0000"), _ssn(x, key)),
            ("iban", x.startswith(_C), F.translate(x, _C + _D, "")),
            ("card", whole("card") & digits.rlike("[1-9]") & (F.pmod(F.lit(10) - luhn_sum(F.substr(digits, F.lit(1), F.length(digits) - 1)) % 10, F.lit(10)) == F.substr(digits, F.length(digits), F.lit(1)).cast("int")), _card(x, key)),
        ]

    return build


def _kind_and_value(key: str):
    def one(x):
        out = F.struct(F.lit(None).cast("string").alias("kind"), x.alias("value"))
        for kind, valid, new in reversed(_kinds(key)(x)):
            out = F.when(valid, F.struct(F.lit(kind).alias("kind"), new.alias("value"))).otherwise(out)
        return out

    return one


def session_key(spark: SparkSession) -> str:
    """The session's key; without one the published key of the queries, with a warning."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are keyed by a published key and hide nothing", stacklevel=2)
    return key or QUERY_KEY


def derived_key(key: str) -> str:
    return hashlib.sha256(b"feistel pseudonyms\x1f" + key.encode()).hexdigest()


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str | None = None, kinds_col: str | None = None) -> DataFrame:
    """The rows with the text's personal data replaced; ``kinds_col`` adds the kinds found, in order."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"give a key or set {KEY_SETTING}")
    key, text, scan = derived_key(key), F.col(text_col), "__pii"
    while scan in (*docs.columns, kinds_col):
        scan += "_"
    marked = text.rlike(f"[{_A}-{_D}]")
    escaped = F.when(marked, F.regexp_replace(F.replace(text, F.lit(_E), F.lit(_E + "2")), f"[{_A}{_B}{_C}{_D}]", f"{_E}$0")).otherwise(text)
    escaped = F.when(marked, F.translate(escaped, _A + _B + _C + _D, "0134")).otherwise(escaped)
    parts = F.split(F.regexp_replace(_ibans(escaped, key), _SCAN, f"{_A}$0{_B}"), f"[{_A}{_B}]", -1)
    pairs = F.transform(parts, lambda x, i: F.when(i % 2 == 1, _kind_and_value(key)(x)).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), x.alias("value"))))
    joined = F.array_join(F.transform(F.col(scan), lambda p: p["value"]), "")
    back = joined
    for mark, c in ((_A, "0"), (_B, "1"), (_C, "3"), (_D, "4"), (_E, "2")):
        back = F.replace(back, F.lit(_E + c), F.lit(mark))
    restored = F.when(marked, back).otherwise(joined)
    possible = text.rlike("[0-9@]|(?i:secret|password|token|key)")
    out = docs.withColumn(scan, F.when(possible, pairs))
    kinds = F.coalesce(F.filter(F.transform(F.col(scan), lambda p: p["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    if kinds_col:
        out = out.withColumn(kinds_col, kinds)
    new = F.when(F.col(scan).isNull(), text).otherwise(restored)
    return out.withColumn(text_col, new).drop(scan)


def op9_feistel_pii(spark, sf_dir):
    out = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key=session_key(spark), kinds_col="kinds")
    return out.select("doc_id", "text", F.size("kinds").cast("long").alias("n_pii"), F.array_join("kinds", ",").alias("kinds"))
