"""Typed structures and tables: keys and headers decide at plan time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions import checks, text
from ..model import Policy
from . import detect as D
from . import restore, spans, tokens
from .keys import header_kind, key_kind, table_kinds

__all__ = ["header_kind", "key_kind", "key_kind_column", "redact_structured", "redact_table", "restore_structured", "table_kinds"]


def key_kind_column(key: Column, value: Column) -> Column:
    """The same for a column of keys."""
    low = F.lower(key)
    parts = F.split(F.translate(low, "-. /", "____"), "_")
    has = lambda terms: F.arrays_overlap(parts, F.array(*[F.lit(t) for t in terms if t.isascii() and not any(c in t for c in "_-. /")] or [F.lit(None).cast("string")])) | _contains(low, [t for t in terms if not (t.isascii() and not any(c in t for c in "_-. /"))])
    out = F.lit(None).cast("string")
    for kind, terms in reversed(fixed.KEY_GROUPS):
        hit = F.coalesce(has(terms), F.lit(False))
        out = F.when(hit & value.rlike(r"\p{L}") if kind == "PERSON" else hit, kind).otherwise(out)
    return F.when(~F.coalesce(has(fixed.KEYS_SKIPPED), F.lit(False)), out)


def _contains(s: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | s.contains(t)
    return out


def _scan_inline(value: Column, secret: str, tenant: str, which) -> Column:
    """Detect and replace inside a nested leaf: built-ins only, so the view folds digits but has no compatibility forms."""

    def of(v):
        found = D.kept(D.scan(v, text.stable_view(spans.unmarked(v)), F.lit(None).cast("array<int>"), which))
        return spans.splice(v, tokens.edits_of(v, found, secret, tenant, None, Policy()))

    return F.when(value.isNotNull(), F.transform(F.array(text.scrub(value)), of)[0])


def redact_leaf(value: Column, key: str | None, secret: str, tenant: str = "", which=D.DETECTORS) -> Column:
    """One string leaf: tokens stay, a telling key makes the whole value a token, other text is scanned."""
    kind = key_kind(key, True)
    plain = _scan_inline(value, secret, tenant, which)
    if kind is not None:
        whole = tokens.derive(F.lit(kind), text.normalize_for_kind(F.lit(kind), value, value), secret, tenant)
        second = key_kind(key, False)
        if kind == "PERSON" and second != kind:
            whole = F.when(value.rlike(r"\p{L}"), whole).otherwise(plain)
        plain = whole
    return F.when(value.isNull() | checks.kept_value(value), value).otherwise(plain)


def redact_column(value: Column, kind: T.DataType, key: str | None, leaf) -> Column:
    """Walks a column's type; every STRING leaf goes through ``leaf(value, key)``. List items have their list's key."""
    if isinstance(kind, T.StringType):
        return leaf(value, key)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[redact_column(value[f.name], f.dataType, f.name, leaf).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redact_column(x, kind.elementType, key, leaf))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return F.transform_values(value, lambda k, v: redact_column(v, kind.valueType, key, leaf))
    return value


def redact_structured(df: DataFrame, secret: str, tenant: str = "", columns: list[str] | None = None, which=D.DETECTORS) -> DataFrame:
    """All string leaves of the given columns (default: all), nested ones too."""
    leaf = lambda v, k: redact_leaf(v, k, secret, tenant, which)
    return df.select(*[redact_column(F.col(f"`{f.name}`"), f.dataType, f.name, leaf).alias(f.name) if columns is None or f.name in columns else F.col(f"`{f.name}`") for f in df.schema.fields])


def restore_structured(df: DataFrame, vault: DataFrame, columns: list[str] | None = None, fuzzy: bool = True) -> DataFrame:
    """All string leaves of the given columns (default: all), nested ones too, with their tokens restored; keys of maps stay."""
    names = [f.name for f in df.schema.fields if columns is None or f.name in columns]
    found = restore.look_up(df.withColumn("__all", F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]))), F.col("__all"), vault, fuzzy)
    leaf = lambda v, _: F.when(v.isNotNull(), restore.with_values(v, F.col("__found")))
    return found.select(*[redact_column(F.col(f"`{f.name}`"), f.dataType, f.name, leaf).alias(f.name) if f.name in names else F.col(f"`{f.name}`") for f in df.schema.fields])


def redact_table(df: DataFrame, secret: str, tenant: str = "", which=D.DETECTORS) -> DataFrame:
    """String columns by their headers: whole cells as tokens, other cells scanned if they may hold something; blanks stay.

    The cells of all other string columns are one array, which one scan reads.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    told = {n: k for n in names if (k := header_kind(n)) is not None}
    plain = [n for n in names if n not in told]
    cell = lambda n: F.col(f"`{n}`")
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    new = {n: F.when(blank(cell(n)), cell(n)).otherwise(tokens.token_for(k, cell(n), secret, tenant)) for n, k in told.items()}
    out = df
    if plain:
        scrubbed = F.transform(F.array(*[F.when(~blank(cell(n)) & checks.may_be_personal(cell(n)), cell(n)) for n in plain]), text.scrub)
        out = D.detect_all(out.withColumn("__cells", scrubbed), F.col("__cells"), "__found", which)
        done = F.transform("__cells", lambda c, i: spans.splice(c, tokens.edits_of(c, D.kept(F.get("__found", i)), secret, tenant)))
        out = out.withColumn("__done", done)
        new |= {n: F.coalesce(F.get("__done", F.lit(i)), cell(n)) for i, n in enumerate(plain)}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns])
