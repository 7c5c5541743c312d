"""What keys and headers say of their values, at plan time."""

from __future__ import annotations

from .. import fixed
from ..functions import text


def _has(key: str, terms: list[str]) -> bool:
    parts = key
    for c in "-. /":
        parts = parts.replace(c, "_")
    parts = parts.split("_")
    return any(t in parts if t.isascii() and not any(c in t for c in "_-. /") else t in key for t in terms)


def key_kind(key: str | None, letters: bool = True) -> str | None:
    """The kind that a key's values hold; ``letters``: the value has a letter."""
    if key is None:
        return None
    key = key.lower()
    if _has(key, fixed.KEYS_SKIPPED):
        return None
    for kind, terms in fixed.KEY_GROUPS:
        if _has(key, terms) and (kind != "PERSON" or letters):
            return kind
    return None


def header_kind(header: str) -> str | None:
    """The kind that a table column's cells hold."""
    h = text.normalize_header(header)
    if h.endswith((".id", ".module")):
        return None
    if any(t in h for t in fixed.HEADER_EMAIL) and not any(t in h for t in fixed.HEADER_EMAIL_NOT):
        return "EMAIL"
    if any(t in h for t in fixed.HEADER_PHONE) or h in fixed.HEADER_PHONE_EXACT:
        return "PHONE"
    if h.endswith(tuple(fixed.HEADER_ADDRESS)):
        return "ADDRESS"
    if h in fixed.HEADER_PERSON or ("name" in h and not any(t in h for t in fixed.HEADER_PERSON_NOT)):
        return "PERSON"
    return "ORGANIZATION" if h in fixed.HEADER_ORGANIZATION else None


def table_kinds(columns: list[str]) -> dict[str, int]:
    """How many columns of a table hold each kind."""
    out: dict[str, int] = {}
    for k in map(header_kind, columns):
        if k:
            out[k] = out.get(k, 0) + 1
    return out
