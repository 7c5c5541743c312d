"""Free JSON and CSV bodies: their strings out, native work on them, their strings back.

What stands in a JSON text is not known at plan time, so an Arrow UDF lists its
strings and another puts changed ones back; everything between is Columns on one
array of texts a row.  Which strings a walk lists, and what a string's place
says about it, is a table of roles: a role names the roles of a value's parts.

Walks: ``keys`` takes every string with the kind that its key tells (list items
have their list's key), ``request`` the texts of a chat request and nothing
structural, ``strings`` every string, ``headers`` the cells of a CSV text, of
which the first row tells the kinds.
"""

from __future__ import annotations

import csv
import io
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .. import fixed
from ..functions import text
from ..model import Policy
from . import detect as D
from . import restore as R
from . import spans, tokens
from .keys import header_kind, key_kind
from .tables import free

#: Role -> roles of the named parts; "*" stands for all others.  A list has its items in its own role, or in the role after ">".
ROLES = {
    "any": {"*": "any"},
    "body": {"system": "content", "input": "content", "instructions": "content", "messages": ">message"},
    "message": {"content": "content", "tool_calls": ">call"},
    "content": {"text": "text", "output": "text", "refusal": "text", "arguments": "text", "content": "content", "input": "inner"},
    "inner": {"*": "any"},
    "call": {"function": "function"},
    "function": {"arguments": "text"},
}
#: Roles whose strings are a person's words, and roles that a list hands on to its items.
_WORDS, _LISTS = {"any", "content", "text"}, {"any", "content", "inner"}
_START = {"strings": "any", "request": "body"}

LEAVES = T.StructType([T.StructField("items", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("text", "kind", "compat")]))), T.StructField("error", T.StringType())])
PUT = T.StructType([T.StructField("body", T.StringType()), T.StructField("error", T.StringType())])
#: Said of an item that stays as it is.
STAYS = "stays"
_KEPT = re.compile(fixed.KEPT_VALUE)


def _places(holder, key, role: str) -> Iterator[tuple[object, object]]:
    """(holder, key) of each string below a place, by role, in the order of the body."""
    value = holder[key]
    if isinstance(value, str):
        if role in _WORDS:
            yield holder, key
    elif isinstance(value, list):
        inner = role[1:] if role[0] == ">" else ("any" if role == "inner" else role) if role in _LISTS else None
        for i in range(len(value)) if inner else ():
            yield from _places(value, i, inner)
    elif isinstance(value, dict) and role in ROLES:
        for k in value:
            part = ROLES[role].get(k, ROLES[role].get("*"))
            if part:
                yield from _places(value, k, part)


def _keyed(holder, key, hint) -> Iterator[tuple[object, object, str | None]]:
    """(holder, key, telling key) of every string."""
    value = holder[key]
    if isinstance(value, str):
        yield holder, key, hint
    elif isinstance(value, (list, dict)):
        for k in range(len(value)) if isinstance(value, list) else value:
            yield from _keyed(value, k, hint if isinstance(value, list) else k)


def _told(value: str, kind: str | None) -> tuple[str, str | None, str | None]:
    return value, kind, unicodedata.normalize("NFKC", value) if kind and kind != STAYS else None


class Body:
    """A parsed body and the places of its strings."""

    def __init__(self, source: str, walk: str):
        self.walk = walk
        if walk == "headers":
            self.rows = list(csv.reader(io.StringIO(source.removeprefix("﻿"), newline="")))
            self.places = [(row, i) for row in self.rows[1:] for i in range(len(row))]
            return
        self.root = [json.loads(source)]
        if walk == "keys":
            self.hinted = list(_keyed(self.root, 0, None))
            self.places = [(h, k) for h, k, _ in self.hinted]
        else:
            self.places = list(_places(self.root, 0, _START[walk]))

    def items(self) -> list[tuple[str, str | None, str | None]]:
        """(text, kind that the place tells or ``stays``, compatibility form where a kind is told)."""
        if self.walk == "headers":
            kinds = list(map(header_kind, self.rows[0])) if self.rows else []
            told = lambda i: kinds[i] if i < len(kinds) else None
            dull = lambda c: not c.strip() or ("@" not in c and sum(x.isdigit() for x in c) < 7)
            return [_told(row[i], STAYS if not row[i].strip() else told(i) or (STAYS if dull(row[i]) else None)) for row, i in self.places]
        if self.walk == "keys":
            return [_told(h[k], STAYS if _KEPT.match(h[k].strip()) else key_kind(hint, any(map(str.isalpha, h[k])))) for h, k, hint in self.hinted]
        return [(h[k], None, None) for h, k in self.places]

    def put(self, new: list[str], indent: int | None = None) -> str:
        for (holder, key), value in zip(self.places, new, strict=True):
            holder[key] = value
        if self.walk == "headers":
            out = io.StringIO()
            csv.writer(out, lineterminator="\n").writerows(self.rows)
            return out.getvalue()
        return json.dumps(self.root[0], ensure_ascii=False, indent=indent)


@pandas_udf(LEAVES)
def _leaves(source: pd.Series, walk: pd.Series) -> pd.DataFrame:
    rows = []
    for s, w in zip(source, walk, strict=True):
        try:
            rows.append(([dict(zip(("text", "kind", "compat"), x, strict=True)) for x in Body(s, w).items()] if s is not None else None, None))
        except (ValueError, csv.Error, RecursionError) as e:
            rows.append((None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["items", "error"])


@pandas_udf(PUT)
def _put(source: pd.Series, walk: pd.Series, new: pd.Series, indent: pd.Series) -> pd.DataFrame:
    rows = []
    for s, w, n, i in zip(source, walk, new, indent, strict=True):
        rows.append((Body(s, w).put(list(n), int(i) if i == i and i is not None else None) if s is not None and n is not None else None, None))
    return pd.DataFrame(rows, columns=["body", "error"])


#: Columns of their own, see ``text.unstable_views``.
_own_leaves, _own_put = _leaves.asNondeterministic(), _put.asNondeterministic()


def _own(column: Column) -> Column:
    """A column that stays one of its own: a Python step cannot read an expression that captures a lambda's variable."""
    return F.when(F.spark_partition_id() >= 0, column)


def redact_bodies(df: DataFrame, body_col: str, walk: str | Column, secret: str, tenant: str = "", policy: Policy = Policy(), which=D.DETECTORS, out: str | None = None, records: str = "records", detections: str = "detections", error: str = "error", indent: int | Column | None = None) -> DataFrame:
    """Replaces the personal data in a body's strings; adds the records, the strings' detections and the error of a body that cannot be read (which becomes null).

    A string whose place tells a kind becomes one token as a whole, a token stays,
    other strings are scrubbed and scanned.
    """
    free(df, records, detections, error)
    walk = F.lit(walk) if isinstance(walk, str) else walk
    body = F.col(f"`{body_col}`")
    df = df.withColumn("__leaves", _own_leaves(body, walk))
    df = D.detect_all(df, F.transform("__leaves.items", lambda x: F.when(x["kind"].isNull(), text.scrub(x["text"]))), "__found", which)

    def piece(x, i):
        scrubbed, kind = text.scrub(x["text"]), x["kind"]
        edits = tokens.edits_of(scrubbed, D.kept(F.get("__found", i)), secret, tenant, None, policy)
        normalized = text.normalize_for_kind(kind, x["text"], x["compat"])
        whole = F.struct(F.lit(0).alias("start"), F.length(x["text"]).alias("end"), tokens.derive(kind, normalized, secret, tenant).alias("new"), kind.alias("kind"), x["text"].alias("value"), normalized.alias("normalized"), F.lit(True).alias("replace"))
        nothing = F.filter(F.array(whole), lambda e: F.lit(False))
        mine = F.when(kind == STAYS, nothing).when(kind.isNotNull(), F.array(whole)).otherwise(edits)
        return F.struct(mine.alias("edits"), F.when(kind.isNull(), scrubbed).otherwise(x["text"]).alias("text"))

    df = df.withColumn("__pieces", F.transform("__leaves.items", piece))
    new = F.transform("__pieces", lambda p: spans.splice(p["text"], p["edits"]))
    df = df.withColumn("__texts", _own(new)).withColumn("__new", _own_put(body, walk, F.col("__texts"), F.lit(None).cast("int") if indent is None else F.lit(indent) if isinstance(indent, int) else indent))
    found = F.flatten(F.transform("__found", lambda f: F.coalesce(D.kept(f), spans.no_detections())))
    return df.withColumns({records: tokens.records_of(F.flatten(F.transform("__pieces", lambda p: p["edits"]))), detections: found, error: F.col("__leaves.error"), out or body_col: F.col("__new.body")}).drop("__leaves", "__found", "__pieces", "__texts", "__new")


def restore_bodies(df: DataFrame, body_col: str, vault: DataFrame, walk: str = "strings", fuzzy: bool = True, out: str | None = None) -> DataFrame:
    """Restores every string of a JSON body (keys stay); a body that cannot be read becomes null."""
    body = F.col(f"`{body_col}`")
    df = R.look_up(df, body, vault, fuzzy).withColumn("__leaves", _own_leaves(body, F.lit(walk)))
    df = df.withColumn("__texts", _own(F.transform("__leaves.items", lambda x: R.with_values(x["text"], F.col("__found")))))
    df = df.withColumn("__new", _own_put(body, F.lit(walk), F.col("__texts"), F.lit(None).cast("int")))
    return df.withColumn(out or body_col, F.col("__new.body")).drop("__found", "__leaves", "__texts", "__new")
