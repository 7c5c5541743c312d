"""Restoring values: exact, then nearest token within two edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..session import stored
from .tables import free, join_by_key

_EXACT = r"(?:EMAIL|PHONE|IBAN|CR|TAX_ID|GOV_ID|PERSON|ORG|ADDRESS)_[A-F0-9]{16}"
#: A token of 16 digits wherever it stands, or a token-shaped word of another length.
ANY_TOKEN = rf"{fixed.PRIVATE_TOKEN}|{_EXACT}"
HEX = 16
_FOUND = "array<struct<token:string,value:string,name:string>>"


def tokens_in(text: Column, pattern: str = ANY_TOKEN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def with_values(text: Column, found: Column, pattern: str = ANY_TOKEN) -> Column:
    """The text with each token that ``found`` (token, value, name) knows replaced by its value."""
    value = lambda t: F.get(F.transform(F.filter(found, lambda f: f["token"] == t), lambda f: f["value"]), F.lit(0))
    put = lambda plain, t: F.concat(plain, F.coalesce(value(t), t, F.lit("")))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), tokens_in(text, pattern), put), "")


def values_of(asked: DataFrame, vault: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(token, value, name of the vault's token, n) of the asked tokens (token, n) that the vault knows, exactly or within two edits.

    Values that hold tokens themselves are resolved, once.  The result is
    stored, and it alone is resolved: no larger part of the vault than was asked for.
    """
    exact = vault.join(asked, "token").groupBy("token").agg(F.min("value").alias("value"), F.first("n").alias("n"))
    known = stored(exact.select("token", "value", F.col("token").alias("name"), "n"), "known")
    if fuzzy and known.count() < asked.count():
        lost = stored(asked.join(known.select("token"), "token", "left_anti").where(F.col("token").rlike(rf"\A(?:{fixed.PRIVATE_TOKEN_BARE})\z")), "lost")
        if not lost.isEmpty():
            best = stored(nearest(lost, vault.select("token")).join(lost, "token"), "nearest")
            values = _first(vault.join(best.select(F.col("best").alias("token")), "token", "left_semi"))
            near = best.join(values.select(F.col("token").alias("best"), "value"), "best")
            known = known.unionByName(near.select("token", "value", F.col("best").alias("name"), "n"))
    holds = F.coalesce(F.col("value").rlike(_EXACT), F.lit(False))
    if known.where(holds).isEmpty():
        return known
    known = stored(known, "found")
    return stored(known.where(~holds).unionByName(_resolved(known.where(holds), vault)), "resolved")


def _first(vault: DataFrame) -> DataFrame:
    """One value for each token."""
    return vault.groupBy("token").agg(F.min("value").alias("value"))


def look_up(rows: DataFrame, text: Column, vault: DataFrame, fuzzy: bool = True, out: str = "__found", tokens: Column | None = None) -> DataFrame:
    """Adds the array (token, value, name) of the tokens of a text that the vault knows.

    The result depends on the text alone, so a text's digest stands for it: no
    column of the rows need identify them, and no text is shuffled but for rows
    that hold a token.  A text that many rows share and a token that many texts
    share are joined where they are (see ``join_by_key``).  The rows are read
    more than once: store what is costly to make.  Each step's table is stored,
    because a plan that repeats all earlier steps fills the driver.  ``tokens``
    are the distinct tokens of the texts where they are known: every row has some then.
    """
    if tokens is None:
        has = F.coalesce(text.rlike(ANY_TOKEN), F.lit(False))
        some, rest = rows.where(has), rows.where(~has).withColumn(out, F.array().cast(_FOUND))
    else:
        some, rest = rows, None
    keyed = lambda: some.withColumn("__text", F.unhex(F.sha2(text, 256)))
    if tokens is None:
        counted = keyed().groupBy("__text").agg(F.count("*").alias("n"), F.first(F.array_distinct(tokens_in(text))).alias("tokens"))
    else:  # grouped by hash: with the tokens as a key no array is aggregated
        counted = keyed().groupBy("__text", tokens.alias("tokens")).agg(F.count("*").alias("n"))
    texts = stored(counted, "texts")
    pairs = texts.select("__text", F.explode("tokens").alias("token"))
    asked = stored(pairs.groupBy("token").agg(F.count("*").alias("n")), "asked")
    found = join_by_key(pairs, values_of(asked, vault, fuzzy), "token", "n").groupBy("__text").agg(F.array_sort(F.collect_list(F.struct("token", "value", "name"))).alias(out))
    given = stored(texts.select("__text", "n").join(found, "__text", "left").withColumn(out, F.coalesce(out, F.array().cast(_FOUND))), "given")
    done = join_by_key(keyed(), given, "__text", "n").drop("__text")
    return done if rest is None else done.unionByName(rest)


def restore(df: DataFrame, vault: DataFrame, text_col: str = "text", fuzzy: bool = True, restored: str = "restored", unrestored: str = "unrestored") -> DataFrame:
    """Restores a text column; adds the sorted tokens that were restored (as the vault has them) and those left.

    Every row is restored on its own, whatever its other columns hold; a null
    text stays null.
    """
    free(df, restored, unrestored)
    text = F.col(f"`{text_col}`")
    out = look_up(df, text, vault, fuzzy)
    names = F.array_sort(F.array_distinct(F.transform("__found", lambda f: f["name"])))
    left = F.array_sort(F.array_except(tokens_in(text), F.transform("__found", lambda f: f["token"])))
    none = F.array().cast("array<string>")
    new = F.when(F.size("__found") > 0, with_values(text, F.col("__found"))).otherwise(text)
    return out.withColumns({restored: names, unrestored: F.coalesce(left, none), text_col: new}).drop("__found")


def _resolved(inner: DataFrame, vault: DataFrame) -> DataFrame:
    """Rows (token, value, name, n) with the vault's tokens inside their values replaced (values rarely hold any)."""
    asked = inner.select("token", F.explode(F.array_distinct(tokens_in(F.col("value"), _EXACT))).alias("inside"))
    values = _first(vault.join(asked.select(F.col("inside").alias("token")), "token", "left_semi"))
    held = asked.join(values.select(F.col("token").alias("inside"), F.col("value").alias("put")), "inside")
    found = held.groupBy("token").agg(F.collect_list(F.struct(F.col("inside").alias("token"), F.col("put").alias("value"), F.col("inside").alias("name"))).alias("found"))
    return inner.join(found, "token", "left").select("token", F.coalesce(with_values(F.col("value"), F.col("found"), _EXACT), "value").alias("value"), "name", "n")


def nearest(needles: DataFrame, vault: DataFrame, order_col: str = "token") -> DataFrame:
    """(token, best): the closest vault token within two edits, ties by the vault's order.

    Two edits leave one of three parts of the 16 hex digits whole and move it
    by two places at most, so the candidates come from an equality join on
    parts; no pair is compared without a part in common.
    """
    cuts = [(0, 5), (5, 5), (10, 6)]
    known = vault.select(F.col("token").alias("best"), F.col(order_col).alias("__o"), F.length("token").alias("__n"))
    parts = known.withColumn("__part", F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.substr("best", F.col("__n") - HEX + at + 1, F.lit(n)).alias("body")) for i, (at, n) in enumerate(cuts)])))
    size = F.length("token")
    # where a part may stand, from the end: the digits after it and up to two edits
    tries = [F.struct(F.lit(i).alias("no"), F.substr("token", size - (HEX - at) + 1 + shift, F.lit(n)).alias("body")) for i, (at, n) in enumerate(cuts) for shift in range(-2, 3)]
    asked = needles.select("token", F.explode(F.array_distinct(F.array(*tries))).alias("__part"))
    close = asked.join(parts, "__part").where((F.abs(size - F.col("__n")) <= fixed.FUZZY_DISTANCE) & (F.levenshtein("token", "best", fixed.FUZZY_DISTANCE) >= 0))
    ranked = close.select("token", "best", "__o", F.levenshtein("token", "best").alias("__d")).where("__d > 0").distinct()
    return ranked.groupBy("token").agg(F.min_by("best", F.struct("__d", "__o")).alias("best"))
