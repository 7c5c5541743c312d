"""Helpers on whole tables: joins whose keys many rows may share, columns that must be free."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of a join that are broadcast because more rows have them than any other key.
HOT_KEYS = 4096
#: A key of no more rows than this is light: its rows may meet in one task.
LIGHT = 256


def join_by_key(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join with a table of one row for each key; ``weight`` is how many of the rows have the key.

    The ``HOT_KEYS`` heaviest keys are broadcast, so a key that holds a large
    share of the rows is joined where they are; any other key holds less than
    one in ``HOT_KEYS`` of them and is shuffled.  Where a stored table has light
    keys alone, one plain join reads the rows once.
    """
    if hasattr(table, "stored_at") and table.where(F.col(weight) > LIGHT).isEmpty():
        return rows.join(table.drop(weight), key).select(*rows.columns, *[c for c in table.columns if c not in (key, weight)])
    given = [c for c in table.columns if c not in (key, weight)]
    hot = table.orderBy(F.desc(weight), key).limit(HOT_KEYS).select(key, F.struct(*given).alias("__hot"))
    near = rows.join(F.broadcast(hot), key, "left")
    cold = near.where("__hot is null").drop("__hot").join(table.select(key, F.struct(*given).alias("__hot")), key)
    return near.where("__hot is not null").unionByName(cold).select(*rows.columns, "__hot.*")


def free(df: DataFrame, *names: str) -> None:
    """An operator does not take the place of the caller's columns."""
    if taken := [n for n in names if n in df.columns]:
        raise ValueError(f"the table has columns {taken} already: rename them or name other result columns")
