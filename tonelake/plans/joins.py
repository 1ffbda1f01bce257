"""Joins that adaptive execution can split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows beyond which a stored table is left to no estimate of its size.
FEW_ROWS = 500_000


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, whose next join shuffles both sides. Spark takes a table behind an explode to be as large as the one before it, and a
    compressed file to be as large in memory; by such an estimate it may broadcast many times more than its threshold."""
    return df.hint("merge")


def unless_few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, a stored table: as it is if its ``rows`` (counted, if not given) are few, else :func:`shuffled`."""
    return df if (df.count() if rows is None else rows) <= FEW_ROWS else shuffled(df)


def join_back(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` with a table of one row per key that was aggregated by the same keys.

    The aggregate is already dealt by its keys, so a plain join would reuse that and no hot key could be split. A
    further key, a function of the others, asks for a shuffle of both sides, which adaptive execution may split. Keys
    compare null-safely. The result has the columns of ``rows`` and the other columns of ``groups``.
    """
    mark: Column = F.xxhash64(*keys).bitwiseAND(F.lit(0xFFFF))
    a, b = rows.withColumn("_mark", mark).alias("a"), groups.withColumn("_mark", mark).alias("b")
    on = F.col("a._mark") == F.col("b._mark")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = a.join(b, on, how)
    mine = [F.col(f"a.{c}") for c in rows.columns]
    if how in ("left_semi", "left_anti"):
        return joined.select(*mine)
    return joined.select(*mine, *[F.col(f"b.{c}") for c in groups.columns if c not in keys])
