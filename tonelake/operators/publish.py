"""Publication: what leaves the house, row by row and column by column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """How a table is published: which rows (a transform), which columns anew (expressions), which not at all."""

    rows: Callable[[DataFrame, dict[str, DataFrame]], DataFrame] = lambda df, tables: df
    rewrite: dict[str, Column] = field(default_factory=dict)
    drop: tuple[str, ...] = ()


def published(tables: dict[str, DataFrame], rules: dict[str, Rule]) -> dict[str, DataFrame]:
    """The tables that have a rule, transformed; tables without one stay at home."""
    out = {}
    for name, rule in rules.items():
        df = rule.rows(tables[name], tables)
        out[name] = df.select(*[rule.rewrite.get(c, F.col(c)).alias(c) for c in df.columns if c not in rule.drop])
    return out


def renamed_directory(directory: Column, directories: list[str], names: list[str]) -> Column:
    """``/name`` for a known directory, null for others."""
    at = F.array_position(F.array(*map(F.lit, directories)), directory)
    return F.when(at > 0, F.concat(F.lit("/"), F.element_at(F.array(*map(F.lit, names)), at.cast("int"))))


def only_key(json: Column, key: str) -> Column:
    """A JSON object with one of the keys."""
    return F.to_json(F.struct(F.get_json_object(json, f"$.{key}").alias(key)))


def leaks(df: DataFrame, table: str, needles: list[str]) -> DataFrame:
    """``(table, column, needle, n)``: text columns in which a private text still stands; one pass over the rows."""
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    found = F.array_compact(F.array(*[F.when(F.col(c).contains(n), F.struct(F.lit(c).alias("column"), F.lit(n).alias("needle"))) for c in names for n in needles]))
    hits = df.select(F.explode(found).alias("hit")).groupBy("hit.column", "hit.needle").agg(F.count("*").alias("n"))
    return hits.select(F.lit(table).alias("table"), "column", "needle", "n")


def any_row(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()


def rounded(x: Column, digits: int = 4) -> Column:
    return F.bround(x, digits)


def beyond_and_lacking(held: DataFrame, permitted: DataFrame) -> DataFrame:
    """Privileges held beyond what is permitted, and permitted ones not held."""
    on = held.columns
    return held.join(permitted, on, "left_anti").withColumn("finding", F.lit("beyond")).unionByName(permitted.join(held, on, "left_anti").withColumn("finding", F.lit("lacking")))


def described(parts: list[tuple[DataFrame, Column]]) -> DataFrame:
    """Several catalog scans as one text column, duplicates kept."""
    return reduce(DataFrame.union, [d.select(c.alias("line")) for d, c in parts])
