"""Change logs: capture, state as of a moment, restore plans; anchors and relinking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def state_as_of(log: DataFrame, key: str, order: list[str], moment: Column | None = None, at: str = "recorded_at", operation: str = "operation") -> DataFrame:
    """The latest entry per key with ``at`` up to ``moment``, deleted keys left out. One aggregate, no sort."""
    rows = log if moment is None else log.where(F.col(at) <= moment)
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(key, "_last.*").where(F.col(operation) != "delete")


def rehydrated(log: DataFrame, json: str, schema: str) -> DataFrame:
    """The row that a JSON column holds, as columns."""
    return log.withColumn("_row", F.from_json(json, schema)).select(*[c for c in log.columns if c != json], "_row.*")


def _different(columns: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x | y, [~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def _paired(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    a = before.select(key, F.struct(*columns).alias("a"))
    b = after.select(key, F.struct(*columns).alias("b"))
    return a.join(b, key, "full")


def capture_changes(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(key, operation, previous, current)`` as JSON: what a row trigger would log; rows that stay equal log nothing."""
    both = _paired(before, after, key, columns)
    op = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").when(_different(columns, "a", "b"), "update")
    return both.select(key, op.alias("operation"), F.to_json("a").alias("previous"), F.to_json("b").alias("current")).where("operation is not null")


def baseline(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A first history entry for every row."""
    return df.select(key, F.lit("baseline").alias("operation"), F.lit(None).cast("string").alias("previous"), F.to_json(F.struct(*columns)).alias("current"))


def restore_plan(current: DataFrame, target: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(key, action, columns...)``: upsert, remove or keep, to turn ``current`` into ``target``."""
    both = _paired(current, target, key, columns)
    action = F.when(F.col("b").isNull(), "remove").when(F.col("a").isNull() | _different(columns, "a", "b"), "upsert").otherwise("keep")
    return both.select(key, action.alias("action"), *[F.coalesce(F.col(f"b.{c}"), F.when(F.col("b").isNull(), F.col(f"a.{c}"))).alias(c) for c in columns])


def write_plan(current: DataFrame, changes: DataFrame, key: str, columns: list[str], known: DataFrame) -> DataFrame:
    """``(key, action)`` of a change set merged into the current rows.

    A null in a change leaves the column as it is; a row whose columns are all null afterwards is removed; a change
    for a key that is not among ``known`` is skipped.
    """
    c = changes.select(key, F.struct(*columns).alias("b"))
    both = c.join(current.select(key, F.struct(*columns).alias("a")), key, "left").join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    merged = [F.coalesce(F.col(f"b.{x}"), F.col(f"a.{x}")).alias(x) for x in columns]
    both = both.select(key, "a", "_known", F.struct(*merged).alias("m"))
    empty = reduce(lambda x, y: x & y, [F.col(f"m.{x}").isNull() for x in columns])
    action = F.when(F.col("_known").isNull(), "skipped").when(empty, F.when(F.col("a").isNull(), "unchanged").otherwise("removed")).when(F.col("a").isNull() | _different(columns, "a", "m"), "upserted").otherwise("unchanged")
    return both.select(key, action.alias("action"), *[F.col(f"m.{x}").alias(x) for x in columns])


def newest(log: DataFrame, order: str, n: int, *conditions: Column) -> DataFrame:
    """The newest ``n`` entries, oldest first."""
    rows = reduce(lambda d, c: d.where(c), conditions, log)
    return rows.orderBy(F.desc(order)).limit(n).orderBy(F.asc(order))


def anchors(occurrences: DataFrame, key: str, order: list[str], carry: list[str]) -> DataFrame:
    """The lowest occurrence per key."""
    return occurrences.groupBy(key).agg(F.min_by(F.struct(*carry), F.struct(*order)).alias("_a")).select(key, "_a.*")


def preferred_anchor(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """``(key, kind, place)``: the first table's place where there is one, else the second's."""
    both = first.select(key, F.col("place").alias("_a")).join(second.select(key, F.col("place").alias("_b")), key, "full")
    return both.select(key, F.when(F.col("_a").isNotNull(), "first").otherwise("second").alias("kind"), F.coalesce("_a", "_b").alias("place"))


def relink(annotations: DataFrame, catalog: DataFrame, key: str, slot: list[str]) -> DataFrame:
    """``(key, slot..., target, outcome)`` for annotations whose key left the catalog.

    The slot says where the annotated item was; ``target`` is what stands there now. ``lost``: nothing does;
    ``taken``: the target has an annotation of its own; ``contested``: several annotations want it; else ``relink``.
    """
    stale = annotations.join(catalog.select(key), key, "left_anti").select(key, *slot)
    now = catalog.groupBy(*slot).agg(F.min(key).alias("target"))
    found = stale.join(now, slot, "left")
    wanted = found.where("target is not null").groupBy("target").agg(F.count("*").alias("_wanted"))
    own = annotations.select(F.col(key).alias("target")).distinct().withColumn("_own", F.lit(True))
    found = found.join(wanted, "target", "left").join(own, "target", "left")
    outcome = F.when(F.col("target").isNull(), "lost").when(F.col("_own"), "taken").when(F.col("_wanted") > 1, "contested").otherwise("relink")
    return found.select(key, *slot, "target", outcome.alias("outcome"))


def import_links(links: DataFrame, catalog: DataFrame, key: str, url: str) -> DataFrame:
    """``(key, url, outcome)``: one address per key; keys with several addresses conflict, unknown keys are reported."""
    per = links.groupBy(key).agg(F.min(url).alias(url), F.countDistinct(url).alias("_n"))
    known = catalog.select(key).distinct().withColumn("_known", F.lit(True))
    joined = per.join(known, key, "left")
    outcome = F.when(F.col("_n") > 1, "conflict").when(F.col("_known").isNull(), "unknown").otherwise("link")
    return joined.select(key, url, outcome.alias("outcome"))
