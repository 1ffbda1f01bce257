"""Listing, joining, counting and drawing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.functions import labels
from tonelake.plans.ranks import numbered
from tonelake.sources.shared import materialize


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a total order; end ``order`` with a unique key so that pages are disjoint."""
    return df.orderBy(*order).offset(offset).limit(min(limit, 500))


def with_counts(df: DataFrame, facts: DataFrame, key: str, fact_key: str, out: str = "occurrences") -> DataFrame:
    """``df`` with the number of facts per key, 0 without any. Facts are counted before the join."""
    counts = facts.groupBy(F.col(fact_key).alias(key)).agg(F.count("*").alias(out))
    return df.join(counts, key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def where_given(df: DataFrame, **conditions: Column | None) -> DataFrame:
    """Filter by the conditions that are given; None asks nothing."""
    given = [c for c in conditions.values() if c is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def either(df: DataFrame, a: str, b: str, value: object) -> DataFrame:
    return df.where((F.col(a) == value) | (F.col(b) == value))


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the keys; the optimizer broadcasts the keys if they are few."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def orphans(df: DataFrame, key: str, *holders: tuple[DataFrame, str]) -> DataFrame:
    """Rows that no holder refers to."""
    return reduce(lambda d, h: d.join(h[0].select(F.col(h[1]).alias(key)), key, "left_anti"), holders, df)


def held(df: DataFrame, key: str, *holders: tuple[DataFrame, str]) -> DataFrame:
    """Rows that some holder refers to (EXISTS ... OR EXISTS ...)."""
    names = [h[0].select(F.col(h[1]).alias(key)) for h in holders]
    return df.join(reduce(DataFrame.unionByName, names).distinct(), key, "left_semi")


def subtype_union(base: DataFrame, discriminator: str, children: dict[str, tuple[DataFrame, list[str]] | None]) -> DataFrame:
    """Class-table inheritance: the rows of each kind with its child's columns, null elsewhere.

    A kind without a child table (None) is taken as it is; a row of another kind without a child row is dropped.
    """
    parts = []
    for kind, child in children.items():
        rows = base.where(F.col(discriminator) == kind)
        parts.append(rows if child is None else rows.join(child[0], child[1], "inner"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def pointed(df: DataFrame, pointer: DataFrame, column: str) -> DataFrame:
    """Rows of the version that a one-row pointer table names; no pointer, no rows."""
    return df.join(F.broadcast(pointer.select(column).limit(1)), column, "left_semi")


def seeded_order(key: Column, seed: str) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


def reproducible_sample(df: DataFrame, key: str, seed: str, n: int, within: Column | None = None) -> DataFrame:
    """``n`` rows drawn by a seeded hash of the key: the same rows in any run and partitioning."""
    rows = df if within is None else df.where(within)
    return rows.orderBy(seeded_order(F.col(key), seed), key).limit(n)


def stratified_batches(df: DataFrame, key: str, stratum: str, per_batch: int, seed: str, epoch: int) -> DataFrame:
    """``batch``: ``per_batch`` rows of each stratum to a batch, in an order drawn anew for each epoch."""
    order = W.partitionBy(stratum).orderBy(seeded_order(F.col(key), f"{seed}:{epoch}"), key)
    return df.withColumn("batch", F.floor((F.row_number().over(order) - 1) / per_batch).cast("int"))


def holdout(df: DataFrame, key: str, seed: str, share: float) -> DataFrame:
    """``held``: whether a seeded hash puts the row into the held-out ``share``. No sort, so it holds at any size."""
    place = F.conv(F.substring(seeded_order(F.col(key), seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("held", place < F.lit(int(share * 2**32)))


def masked(df: DataFrame, hidden: list[str], when: Column | None = None) -> DataFrame:
    """The columns nulled, everywhere or where ``when`` holds."""
    hide = F.lit(True) if when is None else when
    return df.withColumns({c: F.when(~hide, F.col(c)) for c in hidden})


def collapse(df: DataFrame, group: str, position: str, best: list[Column]) -> DataFrame:
    """One row per group of a page: the best representative, at the place of the group's first row."""
    inside = W.partitionBy(group)
    ranked = df.withColumn("_n", F.row_number().over(inside.orderBy(*best))).withColumn("_at", F.min(position).over(inside)).withColumn("class_size", F.count("*").over(inside))
    return ranked.where("_n = 1").drop("_n", position).withColumnRenamed("_at", position)


def rank_first_use(uses: DataFrame, item: str, position: str, known: DataFrame | None = None) -> DataFrame:
    """``(item, rank)``: items ranked from 1 by first use; known ones keep their rank and new ones follow the largest."""
    first = uses.groupBy(item).agg(F.min(position).alias("_first"))
    if known is None:
        return numbered(first, [F.col("_first"), F.col(item)], "rank").select(item, "rank")
    new = first.join(known, item, "left_anti")
    most = known.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("_most"))
    most = most.first()[0]
    ranked = numbered(new, [F.col("_first"), F.col(item)], "rank").select(item, (F.col("rank") + most).alias("rank"))
    return known.select(item, F.col("rank").cast("long").alias("rank")).unionByName(ranked)


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violating rows with the names of the broken rules; a rule that is null for a row is kept (as CHECK does)."""
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def all_or_none(*columns: str) -> Column:
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])
    return nulls.isin(0, len(columns))


def exactly_one(*groups: list[str]) -> Column:
    present = reduce(lambda a, b: a + b, [reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in g]).cast("int") for g in groups])
    return present == 1


def missing_references(df: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose reference names no parent; a null in it makes no reference."""
    named = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    on = reduce(lambda a, b: a & b, [F.col(f"c.{c}") == F.col(f"p.{k}") for c, k in zip(columns, keys)])
    return named.alias("c").join(parent.select(*keys).alias("p"), on, "left_anti")


def complete_join(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``df`` with the columns of ``other``; a key that ``other`` does not know refuses the join."""
    unknown = df.join(other.select(key), key, "left_anti").select(key).distinct().limit(5).collect()
    if unknown:
        raise ValueError(f"no match for {key} in {[r[0] for r in unknown]}")
    return df.join(other, key)


def summed(parts: list[DataFrame], sums: list[str], sets: list[str]) -> DataFrame:
    """One summary of the summaries of several shares: numbers summed, lists merged as sets."""
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.agg(*[F.sum(c).alias(c) for c in sums], *[F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets])


def changed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, before, after)`` of the components whose digests differ, added and removed ones included."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    return b.join(a, key, "full").where(~F.col("before").eqNullSafe(F.col("after")))


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(equal)``: whether two tables hold the same distinct rows."""
    sides = a.distinct().withColumn("_side", F.lit(1)).unionByName(b.distinct().withColumn("_side", F.lit(2)))
    odd = sides.groupBy(*a.columns).agg(F.sum("_side").alias("_both")).where("_both <> 3")
    return odd.agg((F.count("*") == 0).alias("equal"))


def privileges(roles: DataFrame, kinds: list[str], allowed: Column) -> DataFrame:
    """Every role with every kind (a cross join with a short list), kept where ``allowed`` holds."""
    return roles.select("*", F.explode(F.array(*map(F.lit, kinds))).alias("kind")).where(allowed)


def label_agreements(queries: DataFrame, items: DataFrame, key: str, paths: str, digits: int | None = None) -> DataFrame:
    """``(a, b, agreement)``: Jaccard similarity of the closures of two items' paths, where they share any, rounded to ``digits``.

    ``queries`` states the query set, some of the items. Items with the same closure are one class; classes meet over the paths that they
    share and are compared once, and a pair of classes is then spread over its members. Rows of one key add up their paths.
    """
    closed = F.transform(labels.closure(F.col(paths)), labels.format_path)
    sets = items.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(closed)))).alias("_set")).where(F.size("_set") > 0)
    sets = materialize(sets, "sets")
    # Stored, so that a task that runs again finds the same numbers.
    classes = materialize(sets.select("_set").distinct().withColumn("_c", F.monotonically_increasing_id()), "classes")
    members = materialize(sets.join(classes, "_set").select(key, "_c"), "members")
    asking = members.join(queries.select(key).distinct(), key, "left_semi").select(F.col(key).alias("a"), F.col("_c").alias("_ca"))
    long = classes.select("_c", F.size("_set").alias("_n"), F.explode("_set").alias("_path"))
    x = long.select(F.col("_c").alias("_ca"), F.col("_n").alias("_na"), "_path").join(asking.select("_ca").distinct(), "_ca", "left_semi")
    y = long.select(F.col("_c").alias("_cb"), F.col("_n").alias("_nb"), "_path")
    shared = x.join(y, "_path").groupBy("_ca", "_na", "_cb", "_nb").agg(F.count("*").alias("_s"))
    agreement = F.col("_s") / (F.col("_na") + F.col("_nb") - F.col("_s"))
    alike = materialize(shared.select("_ca", "_cb", (agreement if digits is None else F.round(agreement, digits)).alias("agreement")), "agreements")
    near = alike.join(asking, "_ca").select("a", "_cb", "agreement")
    return near.join(members.select(F.col(key).alias("b"), F.col("_c").alias("_cb")), "_cb").where("a <> b").select("a", "b", "agreement")
