"""Running totals over a whole table without a task that sees all rows.

Rows are dealt by ranges of the order, so that every row of a part comes before every row of the next. Each part adds up
its own rows; what stands before a part is the sum of the parts before it, one number for each, and is added to the
running totals inside the part.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonelake.sources.shared import materialize


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with a column ``new`` for each ``new: column`` of ``sums``: the total of ``column`` up to and with the row.

    ``order`` should tell rows apart; rows that tie have their totals in any order. Where one value may be held by a
    large part of the rows, count the values first and order those. Nulls add nothing. The driver holds one row for each
    part (a shuffle partition). An empty table stays empty.
    """
    spark = df.sparkSession
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pos", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("_part", F.shiftright("_pos", 33)), "ordered")
    columns = sorted(set(sums.values()))
    kinds = {c: "double" if dict(df.dtypes)[c] in ("float", "double") else "long" for c in columns}
    parts = rows.groupBy("_part").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(kinds[c]).alias(c) for c in columns])
    parts = sorted(parts.collect(), key=lambda r: r["_part"])
    before = [[0, *accumulate(r[c] for r in parts)] for c in columns]
    held = [(r["_part"], *[float(b[i]) if kinds[c] == "double" else int(b[i]) for b, c in zip(before, columns)]) for i, r in enumerate(parts)]
    offsets = spark.createDataFrame(held, ", ".join(["_part long", *[f"_before_{c} {kinds[c]}" for c in columns]]))
    upto = W.partitionBy("_part").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumns({new: F.coalesce(F.sum(c).over(upto), F.lit(0)) for new, c in sums.items()}).join(F.broadcast(offsets), "_part")
    return out.select(*df.columns, *[(F.col(new) + F.col(f"_before_{c}")).alias(new) for new, c in sums.items()])


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with its places in the ``order``, from 1."""
    return running_sums(df.withColumn("_one", F.lit(1).cast("long")), order, {out: "_one"}).drop("_one")


def carried(df: DataFrame, by: str, order: list[Column], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the last ``value`` that is not null among the rows with the same ``by`` up to and with this one.

    Rows are dealt by ranges of (by, order) as in :func:`running_sums`, so a group of any size is spread; what a part
    takes over from the parts before it is one value, settled on the driver from one row for each part. A null ``by`` is
    a group of its own; ``order`` should tell the rows of a group apart.
    """
    spark, keys = df.sparkSession, [F.asc_nulls_first(by), *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_pos", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("_part", F.shiftright("_pos", 33)), "ordered")
    seen = W.partitionBy("_part", by).orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn(out, F.last(value, ignorenulls=True).over(seen))
    ends = rows.groupBy("_part").agg(F.max_by(F.struct(F.col(by).alias("by"), F.col(out).alias("value")), "_pos").alias("end"), F.countDistinct(by).alias("n"), F.max(F.col(by).isNull().cast("int")).alias("none"))
    held, before = [], None
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        if before is not None and before[1] is not None:
            held.append((r["_part"], *before))
        whole = r["n"] + r["none"] == 1 and before is not None and before[0] == r["end"]["by"]
        before = (r["end"]["by"], before[1] if whole and r["end"]["value"] is None else r["end"]["value"])
    kinds = T.StructType([T.StructField("_part", T.LongType()), T.StructField("_by", rows.schema[by].dataType), T.StructField("_value", rows.schema[value].dataType)])
    late = F.broadcast(spark.createDataFrame(held, kinds)).alias("b")
    both = rows.alias("a").join(late, (F.col("a._part") == F.col("b._part")) & F.col(f"a.{by}").eqNullSafe(F.col("b._by")), "left")
    return both.select(*[F.col(f"a.{c}") for c in df.columns], F.coalesce(f"a.{out}", "b._value").alias(out))


def interpolated(points: DataFrame, knots: DataFrame, by: str, x: str, y: str, out: str) -> DataFrame:
    """``points`` with ``out``: the piecewise-linear curve through the ``knots`` of the same ``by``, read at ``x``.

    Points and knots are one table in the order of x; every point carries the knot before and the knot behind it, so no
    point meets all knots. Outside the knots the curve goes on flat, at a knot it has the knot's y (the largest of
    several, while it comes from the left to the least), without knots it is null. Points with a null x get null; knots with nulls are none.
    """
    own = F.struct(*[F.col(c) for c in points.columns]).alias("row")
    spots = points.select(F.col(by).alias("by"), F.col(x).cast("double").alias("x"), F.lit(None).cast("struct<x:double,y:double>").alias("knot"), own)
    marks = knots.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(by).alias("by"), F.col(x).cast("double").alias("x"), F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).alias("knot"), F.lit(None).cast(spots.schema["row"].dataType).alias("row"))
    both = spots.unionByName(marks)
    late = F.col("knot").isNull()
    both = carried(both, "by", [F.col("x"), late, F.col("knot.y")], "knot", "before")
    both = carried(both, "by", [F.col("x").desc(), late, F.col("knot.y").desc()], "knot", "after").where("row is not null")
    at, a, b = F.col("x"), F.col("before"), F.col("after")
    between = a["y"] + (at - a["x"]) * (b["y"] - a["y"]) / (b["x"] - a["x"])
    value = F.when(at.isNull(), None).when(a.isNull(), b["y"]).when(b.isNull() | (a["x"] == at), a["y"]).otherwise(between)
    return both.select("row.*", value.alias(out))


def budgets(events: DataFrame, key: str, at: str, cost: str, tie: str, capacity: float, refill: float) -> DataFrame:
    """``events`` with ``tokens``: what the key's budget holds after the event has been charged, below zero when in debt.

    A budget starts full at ``capacity`` and gains ``refill`` for each second, never above its capacity. ``at`` is in seconds
    (double), equal times go by ``tie``. With the refill of the time since 0 taken off, an event turns what is left into
    the lesser of itself and a bound, less its cost; such steps compose, so inside a part of the ordered table the result is a running
    sum less a running excess, and one number for each part is carried into the next. A null cost charges nothing; rows
    without a time are left out.
    """
    spark, keys = events.sparkSession, [F.asc_nulls_first(key), F.col(at), F.col(tie)]
    spent = F.coalesce(F.col(cost), F.lit(0)).cast("double")
    rows = events.where(F.col(at).isNotNull()).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_pos", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("_part", F.shiftright("_pos", 33)).withColumn("_spent", spent), "ordered")
    upto = W.partitionBy("_part", key).orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", -F.sum("_spent").over(upto))
    rows = rows.withColumn("_bound", F.min(F.lit(float(capacity)) - F.col(at) * refill - F.col("_spent") - F.col("_sum")).over(upto))
    ends = rows.groupBy("_part").agg(F.max_by(F.struct(F.col(key).alias("key"), "_sum", "_bound"), "_pos").alias("end"), F.min_by(F.struct(F.col(key).alias("key")), "_pos").alias("start"))
    held, before = [], None
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        if before is not None and before[0] == r["start"]["key"]:
            held.append((r["_part"], *before))
        goes_on = before is not None and before[0] == r["end"]["key"]  # then the part is of this key alone
        bound = min(before[1], r["end"]["_bound"]) if goes_on else r["end"]["_bound"]
        before = (r["end"]["key"], bound + r["end"]["_sum"])
    kinds = T.StructType([T.StructField("_part", T.LongType()), T.StructField("_key", rows.schema[key].dataType), T.StructField("_left", T.DoubleType())])
    late = F.broadcast(spark.createDataFrame(held, kinds)).alias("b")
    both = rows.alias("a").join(late, (F.col("a._part") == F.col("b._part")) & F.col(f"a.{key}").eqNullSafe(F.col("b._key")), "left")
    tokens = F.least("a._bound", "b._left") + F.col("a._sum") + F.col(f"a.{at}") * refill
    return both.select(*[F.col(f"a.{c}") for c in events.columns], tokens.alias("tokens"))


def seconds_until(tokens: Column, balance: float, refill: float) -> Column:
    """How long a budget takes to hold ``balance``; null once it does."""
    return F.when(tokens < balance, (F.lit(float(balance)) - tokens) / refill)
