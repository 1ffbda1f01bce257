"""Order in a graph of steps that require one another, by rounds over an edge table.

``requires`` has the columns ``step`` and ``needs``. Every round is a join of the edges with what the round before found, and a
table in the shared folder; there are as many rounds as the longest chain has steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.sources.shared import discard, materialize

#: So many steps are named when a graph is refused.
NAMED = 20


class MalformedSteps(ValueError):
    """Steps that cannot be brought into an order."""


def _names(rows: DataFrame, column: str) -> str:
    found = [str(r[0]) for r in rows.select(column).distinct().orderBy(column).limit(NAMED + 1).collect()]
    return ", ".join(found[:NAMED]) + " and others" * (len(found) > NAMED)


def checked(steps: DataFrame, requires: DataFrame) -> DataFrame:
    """The different edges; refuses steps named twice and requirements that are no steps."""
    twice = steps.groupBy("step").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise MalformedSteps(f"named more than once: {_names(twice, 'step')}")
    edges = requires.select("step", "needs").distinct()
    for end in ("step", "needs"):
        unknown = edges.join(steps.select(F.col("step").alias(end)), end, "left_anti")
        if not unknown.isEmpty():
            raise MalformedSteps(f"unknown steps: {_names(unknown, end)}")
    return edges


def layers(steps: DataFrame, requires: DataFrame) -> DataFrame:
    """``(step, layer)``: 0 for steps that need nothing, else one more than the highest layer among what a step needs.

    Steps of one layer may run side by side. A circle is refused with the names of the steps that wait for one another
    (or for a step that does).
    """
    edges = materialize(checked(steps, requires), "edges")
    ready = materialize(steps.select("step").join(edges, "step", "left_anti").select("step", F.lit(0).alias("layer")), "layer")
    waiting = materialize(edges.groupBy("step").agg(F.count("*").alias("left")), "waiting")
    found, n = ready, 0
    while not ready.isEmpty():
        n += 1
        met = edges.join(ready.select(F.col("step").alias("needs")), "needs").groupBy("step").agg(F.count("*").alias("met"))
        left = materialize(waiting.join(met, "step", "left").select("step", (F.col("left") - F.coalesce("met", F.lit(0))).alias("left")), "waiting")
        discard(waiting)
        ready = materialize(left.where(F.col("left") == 0).select("step", F.lit(n).alias("layer")), "layer")
        waiting = left.where(F.col("left") > 0)
        waiting = materialize(waiting, "waiting")
        discard(left)
        found = found.unionByName(ready)
    if not waiting.isEmpty():
        raise MalformedSteps(f"these wait for one another in a circle: {_names(waiting, 'step')}")
    return found


def _reached(edges: DataFrame, start: DataFrame, came: str, goes: str) -> DataFrame:
    """``(step, rounds)``: what is reachable from ``start`` along the edges, with the least number of edges."""
    new = materialize(start.select("step").distinct().withColumn("rounds", F.lit(0)), "reached")
    found, n = new, 0
    while not new.isEmpty():
        n += 1
        ends = edges.join(new.select(F.col("step").alias(came)), came).select(F.col(goes).alias("step")).distinct()
        new = materialize(ends.join(found, "step", "left_anti").withColumn("rounds", F.lit(n)), "reached")
        found = found.unionByName(new)
    return found


def requirements(steps: DataFrame, requires: DataFrame, targets: DataFrame) -> DataFrame:
    """``(step, rounds)``: the targets and everything that they need, directly or through others. Unknown targets are refused."""
    unknown = targets.select("step").join(steps.select("step"), "step", "left_anti")
    if not unknown.isEmpty():
        raise MalformedSteps(f"unknown targets: {_names(unknown, 'step')}")
    return _reached(materialize(checked(steps, requires), "edges"), targets, "step", "needs")


def descendants(steps: DataFrame, requires: DataFrame, of: DataFrame) -> DataFrame:
    """``(step, rounds)``: the steps that need one of the given ones, directly or through others; those themselves are not listed
    (unless one needs another)."""
    edges = materialize(checked(steps, requires), "edges")
    first = edges.join(of.select(F.col("step").alias("needs")).distinct(), "needs").select("step")
    return _reached(edges, first, "needs", "step").withColumn("rounds", F.col("rounds") + 1)
