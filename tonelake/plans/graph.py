"""Connected components by alternating stars over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.plans.joins import join_back, unless_few
from tonelake.sources.shared import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return join_back(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the smallest of them (edges run from larger to smaller)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return join_back(edges, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node with an edge to another; ``component`` is the smallest node reachable.

    Alternates large and small stars (Kiveris et al., 2014) until the edge table stops changing, about log-squared
    rounds. Aggregates combine before the shuffle and the joins back are plain equi-joins, so a hub node is split by
    adaptive execution. Each round is a table in the shared folder: a lost executor costs one round. Null ends and
    self-loops are no edges; an empty edge table gives no rows.
    """
    edges = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    now = materialize(edges, "edges")
    mark = _mark(now)
    while mark[0]:
        large = _large_star(unless_few(now, mark[0])).distinct()
        after = materialize(_small_star(large).distinct(), "edges")
        discard(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
