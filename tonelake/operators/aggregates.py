"""Dominant values, usage folding, rollups over tag paths, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.functions import labels, pitch
from tonelake.plans.ranks import interpolated, numbered


def dominant(df: DataFrame, key: str | list[str], value: str, out: str = "dominant") -> DataFrame:
    """The most frequent value per key, the smallest of equals; nulls don't count. Combines before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(out))


def dominant_of_sources(sources: list[tuple[DataFrame, str, str]], key: str = "key", value: str = "value") -> DataFrame:
    """Dominant value over several tables, each given with its key and value columns."""
    parts = [d.select(F.col(k).alias(key), F.col(v).alias(value)) for d, k, v in sources]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return dominant(rows, key, value)


def fold_rates(usage: DataFrame, key: str, rate: str, note: str, n: str | None = None) -> DataFrame:
    """``(key, hz, events)``: usage by the rate that is heard, over all declared rates and notes that sound alike.

    Counts per (rate, note) come first, so powers and rounding run once per group and not per event.
    """
    groups = usage.groupBy(key, rate, note).agg((F.count("*") if n is None else F.sum(n)).alias("_n"))
    heard = groups.withColumn("hz", pitch.effective_rate(F.col(rate), F.col(note))).where("hz is not null")
    return heard.groupBy(key, "hz").agg(F.sum("_n").alias("events"))


def dominant_rate(folded: DataFrame, key: str) -> DataFrame:
    """The rate with most events per key, the lower of equals."""
    return folded.groupBy(key).agg(F.min_by("hz", F.struct(-F.col("events"), F.col("hz"))).alias("hz"))


def with_fallback(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """The first table's value per key, else the second's."""
    both = first.select(key, F.col(value).alias("_a")).join(second.select(key, F.col(value).alias("_b")), key, "full")
    return both.select(key, F.coalesce("_a", "_b").alias(value))


def note_statistics(events: DataFrame, key: str, note: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("events"), F.countDistinct(note).alias("notes"), F.min(note).alias("lowest"), F.max(note).alias("highest"), (F.max(note) - F.min(note)).alias("span"))


def closure_counts(rows: DataFrame, label: str) -> DataFrame:
    """``(path, n)``: how many labels assert each path; a label counts once for each of its paths and their prefixes."""
    paths = rows.select(F.explode(labels.closure(labels.written_paths(F.col(label)))).alias("p"))
    return paths.groupBy(labels.format_path(F.col("p")).alias("path"), F.size("p").alias("depth")).agg(F.count("*").alias("n"))


def rollup_counts(counts: DataFrame, label: str, n: str) -> DataFrame:
    """Counts per label summed into all prefixes of its paths."""
    paths = counts.groupBy(label).agg(F.sum(n).alias("_n")).select("_n", F.explode(labels.closure(labels.written_paths(F.col(label)))).alias("p"))
    return paths.groupBy(labels.format_path(F.col("p")).alias("path")).agg(F.sum("_n").alias("n"))


def vocabulary_findings(counts: DataFrame) -> DataFrame:
    """``(finding, name)``: paths used once, and step names that stand at more than one depth (from closure_counts)."""
    once = counts.where("n = 1").select(F.lit("used once").alias("finding"), F.col("path").alias("name"))
    last = counts.select(F.element_at(F.split("path", labels.STEP), -1).alias("name"), "depth")
    twice = last.groupBy("name").agg(F.countDistinct("depth").alias("d")).where("d > 1").select(F.lit("at several depths").alias("finding"), "name")
    return once.unionByName(twice)


def label_vocabulary(rows: DataFrame, label: str) -> DataFrame:
    return rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), F.asc(label))


def vocabulary_ranks(counts: DataFrame, path: str, recorded: DataFrame) -> DataFrame:
    """``place``: recorded paths by their rank, the others after them by name."""
    return numbered(counts.join(recorded, path, "left"), [F.col("rank").isNull(), F.col("rank"), F.col(path)], "place")


def weighted_mean(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Mean by weight; a group whose weights sum to zero gets the plain mean."""
    total = F.sum(weight)
    return df.groupBy(key).agg(F.when(total != 0, F.sum(F.col(value) * F.col(weight)) / total).otherwise(F.avg(value)).alias("mean"))


def separation_gap(pairs: DataFrame, score: str, genuine: Column) -> DataFrame:
    return pairs.agg((F.min(F.when(genuine, F.col(score))) - F.max(F.when(~genuine, F.col(score)))).alias("gap"))


def marginal(relations: DataFrame, kind: Column, confidence: str, key: str, k: int) -> DataFrame:
    return relations.where(kind).orderBy(F.col(confidence).asc_nulls_last(), key).limit(k)


def density_grid(points: DataFrame, x: Column, y: Column, cells: int, low: float, high: float, value: Column) -> DataFrame:
    """``(cx, cy, n, total)``: points and summed values per cell of a square grid; points outside are dropped."""
    width = (high - low) / cells
    at = points.select(F.floor((x - low) / width).cast("int").alias("cx"), F.floor((y - low) / width).cast("int").alias("cy"), value.alias("_v"))
    inside = at.where(F.col("cx").between(0, cells - 1) & F.col("cy").between(0, cells - 1))
    return inside.groupBy("cx", "cy").agg(F.count("*").alias("n"), F.sum("_v").alias("total"))


def count_in_box(points: DataFrame, inside: Column, enough: int) -> DataFrame:
    """``(n)``: points inside, counted up to ``enough`` + 1 only."""
    return points.where(inside).limit(enough + 1).agg(F.count("*").alias("n"))


def nearest_point(points: DataFrame, key: str, x: Column, y: Column, at: tuple[float, float], radius: float) -> DataFrame:
    """The point nearest to a place within a radius; a box filter that scans can use comes first."""
    box = x.between(at[0] - radius, at[0] + radius) & y.between(at[1] - radius, at[1] + radius)
    d2 = (x - at[0]) * (x - at[0]) + (y - at[1]) * (y - at[1])
    return points.where(box).withColumn("d2", d2).where(F.col("d2") <= radius * radius).orderBy("d2", key).limit(1).select(key, F.sqrt("d2").alias("distance"))


def box_blur(df: DataFrame, group: str, order: str, value: str, radius: int, out: str = "blurred") -> DataFrame:
    """Moving mean over 2 radius + 1 places; beyond its ends a row goes on with its end values."""
    inside = W.partitionBy(group).orderBy(order)
    whole = inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    near = inside.rowsBetween(-radius, radius)
    place, n = F.row_number().over(inside), F.count("*").over(whole)
    before, after = F.greatest(F.lit(0), radius + 1 - place), F.greatest(F.lit(0), place + radius - n)
    total = F.sum(value).over(near) + before * F.first(value).over(whole) + after * F.last(value).over(whole)
    return df.withColumn(out, total / (2 * radius + 1))


def strikes(df: DataFrame, group: str, order: str, level: str, lookback: int, rise: float) -> DataFrame:
    """Rows where the level begins to stand ``rise`` above the one ``lookback`` rows earlier (0 before the start)."""
    inside = W.partitionBy(group).orderBy(order)
    up = df.withColumn("_up", F.col(level) - F.lag(level, lookback, 0.0).over(inside) >= rise)
    return up.withColumn("_before", F.coalesce(F.lag("_up").over(inside), F.lit(False))).where("_up and not _before").drop("_up", "_before")


def quantile_map(df: DataFrame, group: str, weight: str, order: str) -> DataFrame:
    """``share``: the part of a group's weight up to and including each row: the axis of a piecewise-linear time map."""
    run = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("share", F.sum(weight).over(run) / F.sum(weight).over(W.partitionBy(group)))


def time_map(times: DataFrame, shares: DataFrame, group: str, other: str, at: str, share: str, out: str = "source_time") -> DataFrame:
    """``out``: the time in the group named by ``other`` by which that group has reached the row's ``share``.

    ``times`` has other and share, ``shares`` the curve of each group: (group, share, at), rising in both. The curves are
    inverted, so between two of a curve's rows the time is on the line between them.
    """
    knots = shares.select(F.col(group).alias(other), F.col(share).alias(share), F.col(at).alias("_at"))
    return interpolated(times, knots, other, share, "_at", out)


def vocabulary_tree(counts: DataFrame) -> DataFrame:
    """``(place, line)``: the vocabulary as an indented tree, depth first, the most used first and then by name.

    ``counts`` has path and n of every path that is used, its ancestors included. A path's place is the order of the
    (falling count, name) of all its ancestors from the top.
    """
    step = F.split("path", labels.STEP)
    above = counts.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(step)), lambda k: F.array_join(F.slice(step, 1, k), labels.STEP))).alias("depth", "upper"))
    used = counts.select(F.col("path").alias("upper"), "n")
    named = above.join(used, "upper").withColumn("name", F.element_at(F.split("upper", labels.STEP), -1))
    keys = named.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("depth", (-F.col("n")).alias("less"), "name"))).alias("key"))
    ordered = numbered(keys, [F.transform("key", lambda k: F.struct(k["less"], k["name"])), F.col("path")], "place")
    own = F.element_at("key", -1)
    return ordered.select("place", F.concat(F.repeat(F.lit("    "), F.size("key") - 1), F.format_string("%5d  %s", -own["less"], own["name"])).alias("line"))
