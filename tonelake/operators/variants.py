"""Whether one waveform is another at a different level: a least-squares gain, natively over the frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.plans.joins import join_back
from tonelake.plans.ranks import numbered

# The residual allowed at eight bits, the gains and the difference in length that still count.
CEILING, LEAST_GAIN, MOST_GAIN, SLACK = 0.02, 0.1, 10.0, 32


def frames(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``(key, i, x)``: the values of each key in order, numbered from 0, without a task that holds a key whole."""
    places = numbered(rows.where(F.col(value).isNotNull()).select(key, order, F.col(value).alias("x")), [F.col(key), F.col(order)], "_n")
    first = places.groupBy(key).agg(F.min("_n").alias("_first"))
    return join_back(places, first, [key]).select(key, (F.col("_n") - F.col("_first")).alias("i"), "x")


def trimmed_lengths(rows: DataFrame, key: str, step: float = 1.0 / 128) -> DataFrame:
    """``(key, frames)``: frames up to the last one above ``step``; 0 for silence. ``rows`` are (key, i, x)."""
    return rows.groupBy(key).agg(F.coalesce(F.max(F.when(F.abs("x") > step, F.col("i") + 1)), F.lit(0)).cast("int").alias("frames"))


def thumbnails(rows: DataFrame, key: str, buckets: int = 32) -> DataFrame:
    """``(key, bucket, lowest, highest)``: as many runs as ``buckets``, the first ones a frame longer where they do not divide."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"))
    small, odd = F.expr(f"_n div {buckets}"), F.expr(f"_n % {buckets}")
    long = (small + 1) * odd
    bucket = F.when(F.col("i") < long, F.floor(F.col("i") / (small + 1))).otherwise(odd + F.floor((F.col("i") - long) / F.greatest(small, F.lit(1))))
    held = join_back(rows, sizes, [key]).withColumn("bucket", bucket.cast("int"))
    return held.groupBy(key, "bucket").agg(F.min("x").alias("lowest"), F.max("x").alias("highest"))


def gain_ceiling(depth: Column) -> Column:
    """The residual that counts as no match: CEILING at 8 bits, half of it for each further bit."""
    return F.lit(CEILING) * F.pow(F.lit(2.0), F.lit(8) - depth)


def gain_scores(pairs: DataFrame, rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(a, b, gain, rms_error, max_abs_error, confidence)`` of the pairs ``(a, b)`` that a gain may relate.

    ``rows``: (id, i, x), the frames; ``sizes``: (id, n, depth), their number and bits. The gain from a to b is fitted by least squares over the frames that both have;
    confidence is one less the residual's RMS over the ceiling of the lesser depth. No row comes of lengths that differ by more than SLACK frames, a silent a, or a
    gain beyond LEAST_GAIN to MOST_GAIN, whatever its sign. Frames are joined by place and summed; no waveform is held whole.
    """
    near = pairs.select("a", "b")
    for end in ("a", "b"):
        near = near.join(sizes.select(F.col("id").alias(end), F.struct("n", "depth").alias(f"_{end}")), end)
    near = near.where(F.abs(F.col("_a.n") - F.col("_b.n")) <= SLACK).withColumn("_n", F.least("_a.n", "_b.n")).withColumn("_depth", F.least("_a.depth", "_b.depth"))
    one, two = rows.select(F.col("id").alias("a"), "i", F.col("x").cast("double").alias("x")), rows.select(F.col("id").alias("b"), "i", F.col("x").cast("double").alias("y"))
    both = near.select("a", "b", "_n", "_depth").join(one, "a").where("i < _n").join(two, ["b", "i"])
    fits = both.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("x")).alias("_aa"), F.sum(F.col("x") * F.col("y")).alias("_ab")).where("_aa > 0")
    fits = fits.select("a", "b", (F.col("_ab") / F.col("_aa")).alias("gain")).where(F.abs("gain").between(LEAST_GAIN, MOST_GAIN))
    rest = F.col("y") - F.col("gain") * F.col("x")
    errors = join_back(both, fits, ["a", "b"]).groupBy("a", "b").agg(F.first("gain").alias("gain"), F.sqrt(F.avg(rest * rest)).alias("rms_error"), F.max(F.abs(rest)).alias("max_abs_error"), F.first("_depth").alias("_depth"))
    return errors.select("a", "b", "gain", "rms_error", "max_abs_error", F.greatest(F.lit(0.0), 1 - F.col("rms_error") / gain_ceiling(F.col("_depth"))).alias("confidence"))


def alike(rows: DataFrame, depths: Column) -> DataFrame:
    """``(id, n, depth, first, last, copies)`` of each waveform: its frames, ``depths`` (over id), and the least and largest id and the number of
    those that have the same depth and frames, which two 64-bit hashes summed over places and values tell."""
    mark = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    marks = rows.groupBy("id").agg(F.count("*").alias("n"), mark("i", "x").alias("_m"), mark("x", "i", F.lit(1)).alias("_k")).withColumn("depth", depths)
    keys = ["depth", "n", "_m", "_k"]
    found = join_back(marks, marks.groupBy(*keys).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("copies")), keys)
    return found.select("id", "n", "depth", "first", "last", "copies")


def both_ways(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """``(a, b)``: which scores the ``pairs`` of the first ones of classes, a < b, and their copies need: from a to b, back where a copy of a comes
    after b, and of a class with itself where it has copies. ``firsts``: (id, last, copies), those classes that may be paired with themselves."""
    later = pairs.join(firsts.select(F.col("id").alias("a"), "last"), "a").where("last > b").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return pairs.select("a", "b").unionByName(later).unionByName(firsts.where("copies > 1").select(F.col("id").alias("a"), F.col("id").alias("b")))


def spread(scored: DataFrame, members: DataFrame) -> DataFrame:
    """``scored`` (a, b, ...) of first ones as rows of all their copies, a < b. ``members``: (id, first)."""
    for end in ("a", "b"):
        copies = members.select(F.col("first").alias(end), F.col("id").alias(f"_{end}"))
        scored = scored.join(copies, end)
    rest = [c for c in scored.columns if c not in ("a", "b", "_a", "_b")]
    return scored.where("_a < _b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), *rest)
