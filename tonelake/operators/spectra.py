"""Spectra cut into groups and grains, and grains moved to new places: one row for each bin of a frame.

A frame is one spectrum, so it has some thousand bins at most, however many frames there are; frames are dealt by their
id and cut side by side. Only the test of prominence reads a frame as an array; all else are windows and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The first bin that takes part, the least energy of a bin, and the floor of an outline below its maximum.
LOWEST_BIN = 1
SHAPE_FLOOR = 1e-30
OUTLINE_FLOOR = 1e-10


def _tops(levels: Column, rise: float) -> Column:
    """For each level whether, coming from the start, it lies ``rise`` above some level behind it with none higher between.

    One pass that turns: upwards until the level has fallen by ``rise`` from the highest, downwards until it has risen by
    ``rise`` from the lowest. A level has the property just when the pass goes upwards there and no higher one came since
    the last turn. Before the start lies a level below all.
    """

    def step(at: Column, x: Column) -> Column:
        top = F.when(at["up"], x >= at["end"]).otherwise(x - at["end"] >= rise)
        turned = at["up"] & (at["end"] - x >= rise)
        up = top | (at["up"] & ~turned)
        end = F.when(top | turned | (~at["up"] & (x < at["end"])), x).otherwise(at["end"])
        return F.struct(up.alias("up"), end.alias("end"), F.concat(at["tops"], F.array(top)).alias("tops"))

    start = F.struct(F.lit(True).alias("up"), F.lit(float("-inf")).alias("end"), F.array().cast("array<boolean>").alias("tops"))
    return F.aggregate(levels, start, step, lambda at: at["tops"])


def segmented(bins: DataFrame, frame: str, place: str, shape: str, outline: str, prominence_db: float) -> DataFrame:
    """``(frame, bin, shape, grp, grain)``: the bins from ``LOWEST_BIN`` on, dealt to groups and grains counted from 0.

    A group belongs to a peak of the ``outline`` that stands ``prominence_db`` above its surroundings (a flat peak counts
    once, at its middle) and ends before the lowest point of the outline on the way to the next such peak, the first of
    equal ones. A grain begins with every group and in every valley of the ``shape`` itself (the last bin of a flat one).

    ``bins`` has one row for each frame and bin, bins in any order and without gaps. Rows without frame or bin are left
    out, a missing or negative energy counts as none. A frame without prominent peaks is one group.
    """
    energy = lambda c: F.greatest(F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    rows = bins.where(F.col(frame).isNotNull() & (F.col(place) >= LOWEST_BIN))
    row = F.struct(F.col(place).cast("long").alias("bin"), F.greatest(energy(shape), F.lit(SHAPE_FLOOR)).alias("shape"), energy(outline).alias("outline"))
    frames = rows.groupBy(F.col(frame).alias("frame")).agg(F.sort_array(F.collect_list(row)).alias("b"))
    floor = OUTLINE_FLOOR * F.greatest(F.array_max("b.outline"), F.lit(SHAPE_FLOOR))
    frames = frames.withColumn("level", F.transform("b.outline", lambda x: 10 * F.log10(x + floor)))
    frames = frames.withColumn("left", _tops(F.col("level"), prominence_db)).withColumn("right", F.reverse(_tops(F.reverse("level"), prominence_db)))
    rows = frames.select("frame", F.posexplode(F.arrays_zip("b", "level", "left", "right")).alias("i", "z"))
    rows = rows.select("frame", "i", "z.b.bin", "z.b.shape", "z.level", (F.col("z.left") & F.col("z.right")).alias("top"))
    w = W.partitionBy("frame").orderBy("i")
    # A flat peak is a run of equal levels.
    rows = rows.withColumn("run", F.sum((~F.col("level").eqNullSafe(F.lag("level").over(w))).cast("int")).over(w))
    run = W.partitionBy("frame", "run")
    rows = rows.withColumn("peak", (F.col("top") & (F.col("i") == F.floor((F.min("i").over(run) + F.max("i").over(run)) / 2))).cast("int"))
    rows = rows.withColumn("after", F.sum("peak").over(w)).withColumn("peaks", F.sum("peak").over(W.partitionBy("frame")))
    lowest = F.min(F.struct("level", "i")).over(W.partitionBy("frame", "after"))["i"]
    begins = (F.col("i") == 0) | (F.col("after").between(1, F.col("peaks") - 1) & (F.col("i") == lowest))
    valley = (F.col("shape") <= F.lag("shape").over(w)) & (F.col("shape") < F.lead("shape").over(w))
    rows = rows.withColumn("begins", begins).withColumn("cut", F.col("begins") | F.coalesce(valley, F.lit(False)))
    count = lambda c: (F.sum(F.col(c).cast("long")).over(w) - 1)
    return rows.select("frame", "bin", "shape", count("begins").alias("grp"), count("cut").alias("grain"))


def grains(segments: DataFrame) -> DataFrame:
    """``(frame, grp, grain, start, end, energy, center)`` of :func:`segmented` rows; ``end`` is the bin behind the last."""
    total = F.sum("shape")
    return segments.groupBy("frame", "grp", "grain").agg(F.min("bin").alias("start"), (F.max("bin") + 1).alias("end"), total.alias("energy"), (F.sum(F.col("shape") * F.col("bin")) / total).alias("center"))


def groups(grains: DataFrame) -> DataFrame:
    """``(frame, grp, grains, energy, center)``: the mass and the place of each group."""
    total = F.sum("energy")
    return grains.groupBy("frame", "grp").agg(F.count("*").alias("grains"), total.alias("energy"), (F.sum(F.col("energy") * F.col("center")) / total).alias("center"))


def placed(segments: DataFrame, pieces: DataFrame) -> DataFrame:
    """``(frame, bin, energy)``: what the ``pieces`` ``(frame, grp, gain, scale)`` of the groups leave in each bin.

    A piece moves its group as if all frequencies were multiplied by ``scale``: every grain goes, as wide as it was, to
    where its center lands and brings its energy times ``gain``. Between bins a grain is read from the parabola through the
    logarithms of the three nearest bins of its own. What lands before ``LOWEST_BIN`` or behind the frame's last bin is
    gone; bins that nothing reaches have no row. Repeated pieces add up; those of unknown groups or with nulls do nothing.
    """
    own = W.partitionBy("frame", "grain").orderBy("bin")
    level = F.ln("shape")
    curve = segments.select("frame", "grain", F.col("bin").alias("nearest"), level.alias("here"), F.coalesce(F.lag(level).over(own), level).alias("below"), F.coalesce(F.lead(level).over(own), level).alias("above"))
    last = segments.groupBy("frame").agg(F.max("bin").alias("last"))
    pieces = pieces.where(F.col("gain").isNotNull() & F.col("scale").isNotNull()).groupBy("frame", "grp", "scale").agg(F.sum("gain").alias("gain"))
    moves = grains(segments).join(pieces, ["frame", "grp"])
    moves = moves.withColumn("shift", F.col("center") * (F.col("scale") - 1))
    first = F.ceil(F.col("start") - 0.5 + F.col("shift"))
    spots = moves.withColumn("bin", F.explode(F.sequence(first, first + F.col("end") - F.col("start") - 1)))
    at = F.col("bin") - F.col("shift")
    nearest = F.least(F.greatest(F.rint(at).cast("long"), F.col("start")), F.col("end") - 1)
    spots = spots.withColumn("nearest", nearest).withColumn("off", at - F.col("nearest")).join(curve, ["frame", "grain", "nearest"])
    bend = (F.col("above") - 2 * F.col("here") + F.col("below")) / 2
    spots = spots.withColumn("value", F.exp(F.col("here") + F.col("off") * (F.col("above") - F.col("below")) / 2 + F.col("off") * F.col("off") * bend))
    lobe = W.partitionBy("frame", "grain", "scale")
    spots = spots.withColumn("left", F.col("value") * F.col("gain") * F.col("energy") / F.greatest(F.sum("value").over(lobe), F.lit(SHAPE_FLOOR)))
    inside = spots.join(last, "frame").where((F.col("bin") >= LOWEST_BIN) & (F.col("bin") <= F.col("last")))
    return inside.groupBy("frame", "bin").agg(F.sum("left").alias("energy"))
