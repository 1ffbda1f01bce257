"""Waveforms as rows of frames ``(key, i, x)``: every step is an aggregate or a join by key, so no waveform is held whole. Fingerprints
hold one of TIMES segments of a waveform at a time, since the spectrum needs its frames together.

The rows are those of ``variants.frames``: frames of a key are numbered from 0. A key without frames has no rows here, and none
come of it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.plans.joins import join_back

# The segments and bands of a fingerprint.
TIMES, BANDS = 16, 8
#: Frames whose spectra a task takes at once.
HELD = 1 << 18


def centred(rows: DataFrame, key: str) -> DataFrame:
    """``(key, i, x)`` without the constant part of each waveform, the mean of its frames."""
    means = rows.groupBy(key).agg(F.avg("x").alias("_mean"))
    return join_back(rows, means, [key]).select(key, "i", (F.col("x") - F.col("_mean")).alias("x"))


def in_bits(rows: DataFrame, key: str, depth: int) -> DataFrame:
    """``(key, i, x)`` requantised to ``depth`` bits, halves to even, values beyond the range at its ends."""
    levels = 2.0 ** (depth - 1)
    return rows.select(key, "i", (F.greatest(F.lit(-levels), F.least(F.lit(levels - 1), F.rint(F.col("x") * levels))) / levels).alias("x"))


def at_points(rows: DataFrame, key: str, points: Column | int) -> DataFrame:
    """``(key, i, x)``: each waveform at ``points`` even fractions of its duration, linear between frames.

    ``points``, at least 1, may be computed from ``_n``, the waveform's number of frames. One point is the first frame, and all
    points of a single frame are that frame. A frame adds its value to the points less than a frame away from it, weighed by
    its nearness, so a point is a sum of two frames and no frame has to look at the next one.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_m", (points if isinstance(points, Column) else F.lit(points)).cast("long"))
    last, steps = F.col("_n") - 1, F.greatest(F.col("_m") - 1, F.lit(1))
    # The points of a frame lie between these two, with one to spare on each side where the division rounds.
    low = F.when(last == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor((F.col("i") - 1) * steps / last)))
    high = F.when(last == 0, F.col("_m") - 1).otherwise(F.least(F.col("_m") - 1, F.ceil((F.col("i") + 1) * steps / last)))
    held = join_back(rows, sizes, [key]).withColumn("_low", low.cast("long")).withColumn("_high", high.cast("long")).where("_low <= _high")
    near = held.withColumn("_k", F.explode(F.sequence("_low", "_high")))
    weight = 1 - F.abs(F.col("_k") * last / steps - F.col("i"))
    near = near.select(key, "_k", F.col("x"), weight.alias("_w")).where("_w > 0")
    return near.groupBy(key, "_k").agg(F.sum(F.col("x") * F.col("_w")).alias("x")).select(key, F.col("_k").alias("i"), "x")


def tuned(rows: DataFrame, key: str, semitones: float) -> DataFrame:
    """``(key, i, x)``: each waveform played faster by so many semitones, with one frame at least; halves of a frame go to even."""
    return at_points(rows, key, F.greatest(F.lit(1), F.bround(F.col("_n") * 2.0 ** (-semitones / 12))))


def _edges(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Borders of BANDS even bands, and of BANDS octaves counted in cycles per segment, cut off at ``bins``."""
    return np.rint(np.arange(BANDS + 1) * bins / BANDS).astype(int), np.minimum(np.append(0, 2 ** np.arange(BANDS)), bins)


def _bands(frames: pd.Series, size: pd.Series) -> pd.Series:
    """For each segment, padded to ``size`` frames, the root power in even bands and then in octaves; segments of one size at once."""
    rows, sizes = frames.tolist(), size.to_numpy()
    out = np.zeros((len(rows), 2 * BANDS))
    for n in np.unique(sizes):
        places = np.flatnonzero(sizes == n)
        step = max(1, HELD // int(n))
        for at in range(0, len(places), step):
            part = places[at : at + step]
            waves = np.zeros((len(part), n))
            for k, i in enumerate(part):
                waves[k, : len(rows[i])] = rows[i]
            power = np.abs(np.fft.rfft(waves, axis=1)) ** 2
            for first, edges in zip((0, BANDS), _edges(power.shape[1])):
                for band, (start, end) in enumerate(zip(edges, edges[1:])):
                    out[part, first + band] = np.sqrt(power[:, start:end].sum(axis=1))
    return pd.Series(list(out))


def fingerprints(rows: DataFrame, key: str) -> DataFrame:
    """``(key, shape, rate)``: two vectors of unit length, TIMES segments by BANDS bands each; silence has zeros.

    ``shape`` has even bands and is the same at any level; ``rate`` has octaves in cycles per segment and stays alike when the
    waveform is resampled. A segment is a sixteenth of the waveform, at least 16 frames, the last ones padded with zeros.
    Spectra are taken of a segment, a row each; the rest is aggregates.
    """
    sizes = rows.groupBy(key).agg(F.greatest(F.lit(2 * BANDS), F.ceil(F.count("*") / TIMES)).cast("int").alias("_size"))
    held = join_back(rows, sizes, [key]).withColumn("_at", F.expr("i div _size"))
    parts = held.groupBy(key, "_at", "_size").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda f: f["x"].cast("double")).alias("_x"))
    parts = parts.select(key, F.struct(F.col("_at").cast("int").alias("at"), F.pandas_udf(_bands, "array<double>")("_x", "_size").alias("v")).alias("_p"))
    found = parts.groupBy(key).agg(F.map_from_entries(F.collect_list("_p")).alias("_p"))  # at most TIMES entries

    def unit(first: int) -> Column:
        value = lambda k: F.coalesce(F.get(F.element_at("_p", F.floor(k / BANDS).cast("int")), (F.lit(first) + k % BANDS).cast("int")), F.lit(0.0))
        whole = F.transform(F.sequence(F.lit(0), F.lit(TIMES * BANDS - 1)), value)
        length = F.sqrt(F.aggregate(whole, F.lit(0.0), lambda a, v: a + v * v))
        return F.transform(whole, lambda v: F.when(length > 0, v / length).otherwise(F.lit(0.0)))

    return found.select(key, unit(0).alias("shape"), unit(BANDS).alias("rate"))
