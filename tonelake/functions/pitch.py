"""Pitch, rates and scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIDDLE = 60


def sounding_rate(rate: Column, note: Column) -> Column:
    return rate * F.pow(F.lit(2.0), (note - MIDDLE) / F.lit(12.0))


def effective_rate(rate: Column, note: Column) -> Column:
    """Whole Hertz, halves to even; null under 1 Hz."""
    whole = F.bround(sounding_rate(rate, note))
    return F.when(whole >= 1, whole.cast("long"))


def span(lowest: Column, highest: Column) -> Column:
    return highest - lowest


def semitones(frequency: Column, reference: float = 440.0) -> Column:
    return 12 * F.log2(frequency / reference)


def common_rate(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def geometric_mix(a: Column, b: Column, weight: Column) -> Column:
    """``a`` at weight 0, ``b`` at weight 1, along the logarithm in between."""
    return F.exp((1 - weight) * F.log(a) + weight * F.log(b))


def erb_number(frequency: Column) -> Column:
    """Place on the scale of equivalent rectangular bandwidths."""
    return 21.4 * F.log10(1 + 0.00437 * frequency)


def erb_frequency(number: Column) -> Column:
    return (F.pow(F.lit(10.0), number / 21.4) - 1) / 0.00437


def erb_width(frequency: Column) -> Column:
    return 24.7 * (1 + 0.00437 * frequency)


def quantisation_noise(depth: Column) -> Column:
    """RMS of the error of rounding to ``depth`` bits over the range -1 to 1."""
    return F.pow(F.lit(2.0), 1 - depth) / F.sqrt(F.lit(12.0))


def neighbours(n: Column) -> Column:
    """Neighbours to look at among ``n`` items: all others, 2 at least and 15 at most."""
    return F.greatest(F.lit(2), F.least(F.lit(15), n - 1))
