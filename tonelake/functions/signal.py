"""Waveform operators: arrays of samples in [-1, 1] through Arrow-batched pandas UDFs, NumPy inside.

Every function works on one waveform; the UDFs map it over a column, so Spark deals and prunes the rows. Samples of
several channels come interleaved with their channel count beside them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 1 / 128
BUCKETS = 32
TIMES, BANDS = 16, 8


def folded(x: np.ndarray, channels: int = 1) -> np.ndarray:
    """One channel, the mean of all, without the constant part."""
    mono = np.asarray(x, float).reshape(-1, max(1, channels)).mean(axis=1)
    return mono - mono.mean() if len(mono) else mono


def trimmed_length(x: np.ndarray, channels: int = 1, step: float = STEP) -> int:
    """Frames up to the last one above one quantisation step in any channel."""
    loud = np.flatnonzero((np.abs(np.asarray(x, float).reshape(-1, max(1, channels))) > step).any(axis=1))
    return int(loud[-1]) + 1 if len(loud) else 0


def buckets(x: np.ndarray, n: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of n near-even runs; the first len % n runs have one more; empty runs are 0."""
    parts = np.array_split(np.asarray(x, float), n)
    return np.array([p.min() if len(p) else 0.0 for p in parts]), np.array([p.max() if len(p) else 0.0 for p in parts])


def resampled(x: np.ndarray, n: int) -> np.ndarray:
    """n points at even fractions of the duration, linear between samples."""
    x = np.asarray(x, float)
    return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x) if len(x) else np.zeros(n)


def averaged(x: np.ndarray, n: int) -> np.ndarray:
    """n points, each a triangular average over the samples around it: no aliasing when points are fewer than samples."""
    x = np.asarray(x, float)
    if not len(x):
        return np.zeros(n)
    if len(x) <= n or n < 2:
        return resampled(x, n)
    at, width = np.linspace(0, len(x) - 1, n), (len(x) - 1) / (n - 1)
    out = np.empty(n)
    for k, c in enumerate(at):
        i = np.arange(max(0, int(np.ceil(c - width))), min(len(x), int(np.floor(c + width)) + 1))
        w = np.maximum(0, 1 - np.abs(i - c) / width)
        out[k] = (x[i] * w).sum() / w.sum() if w.sum() else x[int(round(c))]
    return out


def retuned(x: np.ndarray, semitones: float) -> np.ndarray:
    """The waveform played faster by so many semitones."""
    return resampled(x, max(1, round(len(x) * 2 ** (-semitones / 12))))


def quantised(x: np.ndarray, depth: int) -> np.ndarray:
    levels = 2 ** (depth - 1)
    return np.clip(np.round(np.asarray(x, float) * levels), -levels, levels - 1) / levels


def highpassed(x: np.ndarray, rate: float, cutoff: float = 20.0, order: int = 2) -> np.ndarray:
    """Zero-phase high-pass: the squared magnitude of a Butterworth filter, applied over the spectrum of a mirrored copy."""
    x = np.asarray(x, float)
    if len(x) < 2:
        return x
    both = np.concatenate([x, x[::-1]])
    f = np.fft.rfftfreq(len(both), 1 / rate)
    with np.errstate(divide="ignore"):
        gain = 1 / (1 + np.where(f > 0, cutoff / f, np.inf) ** (2 * order))
    return np.fft.irfft(np.fft.rfft(both) * gain, len(both))[: len(x)]


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n else v


def _segments(x: np.ndarray) -> np.ndarray:
    size = max(2 * BANDS, -(-len(x) // TIMES))
    return np.pad(np.asarray(x, float), (0, size * TIMES - len(x)))[: size * TIMES].reshape(TIMES, size)


def _band_rms(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    power = np.abs(np.fft.rfft(_segments(x), axis=1)) ** 2
    total = np.concatenate([np.zeros((TIMES, 1)), np.cumsum(power, axis=1)], axis=1)
    at = np.minimum(edges, total.shape[1] - 1)
    return np.sqrt(np.maximum(total[:, at[1:]] - total[:, at[:-1]], 0))


def shape_fingerprint(x: np.ndarray) -> np.ndarray:
    """16 times by 8 linear bands, root mean power, unit length: the same at any level."""
    bins = _segments(x).shape[1] // 2 + 1
    return _unit(_band_rms(x, np.round(np.linspace(0, bins, BANDS + 1)).astype(int)).ravel())


def rate_fingerprint(x: np.ndarray) -> np.ndarray:
    """16 times by 8 octaves counted in cycles per segment: the same after resampling, unit length."""
    return _unit(_band_rms(x, np.append(0, 2 ** np.arange(BANDS))).ravel())



def lagged_score(x: np.ndarray, y: np.ndarray, lags: int = 64) -> tuple[float, int]:
    """Best correlation of y with x brought to its length, over shifts up to ``lags``; the shift, too."""
    a, b = folded(y), folded(resampled(x, len(y)))
    size = 1 << (2 * max(1, len(a)) - 1).bit_length()
    cross = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)
    shifts = np.arange(-min(lags, len(a) - 1), min(lags, len(a) - 1) + 1) if len(a) else np.zeros(1, int)
    norm = np.linalg.norm(a) * np.linalg.norm(b)
    best = shifts[int(np.argmax(cross[shifts]))]
    return (float(np.clip(cross[best] / norm, -1, 1)) if norm else 0.0), int(best)


def descriptor(x: np.ndarray, rate: float) -> np.ndarray:
    """Centroid, bandwidth, flatness, zero-crossing rate, RMS, RMS of the thirds, attack share."""
    x = folded(x)
    if not len(x):
        return np.zeros(9)
    power, f = np.abs(np.fft.rfft(x)) ** 2 + 1e-20, np.fft.rfftfreq(len(x), 1 / rate)
    centre = (f * power).sum() / power.sum()
    width = np.sqrt((((f - centre) ** 2) * power).sum() / power.sum())
    thirds = [float(np.sqrt(np.mean(p**2))) if len(p) else 0.0 for p in np.array_split(x, 3)]
    crossings = float(np.mean(np.signbit(x[1:]) != np.signbit(x[:-1]))) if len(x) > 1 else 0.0
    return np.array([centre, width, np.exp(np.log(power).mean()) / power.mean(), crossings, float(np.sqrt(np.mean(x**2))), *thirds, np.abs(x).argmax() / len(x)])


def sound_type(x: np.ndarray, rate: float) -> str:
    """tonal, percussive or noise, by flatness, how early the energy lies, and periodicity."""
    x = folded(x)
    if len(x) < 16 or not np.any(x):
        return "noise"
    flat = descriptor(x, rate)[2]
    energy = np.cumsum(x**2)
    early = np.searchsorted(energy, 0.8 * energy[-1]) / len(x)
    return "percussive" if early < 0.25 else "noise" if flat > 0.3 else "tonal"


def pitch(x: np.ndarray, rate: float, low: float = 40.0, high: float = 2000.0, parts: int = 8) -> tuple[float, float]:
    """Pitch in Hertz by subharmonic summation with parabolic refinement, and its reliability (share over the mean)."""
    x = folded(x)
    if len(x) < 64 or not np.any(x):
        return 0.0, 0.0
    size = 1 << (4 * len(x) - 1).bit_length()
    spectrum = np.abs(np.fft.rfft(x * np.hanning(len(x)), size))
    grid = low * 2 ** (np.arange(0, np.log2(high / low), 1 / 96))
    bins = grid * size / rate
    total = np.zeros(len(grid))
    for h in range(1, parts + 1):
        total += 0.84 ** (h - 1) * np.interp(bins * h, np.arange(len(spectrum)), spectrum, right=0)
    k = int(total.argmax())
    shift = 0.0
    if 0 < k < len(total) - 1:
        a, b, c = total[k - 1 : k + 2]
        shift = 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c else 0.0
    return float(grid[k] * 2 ** (shift / 96)), float(1 - total.mean() / total[k])


def erb_envelopes(x: np.ndarray, rate: float, bands: int = 16, points: int = 64) -> np.ndarray:
    """Compressed energy envelopes in bands spaced evenly on the ear's frequency scale (bands by points)."""
    x = np.asarray(x, float)
    if not len(x):
        return np.zeros((bands, points))
    spectrum, f = np.fft.fft(x), np.abs(np.fft.fftfreq(len(x), 1 / rate))
    number = 21.4 * np.log10(1 + 0.00437 * f)
    edges = np.linspace(21.4 * np.log10(1 + 0.00437 * 50), 21.4 * np.log10(1 + 0.00437 * rate / 2), bands)
    half = np.where(np.fft.fftfreq(len(x)) >= 0, 2.0, 0.0)
    gain = np.exp(-np.pi * (number[None, :] - edges[:, None]) ** 2)
    return np.stack([averaged(np.abs(np.fft.ifft(spectrum * half * g)) ** 0.3, points) for g in gain])


def modulation(x: np.ndarray, rate: float) -> tuple[float, float]:
    """Mean envelope fluctuation (up to 20 Hz) and roughness (20 to 150 Hz), relative to the envelopes' level."""
    x = np.asarray(x, float)
    points = min(len(x), max(2, int(400 * len(x) / rate)))
    if points < 8:
        return 0.0, 0.0
    env = erb_envelopes(x, rate, points=points)
    power = np.abs(np.fft.rfft(env - env.mean(axis=1, keepdims=True), axis=1)) ** 2
    f = np.fft.rfftfreq(points, len(x) / rate / points)
    base = (env**2).sum() * points or 1.0
    return float(np.sqrt(power[:, (f > 0) & (f <= 20)].sum() / base)), float(np.sqrt(power[:, (f > 20) & (f <= 150)].sum() / base))


def log_grid(x: np.ndarray, rate: float, bands: int = 48, times: int = 16, low: float = 32.7) -> np.ndarray:
    """Level in dB on a log-frequency grid, 12 bands to the octave, 0 at the loudest, -80 at least (bands by times)."""
    x = np.asarray(x, float)
    out = np.zeros((bands, times))
    for t, part in enumerate(np.array_split(x, times)):
        if len(part):
            power = np.abs(np.fft.rfft(part * np.hanning(len(part)), max(4096, len(part)))) ** 2
            f = np.fft.rfftfreq(max(4096, len(part)), 1 / rate)
            with np.errstate(divide="ignore"):
                band = np.round(12 * np.log2(f / low))
            out[:, t] = np.bincount(np.clip(band, -1, bands).astype(int) + 1, power, bands + 2)[1:-1]
    level = 10 * np.log10(np.maximum(out, 1e-12))
    return np.maximum(level - level.max(), -80.0)


def shifted_bands(grid: np.ndarray, bands: int) -> np.ndarray:
    """The grid moved up by whole bands, floor level where nothing comes in."""
    out = np.full_like(grid, grid.min() if grid.size else 0.0)
    if bands >= 0:
        out[bands:] = grid[: len(grid) - bands]
    else:
        out[:bands] = grid[-bands:]
    return out


def float_bytes(x: np.ndarray) -> bytes:
    return np.asarray(x, "<f4").tobytes()


def _mapped(fn: Callable, kind: str, wave: Column) -> Column:
    """A pandas UDF that maps ``fn`` over waveforms; null counts as empty."""

    def run(waves: pd.Series) -> pd.Series:
        return pd.Series([fn(np.zeros(0) if w is None else np.asarray(w)) for w in waves])

    return F.pandas_udf(run, kind)(wave)



def thumbnail(wave: Column, n: int = BUCKETS) -> Column:
    """Minima, then maxima."""
    return _mapped(lambda x: np.concatenate(buckets(x, n)).tolist(), "array<double>", wave)


def shape_print(wave: Column) -> Column:
    return _mapped(lambda x: shape_fingerprint(x).tolist(), "array<double>", wave)


def rate_print(wave: Column) -> Column:
    return _mapped(lambda x: rate_fingerprint(x).tolist(), "array<double>", wave)


def described(wave: Column, rate: float) -> Column:
    return _mapped(lambda x: descriptor(x, rate).tolist(), "array<double>", wave)


def kind_of_sound(wave: Column, rate: float) -> Column:
    return _mapped(lambda x: sound_type(x, rate), "string", wave)


def pitch_of(wave: Column, rate: float) -> Column:
    """Hertz and reliability."""
    return _mapped(lambda x: list(pitch(x, rate)), "array<double>", wave)







def pair_lag(a: Column, b: Column) -> Column:
    """Correlation and shift of a pair of waveforms of different lengths."""

    def two(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[float(v) for v in lagged_score(np.asarray(i), np.asarray(j))] for i, j in zip(x, y)])

    return F.pandas_udf(two, "array<double>")(a, b)


def relation(gain: Column, confidence: Column, depth_changed: Column, least: float = 0.5, slack: float = 0.05) -> Column:
    """bit_depth_variant where only the depth changed, else amplification_variant; null under the least confidence."""
    kind = F.when(depth_changed & (F.abs(gain - 1) <= slack), "bit_depth_variant").otherwise("amplification_variant")
    return F.when(confidence >= least, kind)


#: Extractors by name: from a waveform column to a vector column.
EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "shape": shape_print,
    "rate": rate_print,
    "thumbnail": thumbnail,
    "descriptor": lambda wave: described(wave, 44100.0),
    "grid": lambda wave: _mapped(lambda x: log_grid(x, 44100.0).ravel().tolist(), "array<double>", wave),
    "envelopes": lambda wave: _mapped(lambda x: erb_envelopes(x, 44100.0).ravel().tolist(), "array<double>", wave),
}
