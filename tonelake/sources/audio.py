"""WAV files as rows: decoded, counted, written as binary columns and found again by content hash."""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECODED = "path string, hash string, depth int, channels int, frames long, rate int, samples array<double>, problem string"


def _samples(raw: bytes, width: int) -> np.ndarray:
    """Whole numbers of a WAV payload: one byte is unsigned, the others signed little-endian."""
    if width == 1:
        return np.frombuffer(raw, np.uint8).astype(np.int64) - 128
    if width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
        value = parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16
        return np.where(value >= 1 << 23, value - (1 << 24), value)
    return np.frombuffer(raw, f"<i{width}").astype(np.int64)


def decoded(content: bytes, domain: str = "sample") -> tuple:
    """Hash, depth, channels, frames, rate and interleaved samples; 8 bits stay, deeper files are brought to 16."""
    with wave.open(io.BytesIO(content)) as f:
        channels, width, rate, frames = f.getnchannels(), f.getsampwidth(), f.getframerate(), f.getnframes()
        raw = f.readframes(frames)
    if channels > 2:
        raise ValueError(f"{channels} channels; one or two are read")
    whole = _samples(raw, width)
    if not len(whole):
        raise ValueError("no frames")
    depth = 8 if width == 1 else 16
    if width > 2:
        whole = np.clip(np.round(whole / float(1 << (8 * width - 16))), -32768, 32767).astype(np.int64)
    frames = len(whole) // channels
    payload = whole.astype("<i1" if depth == 8 else "<i2").tobytes()
    digest = hashlib.sha256(f"{domain}:{depth}:{channels}:{frames}\0".encode() + payload).hexdigest()
    return digest, depth, channels, frames, rate, whole / float(1 << (depth - 1))


def decode(files: DataFrame) -> DataFrame:
    """A row per file of ``files.discover(..., content=True)``; files that cannot be read keep their path and the problem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):  # one waveform at a time
                try:
                    row = (path, *decoded(content.as_py()), None)
                except (ValueError, EOFError, wave.Error) as problem:
                    row = (path, None, None, None, None, None, None, str(problem) or type(problem).__name__)
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in DECODED.split(", ")])

    return files.select("path", "content").mapInArrow(run, DECODED)


def frame_counts(files: DataFrame) -> DataFrame:
    """``(path, frames)`` from the header alone: the data chunk's size over the frame size, for plain PCM files."""
    number = lambda at, n: F.conv(F.concat(*[F.hex(F.substring("content", at + n - 1 - i, 1)) for i in range(n)]), 16, 10).cast("long")
    plain = (F.substring("content", 1, 4) == F.lit(b"RIFF")) & (F.substring("content", 37, 4) == F.lit(b"data"))
    return files.select("path", F.when(plain, (number(41, 4) / number(33, 2)).cast("long")).alias("frames"))


def encode(samples: Column, depth: Column, channels: Column, rate: int = 44100) -> Column:
    """A WAV file as a binary column."""
    def run(waves: pd.Series, depths: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for x, d, c in zip(waves, depths, counts):
            whole = np.clip(np.round(np.asarray(x, float) * (1 << (d - 1))), -(1 << (d - 1)), (1 << (d - 1)) - 1).astype(np.int64)
            buffer = io.BytesIO()
            with wave.open(buffer, "wb") as f:
                f.setnchannels(int(c))
                f.setsampwidth(1 if d == 8 else 2)
                f.setframerate(rate)
                f.writeframes((whole + 128).astype(np.uint8).tobytes() if d == 8 else whole.astype("<i2").tobytes())
            out.append(buffer.getvalue())
        return pd.Series(out)

    return F.pandas_udf(run, "binary")(samples, depth, channels)


def store(objects: DataFrame, existing: DataFrame) -> DataFrame:
    """Objects (``hash``, ``content``) to append to a store: each hash once, none that is there."""
    return objects.join(existing.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])


def named(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored objects of the wanted hashes."""
    return objects.join(wanted.select("hash").distinct(), "hash", "left_semi")
