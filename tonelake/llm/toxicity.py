"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed character n-grams of the whole lower-cased text, present or absent. Their log-count ratios come from labelled
documents; the most telling ones form the vocabulary, and logistic regression learns a weight for each ratio. Scoring
is one pass over the documents with the weight table in every task, no shuffle.

The classifier is fitted on ``sample_rows`` labelled documents at most (the first by a hash of doc_id), so the tables
that a task or the driver hold while fitting are bounded: ``2**BUCKET_BITS`` counts, ``vocabulary`` weights, and the
features of ``sample_rows`` documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import give_back, parts, released
from tonelake.sources.shared import discard, materialize

BUCKET_BITS = 18
SIZES = (4, 5, 6)
CHUNK_CHARS = 1 << 17
_GAP = " " * max(SIZES)
_FACTOR, _MIX = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Model:
    """``weights[bucket]`` is ratio times learned weight, zero outside the vocabulary."""

    bias: float
    weights: np.ndarray


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about CHUNK_CHARS together; a longer text stands alone, and features() takes it in pieces."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > CHUNK_CHARS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def _pieces(texts: list[str]) -> Iterator[tuple[int, str]]:
    """Number and lower-cased text of each text, a long one in pieces that overlap by an n-gram but a character."""
    for i, t in enumerate(texts):
        padded, overlap = _GAP + t.lower() + _GAP, max(SIZES) - 1
        for at in range(0, max(1, len(padded) - overlap), CHUNK_CHARS):
            yield i, padded[at : at + CHUNK_CHARS + overlap]


def features(texts: list[str], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text number, bucket), each once, of the n-grams of lower-cased texts; ``keep`` masks the buckets."""
    done, run, size = [], [], 0
    for piece in _pieces(texts):
        if run and size + len(piece[1]) > CHUNK_CHARS:
            done.append(_pairs(run, keep))
            run, size = [], 0
        run.append(piece)
        size += len(piece[1])
    pairs = np.unique(np.concatenate([*done, _pairs(run, keep)])) if run else np.zeros(0, np.int64)
    return pairs >> BUCKET_BITS, pairs & np.int64((1 << BUCKET_BITS) - 1)


def _pairs(pieces: list[tuple[int, str]], keep: np.ndarray | None) -> np.ndarray:
    """Text number and bucket in one number, sorted, each once."""
    owner, padded = np.array([i for i, _ in pieces], np.int64), [p for _, p in pieces]
    starts = np.cumsum([0, *map(len, padded)])[:-1]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points[(points >= 9) & (points <= 13)] = 32
    gram, found = points, []
    for n in range(2, max(SIZES) + 1):
        gram = gram[:-1] * np.uint64(_FACTOR) + points[n - 1 :]
        if n in SIZES:
            bucket = ((gram * np.uint64(_MIX)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            at = np.flatnonzero(keep[bucket]) if keep is not None else np.arange(len(bucket))
            found.append(owner[np.searchsorted(starts, at, "right") - 1] << BUCKET_BITS | bucket[at])
    return np.unique(np.concatenate(found))


def _sample(docs: DataFrame, labels: DataFrame, train: Column, rows: int) -> DataFrame:
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & train).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded, so it may be broadcast
    # One text for each id, however often it is listed, so that the fit stays bounded.
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in parts(batches):
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        at = 0
        for run in chunks([t or "" for t in batch.column(0).to_pylist()]):
            row, bucket = features(run)
            hot = toxic[at + row] > 0
            counts[1] += np.bincount(bucket[hot], minlength=counts.shape[1])
            counts[0] += np.bincount(bucket[~hot], minlength=counts.shape[1])
            at += len(run)
    some = np.flatnonzero(counts.any(axis=0))
    for part in np.array_split(some, max(1, len(some) // 50_000)):
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[0, part]), pa.array(counts[1, part])], names=["bucket", "clean", "toxic"])


def _solve(rows: np.ndarray, cols: np.ndarray, x: np.ndarray, y: np.ndarray, n: int, width: int, l2: float, steps: int) -> np.ndarray:
    """Logistic regression by Adam over all rows at once; the last of the returned weights is the bias."""
    w, mean, square = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, x * w[cols], n) + w[-1], -40, 40)))
        off = (p - y) / n
        grad = np.append(np.bincount(cols, x * off[rows], width) + l2 * w[:-1], off.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        w = w - 0.02 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, sample_rows: int = 12_000, vocabulary: int = 1024, alpha: float = 0.5, l2: float = 1e-4, steps: int = 300) -> Model:
    """Fit on labelled documents for which ``train`` (over the columns of ``labels``) holds.

    Null ids and labels are left out; a document labelled twice is toxic if any label says so, and of rows that repeat
    an id one text counts. Without toxic or
    without clean examples nothing can be told apart: the score is then the share of toxic examples, 0 without any.
    """
    sample = materialize(_sample(docs, labels, F.lit(True) if train is None else train, sample_rows), "toxicity-sample")
    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0))).first()
    weights = np.zeros(1 << BUCKET_BITS, np.float32)
    if not 0 < toxic < total:
        discard(sample)
        return Model(40.0 if toxic else -40.0, weights)
    clean = total - toxic
    counts = sample.mapInArrow(released(_counts), "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    p, q = (F.col("t") + alpha) / (toxic + 2 * alpha), (F.col("c") + alpha) / (clean + 2 * alpha)
    spread = (F.col("t") + F.col("c") + 2 * alpha) / (total + 4 * alpha)
    telling = (p - q) * (p - q) / (spread * (1 - spread))
    chosen = counts.select("bucket", F.log(p / q).alias("ratio"), telling.alias("telling")).orderBy(F.desc("telling"), "bucket").limit(vocabulary).toPandas()
    keep = np.zeros(1 << BUCKET_BITS, bool)
    keep[chosen["bucket"]] = True

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            labels_, at = batch.column(1).to_numpy(zero_copy_only=False), 0
            for run in chunks([t or "" for t in batch.column(0).to_pylist()]):
                row, bucket = features(run, keep)
                lists = np.split(bucket.astype(np.int32), np.searchsorted(row, np.arange(1, len(run))))
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), pa.array((labels_[at : at + len(run)] > 0).astype(np.int32))], names=["buckets", "toxic"])
                at += len(run)

    order = dict(zip(chosen["bucket"].tolist(), range(len(chosen))))
    ratio = chosen["ratio"].to_numpy(float)

    def solved(pdf: pd.DataFrame) -> np.ndarray:
        rows = np.repeat(np.arange(len(pdf)), pdf["buckets"].map(len))
        cols = np.array([order[b] for one in pdf["buckets"] for b in one], np.int64)
        return _solve(rows, cols, ratio[cols], pdf["toxic"].to_numpy(float), len(pdf), len(ratio), l2, steps)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        w = solved(pdf)
        give_back()
        return pd.DataFrame({"w": [w.tolist()]})

    # One group, of sample_rows rows at most.
    w = np.array(sample.mapInArrow(released(vectors), "buckets array<int>, toxic int").groupBy().applyInPandas(solve, "w array<double>").first().w)
    discard(sample)
    weights[chosen["bucket"]] = ratio * w[:-1]
    return Model(float(w[-1]), weights)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out`` (0 to 1, higher: likelier toxic); null texts count as empty."""
    keep = model.weights != 0

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sums = []
            for small in parts([texts]):
                for part in chunks([t or "" for t in small.to_pylist()]):
                    row, bucket = features(part, keep)
                    sums.append(np.bincount(row, model.weights[bucket].astype(float), len(part)))
            z = np.clip((np.concatenate(sums) if sums else np.zeros(0)) + model.bias, -40, 40)
            yield pa.array(1 / (1 + np.exp(-z)))

    return docs.withColumn(out, F.arrow_udf(released(run), "double")(F.col(text_col)))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fitting) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``.

    Learns from labels of documents that are not held out. Null and empty texts get the score of a text without
    n-grams, a null doc_id is not held out, repeated rows stay repeated, and other columns are not read. Very long texts
    are taken in pieces that overlap, with the same features. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text")
    model = fit(rows, labels.select("doc_id", "toxic"), ~held_out(F.col("doc_id")), **fitting)
    scored = score(rows, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
