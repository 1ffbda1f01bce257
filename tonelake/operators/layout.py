"""Places on a plane from distances alone: scaling by landmarks, and how well a layout keeps the distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions import vectors
from tonelake.operators import blocks
from tonelake.operators import evaluation as ev
from tonelake.sources.shared import materialize

#: Landmarks that the axes are fitted on, the first by a hash of their key; only their distances to one another reach the driver.
LANDMARKS = 256


def landmarks_of(names: DataFrame, landmark: str = "landmark", landmarks: int = LANDMARKS) -> list:
    """The landmarks that :func:`landmark_layout` takes of these names; distances to others need not be made."""
    return [r[0] for r in names.select(landmark).distinct().orderBy(F.xxhash64(landmark), landmark).limit(landmarks).collect()]


def distances_to(items: DataFrame, key: str, vector: str, landmarks: list) -> DataFrame:
    """``(landmark, item, distance)`` of all items to those named in ``landmarks``, LANDMARKS or so: their vectors go with the tasks, and
    nothing is shuffled but the items, to all cores. A null vector, or one with a null, has a null distance; vectors of different lengths are an error."""
    rows = items.select(F.col(key).alias("item"), F.col(vector).cast("array<double>").alias("v"))
    known = rows.where(F.col("item").isin(landmarks)).collect()
    names, marks = pa.array([r["item"] for r in known]), pa.chunked_array([pa.array([r["v"] for r in known], pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, ys = blocks._vectors(marks, -2)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                x, xs = blocks._vectors(pa.chunked_array([part.column(1)]), -1)
                if len({*xs[xs >= 0], *ys[ys >= 0]}) > 1:
                    raise ValueError("vectors differ in length")
                width, total = max(x.shape[1], y.shape[1]), np.zeros((len(x), len(y)))
                x, wide = blocks._wide(x, width), blocks._wide(y, width)
                for k in range(width):
                    total += (x[:, k, None] - wide[None, :, k]) ** 2
                far = pa.array(np.sqrt(total).ravel(), mask=(xs[:, None] != ys[None, :]).ravel())
                item, mark = np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(mark)), part.column(0).take(pa.array(item)), far], names=["landmark", "item", "distance"])

    kind = rows.schema["item"].dataType.simpleString()
    dealt = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "item")
    return (dealt if known else dealt.limit(0)).mapInArrow(run, f"landmark {kind}, item {kind}, distance double")


def landmark_layout(distances: DataFrame, key: str = "item", landmark: str = "landmark", distance: str = "distance", landmarks: int = LANDMARKS) -> DataFrame:
    """``(key, x, y)`` of every item from its distances to landmarks.

    ``distances`` has a row for each item and landmark; landmarks are items, too (a missing row of a landmark with itself
    counts as 0). The squared distances among the landmarks are centred by rows and columns; the two leading axes of that
    matrix, ``landmarks`` squared at most, are the plane's. An item's place is linear in its squared distances, so it is a
    sum over its rows: items are never gathered. Distances that fit a plane are kept exactly; signs are such that the landmark
    farthest out on an axis is on its positive side. Items with a null distance, or without one to each landmark in use, are left out.
    ``distances`` is read three times and not stored: its rows are many times as many as the items, and mostly cheaper to make than to keep.
    """
    rows = distances.select(F.col(key).alias("item"), F.col(landmark).alias("landmark"), (F.col(distance).cast("double") * F.col(distance)).alias("d2"))
    rows = rows.where(F.col("d2").isNotNull())
    names = landmarks_of(rows, landmarks=landmarks)
    if not names:
        return rows.select(F.col("item").alias(key), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    place = {n: i for i, n in enumerate(names)}
    used = rows.sparkSession.createDataFrame([(n,) for n in names], rows.select("landmark").schema)
    known = rows.join(F.broadcast(used), "landmark")
    square = np.zeros((len(names), len(names)))
    among = known.join(F.broadcast(used.select(F.col("landmark").alias("item"))), "item").select("item", "landmark", "d2").collect()  # landmarks squared at most
    for r in among:
        square[place[r["item"]], place[r["landmark"]]] = r["d2"]
    means = square.mean(axis=0)
    centred = -0.5 * (square - means[None, :] - means[:, None] + square.mean())
    values, axes = np.linalg.eigh((centred + centred.T) / 2)
    best = np.argsort(-values)[:2]
    values, axes = values[best], axes[:, best]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(len(best))] < 0, -1, 1)
    pulls = np.where(values > 1e-12 * max(1.0, np.abs(centred).max()), axes / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    pulls = np.pad(pulls, ((0, 0), (0, 2 - pulls.shape[1])))
    weights = rows.sparkSession.createDataFrame([(n, float(means[i]), float(pulls[i, 0]), float(pulls[i, 1])) for n, i in place.items()], f"landmark {rows.schema['landmark'].dataType.simpleString()}, mean double, wx double, wy double")
    met = {r["item"] for r in among if r["item"] == r["landmark"]}
    own = rows.sparkSession.createDataFrame([(n, n, 0.0) for n in names if n not in met], rows.select("item", "landmark", "d2").schema)
    known = known.select("item", "landmark", "d2").unionByName(own)
    off = F.col("mean") - F.col("d2")
    sums = known.join(F.broadcast(weights), "landmark").groupBy("item").agg(F.count("*").alias("n"), F.sum(0.5 * off * F.col("wx")).alias("x"), F.sum(0.5 * off * F.col("wy")).alias("y"))
    return sums.where(F.col("n") == len(names)).select(F.col("item").alias(key), "x", "y")


def preservation(pairs: DataFrame, layout: DataFrame, query: str = "query", item: str = "item", distance: str = "distance", key: str = "item", k: int = 5) -> DataFrame:
    """``(stress, correlation, trustworthiness)`` of a layout against the distances of ``pairs`` (query, item).

    Stress is the root of the squared differences over the squared distances; correlation is by ranks, over all pairs;
    trustworthiness looks at the ``k`` nearest of each query.
    """
    at = layout.select(F.col(key).alias("_key"), F.struct("x", "y").alias("_at"))
    both = pairs.select(F.col(query).alias("query"), F.col(item).alias("item"), F.col(distance).alias("original"))
    for end in ("query", "item"):
        both = both.join(at.select(F.col("_key").alias(end), F.col("_at").alias(f"{end}_at")), end)
    gap = lambda c: F.col(f"query_at.{c}") - F.col(f"item_at.{c}")
    both = materialize(both.select("query", "item", "original", F.round(F.sqrt(gap("x") * gap("x") + gap("y") * gap("y")), 9).alias("placed")), "pairs")
    off = F.col("original") - F.col("placed")
    stress = both.agg(F.sqrt(F.sum(off * off) / F.sum(F.col("original") * F.col("original"))).alias("stress"))
    rho = ev.spearman(both, "original", "placed").select(F.col("rho").alias("correlation"))
    return stress.crossJoin(rho).crossJoin(ev.trustworthiness(both, "query", "item", "original", "placed", k))


def preservation_of_vectors(items: DataFrame, layout: DataFrame, asked: Column, key: str = "item", vector: str = "v", k: int = 5) -> DataFrame:
    """:func:`preservation` over the Euclidean distances, rounded to 9 digits, of the items that are ``asked`` to all others, block by block.

    Pairs are rows of no table: see :func:`blocks.compared`, nearest_to and places. Items without a place in the layout are left out.
    """
    placed = layout.select(F.col(key).alias("item"), F.array("x", "y").alias("_w"))
    rows = materialize(items.select(F.col(key).alias("item"), F.col(vector).alias("_v"), asked.alias("asked")).join(placed, "item"), "placed")
    q = rows.where("asked").select(F.col("item").alias("query"), "_v", "_w")
    i = rows.select("item", "_v", "_w")
    plane = lambda df: df.drop("_v").withColumnRenamed("_w", "_v")
    near = materialize(blocks.nearest_to(plane(q), plane(i), k, "distance").select("query", "item"), "near")
    goals = near.join(q.drop("_w"), "query").join(i.select("item", F.col("_v").alias("_goal")), "item")
    goals = goals.select("query", F.col("item").alias("goal_item"), F.round(vectors.euclidean(F.col("_v"), F.col("_goal")), 9).alias("goal"), "_v")
    sizes = q.agg(F.count("*").alias("m")).crossJoin(i.agg(F.count("*").alias("n")))
    return blocks.compared(q, i).crossJoin(ev.trust(blocks.places(goals, i.drop("_w"), "distance"), sizes, k))
