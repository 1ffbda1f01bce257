"""Exact similarity search: nearest neighbours, blocked self-joins, set distances, classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.functions import vectors
from tonelake.functions.hashing import class_hash
from tonelake.plans.graph import connected_components
from tonelake.plans.joins import join_back

BLOCK = 512
#: A table has so many blocks at most, since each row goes to all of them; only where a block would have more than LARGEST rows are there more.
BLOCKS, LARGEST = 32, 1 << 15
#: Products that a task holds at once.
HELD = 1 << 21


def nearest(items: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The k items nearest to one vector by Euclidean distance, ties by key: a map and a bounded heap per task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return items.select(key, vectors.euclidean(F.col(vector), q).alias("distance")).orderBy("distance", key).limit(k)


def top_categories(items: DataFrame, key: str, vector: str, prompts: dict[str, list[float]], k: int) -> DataFrame:
    """``(key, rank, label, score)``: the k best-scoring labels per item, ranks from 0, ties by place in the vocabulary.

    The vocabulary is an argument of driver size, so scores are expressions and nothing is shuffled.
    """
    scored = F.array(*[F.struct((-vectors.dot(F.col(vector), F.array(*[F.lit(float(x)) for x in p]))).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("label")) for i, (name, p) in enumerate(prompts.items())])
    best = items.select(key, F.posexplode(F.slice(F.array_sort(scored), 1, k)).alias("rank", "b"))
    return best.select(key, "rank", "b.label", (-F.col("b.s")).alias("score"))


def standardise(items: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, dim, z)``: columns at mean 0 and population deviation 1; constant ones are only centred."""
    long = items.select(key, F.posexplode(vector).alias("dim", "x"))
    stats = long.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return long.join(F.broadcast(stats), "dim").select(key, "dim", ((F.col("x") - F.col("mean")) / F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)).alias("z"))


def _blocks(items: DataFrame, key: str, vector: str, extra: list[str], block: int) -> tuple[DataFrame, int]:
    """Rows packed into blocks by a hash of the key, and the number of blocks: of about ``block`` rows each, or larger ones in a large table."""
    n = items.count()
    n = max(1, min(-(-n // block), max(BLOCKS, -(-n // LARGEST))))
    return items.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).select("_block", F.col(key).alias("_key"), F.col(vector).alias("_v"), *extra), n


def self_join(items: DataFrame, key: str, vector: str, threshold: float, extra: list[str] | None = None, condition=None, block: int = BLOCK, new: Column | None = None) -> DataFrame:
    """``(a, b, cosine)``, a < b: all pairs of unit vectors with cosine of ``threshold`` at least, each once.

    Blocks meet pairwise, a row goes to as many pairs as there are blocks, and a pair of blocks is a matrix product, made and returned in
    slices. ``condition(pdf_a, pdf_b)`` may return a boolean matrix over the ``extra`` columns. With ``new`` (a condition on the items) only
    pairs with a new item are made.
    """
    extra = extra or []
    rows, n = _blocks(items.withColumn("_new", F.lit(True) if new is None else new), key, vector, [*extra, "_new"], block)
    # Adaptive execution would join small parts that hold much work, so their number is given.
    dealt = lambda df: df.repartition(min(2048, n * (n + 1)), "p", "q")
    left = dealt(rows.withColumnRenamed("_block", "p").withColumn("q", F.explode(F.sequence(F.col("p"), F.lit(n - 1)))))
    right = dealt(_fresh(rows.withColumnRenamed("_block", "q").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("q"))))))
    kind = items.schema[key].dataType.simpleString()

    def meet(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        a, b = np.stack(one["_v"]).astype(float), np.stack(two["_v"]).astype(float)
        same = one["p"].iloc[0] == two["q"].iloc[0]
        step, found = max(1, HELD // len(b)), []
        for at in range(0, len(a), step):
            part = one.iloc[at : at + step]
            near = a[at : at + step] @ b.T
            hit = near >= threshold
            if condition is not None:
                hit &= condition(part, two)
            hit &= part["_new"].to_numpy()[:, None] | two["_new"].to_numpy()[None, :]
            i, j = np.nonzero(hit)
            x, y = part["_key"].to_numpy()[i], two["_key"].to_numpy()[j]
            keep = x < y if same else x != y
            x, y, s = x[keep], y[keep], near[i, j][keep]
            found.append(pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "cosine": s}))
        return pd.concat(found)

    return left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(_guarded(meet), f"a {kind}, b {kind}, cosine double")


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that a table can be cogrouped with a relative of its own."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _guarded(meet):
    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"a": pd.Series(dtype=object), "b": pd.Series(dtype=object), "cosine": pd.Series(dtype=float)})
        return meet(one, two)

    return run


def gain_candidates(one: pd.DataFrame, two: pd.DataFrame, slack: int = 32) -> np.ndarray:
    """Lengths that differ by ``slack`` at most."""
    return np.abs(one["length"].to_numpy()[:, None] - two["length"].to_numpy()[None, :]) <= slack


def resampled_candidates(one: pd.DataFrame, two: pd.DataFrame, slack: int = 32, least: int = 64, ratio: int = 8) -> np.ndarray:
    """Lengths that differ by more, none under ``least``, none over ``ratio`` times the other."""
    a, b = one["length"].to_numpy()[:, None], two["length"].to_numpy()[None, :]
    short, long = np.minimum(a, b), np.maximum(a, b)
    return (long - short > slack) & (short >= least) & (long <= ratio * short)


def classes(items: DataFrame, key: str, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(key, component, class_size)`` of all items; an item without links is its own class."""
    found = connected_components(edges, a, b)
    rows = items.select(key).join(found, items[key] == found.node, "left").select(key, F.coalesce("component", key).alias("component"))
    sizes = rows.groupBy("component").agg(F.count("*").alias("class_size"))
    return join_back(rows, sizes, ["component"]).select("component", key, "class_size")


def class_hashes(members: DataFrame, key: str, component: str = "component") -> DataFrame:
    """``(component, hash)``: content hash of each class of two members and more."""
    return members.groupBy(component).agg(F.collect_set(F.col(key).cast("string")).alias("m")).where(F.size("m") > 1).select(component, class_hash(F.col("m")).alias("hash"))


def class_members(classes_: DataFrame, key: str, value: object) -> DataFrame:
    """The class of one item, the item itself included."""
    own = classes_.where(F.col(key) == value).select("component")
    return classes_.join(F.broadcast(own), "component", "left_semi").select(key)


def components_within(items: DataFrame, key: str, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Classes of the given items only: links that leave them are dropped, items without links stay."""
    ends = items.select(key)
    inner = edges.join(ends, edges[a] == ends[key], "left_semi").join(ends, edges[b] == ends[key], "left_semi")
    return classes(items, key, inner, a, b)


def nearest_members(items: DataFrame, key: str, vector: str, sets: DataFrame, set_col: str, member: str, block: int = BLOCK) -> DataFrame:
    """``(key, set, distance)``: the distance of each item to the nearest member of each set.

    Items and members meet in blocks; a pair of blocks is one matrix product and returns one row per item and set.
    """
    v = items.select(key, vector)
    members = sets.join(v, sets[member] == v[key]).select(F.col(set_col).alias("_set"), vector, F.pmod(F.xxhash64(set_col), F.lit(16)).cast("int").alias("q"))
    left = v.withColumn("p", F.pmod(F.xxhash64(key), F.lit(8)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(15)))).groupBy("p", "q")
    right = _fresh(members.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(7))))).groupBy("p", "q")
    key_kind, set_kind = items.schema[key].dataType.simpleString(), sets.schema[set_col].dataType.simpleString()

    def meet(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({key: pd.Series(dtype=object), "_set": pd.Series(dtype=object), "distance": pd.Series(dtype=float)})
        out = []
        x = np.stack(one[vector]).astype(float)
        xx = (x**2).sum(axis=1)[:, None]
        for name, part in two.groupby("_set"):
            best = np.full(len(x), np.inf)
            for at in range(0, len(part), block):
                y = np.stack(part[vector].iloc[at : at + block]).astype(float)
                best = np.minimum(best, np.maximum(xx - 2 * x @ y.T + (y**2).sum(axis=1)[None, :], 0).min(axis=1))
            out.append((name, np.sqrt(best)))
        keys = one[key].tolist()
        names = [n for n, d in out for _ in d]
        return pd.DataFrame({key: pd.Series(keys * len(out), dtype=object), "_set": pd.Series(names, dtype=object), "distance": np.concatenate([d for _, d in out])})

    return left.cogroup(right).applyInPandas(meet, f"{key} {key_kind}, _set {set_kind}, distance double")


def chamfer(items: DataFrame, key: str, vector: str, sets: DataFrame, set_col: str, member: str) -> DataFrame:
    """``(a, b, distance)``, a < b: mean distance to the nearest member of the other set, averaged over both directions."""
    near = nearest_members(items, key, vector, sets, set_col, member)
    of = sets.select(F.col(set_col).alias("_from"), F.col(member).alias("_m"))
    way = near.join(of, near[key] == of._m).groupBy("_from", "_set").agg(F.avg("distance").alias("d"))
    there, back = way.alias("x"), way.alias("y")
    both = there.join(back, (F.col("x._from") == F.col("y._set")) & (F.col("x._set") == F.col("y._from")) & (F.col("x._from") < F.col("x._set")))
    return both.select(F.col("x._from").alias("a"), F.col("x._set").alias("b"), (0.5 * (F.col("x.d") + F.col("y.d"))).alias("distance"))


def layout_pca(items: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, x, y)``: the two leading principal components, a stand-in for neighbour-graph layouts.

    The covariance is summed in tasks (dimensions squared); only it reaches the driver.
    """
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, c = 0, 0.0, 0.0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vector]).astype(float)
                n, s, c = n + len(x), s + x.sum(axis=0), c + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "c": [c.ravel().tolist()]})

    parts = items.select(vector).mapInPandas(partial, "n long, s array<double>, c array<double>")
    total = parts.agg(F.sum("n").alias("n")).first().n
    if not total:
        return items.select(key, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    sums = lambda name: np.array([r.x for r in parts.select(F.posexplode(name).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()])
    mean, moment = sums("s") / total, sums("c") / total
    d = len(mean)
    values, axes = np.linalg.eigh(moment.reshape(d, d) - np.outer(mean, mean))
    axes = axes[:, np.argsort(-values)[:2]]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])] < 0, -1, 1)
    put = lambda k: vectors.dot(F.zip_with(F.col(vector), F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x.cast("double") - m), F.array(*[F.lit(float(a)) for a in axes[:, k]]))
    return items.select(key, put(0).alias("x"), put(1).alias("y") if axes.shape[1] > 1 else F.lit(0.0).alias("y"))
