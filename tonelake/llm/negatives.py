"""Hard negatives by a distributed nearest-neighbour join over Voronoi cells.

A vector x is lengthened by ``sqrt(M**2 - |x|**2)``, where M is the largest norm, and an anchor q by zero. Then
``|q - x|**2 = |q|**2 + M**2 - 2 * (q . x)``: the largest inner products are the nearest neighbours, and triangle inequalities
hold. Every row goes to the nearest of at most PIVOTS pivots; a cell is cut into bundles of at most BUNDLE rows by rings
of the distance to its pivot, of which the least and the largest distance are known.

A query may ask for scores in a range, so it has an outer and an inner radius. Queries are gathered in groups of at most
GROUP by their nearest pivots. From the distances of a group's queries to a cell's pivot and their radii follow bounds on
the distances of rows that one of them may need; only bundles within these bounds are sent to the group, and joined with it there
exactly. A first round inside the queries' own cells gives them their radii.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.sources.shared import materialize

PIVOTS, CELL = 1024, 2048
BUNDLE = 2048
GROUP = 1024
#: Bundles that a task joins with a group at once.
SLICE = 16
_LONG = np.iinfo(np.int64)


class Space:
    """The pivots of vectors of one length; vectors of other lengths have none, and bounds say nothing about them."""

    def __init__(self, pivots: np.ndarray, norm2: float) -> None:
        self.pivots, self.norm2, self.dim = pivots, norm2, pivots.shape[1] - 1

    def slack(self) -> float:
        """What rounding may add to a distance."""
        return 1e-6 * (1 + self.norm2**0.5)

    def distances(self, rows: np.ndarray, queries: bool) -> np.ndarray:
        """From each row, lengthened, to each pivot."""
        more = np.zeros(len(rows)) if queries else np.sqrt(np.maximum(0.0, self.norm2 - (rows**2).sum(axis=1)))
        long = np.column_stack([rows, more])
        return np.sqrt(np.maximum(0.0, (long**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * long @ self.pivots.T))


def _matrix(vectors: list, dim: int) -> np.ndarray:
    return np.array([*vectors], np.int64).reshape(len(vectors), dim)


def _largest(matrix: np.ndarray) -> int:
    return max(abs(int(matrix.max())), abs(int(matrix.min()))) if matrix.size else 0


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles where sums stay below 2**53, else integers of any size, held at the ends of a long."""
    if _largest(queries) * _largest(rows) * max(1, queries.shape[1]) < 2**53:
        return queries.astype(float) @ rows.astype(float).T
    return np.clip(queries.astype(object) @ rows.astype(object).T, _LONG.min, _LONG.max).astype(np.int64)


def _space(rows: DataFrame) -> Space:
    """Pivots from the commonest length of vectors: those with the smallest hashes, one for each CELL rows, PIVOTS at most."""
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("norm2"))
    most = sizes.orderBy(F.desc("n"), "dim").first()
    if most is None or not most.dim:
        return Space(np.zeros((0, 1)), 0.0)
    n = max(1, min(PIVOTS, most.n // CELL))
    chosen = rows.where(F.col("dim") == most.dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("v").collect()
    found = np.unique(_matrix([r.v for r in chosen], most.dim).astype(float), axis=0)
    return Space(np.column_stack([found, np.sqrt(np.maximum(0.0, most.norm2 - (found**2).sum(axis=1)))]), most.norm2)


def _in_cells(rows: DataFrame, space: Space, queries: bool) -> DataFrame:
    """``rows`` with ``cell`` (-1 without pivots) and the distance to its pivot."""
    own = [f for f in rows.schema.fields]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in own] + ["cell int", "far double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells, far = np.full(len(pdf), -1, np.int32), np.zeros(len(pdf))
            known = np.flatnonzero(pdf["dim"].to_numpy() == space.dim) if len(space.pivots) else []
            for at in range(0, len(known), 512):
                own = known[at : at + 512]
                d = space.distances(_matrix([pdf["v"].iloc[i] for i in own], space.dim).astype(float), queries)
                cells[own], far[own] = d.argmin(axis=1), d.min(axis=1)
            yield pdf.assign(cell=cells, far=far)

    return rows.mapInPandas(run, schema)


def _packed(rows: DataFrame, key: list[str], fields: list[str], name: str) -> DataFrame:
    """A row for each ``key``: its members' ``fields`` (longs) and vectors as bytes of longs, in the order of the fields."""
    kinds = dict(rows.dtypes)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(fields)
        out = {c: [pdf[c].iloc[0]] for c in key} | {c: [pdf[c].to_numpy(np.int64).tobytes()] for c in fields}
        return pd.DataFrame(out | {"data": [_matrix(pdf["v"], int(pdf["dim"].iloc[0])).tobytes()], "near": [float(pdf["far"].min())], "far": [float(pdf["far"].max())]})

    schema = ", ".join([f"{c} {kinds[c]}" for c in key] + [f"{c} binary" for c in fields] + ["data binary", "near double", "far double"])
    return materialize(rows.groupBy(*key).applyInPandas(pack, schema), name)


def _cut(rows: DataFrame, key: list[str], size: int) -> DataFrame:
    """``rows`` with ``part``: rings of the distance to the pivot, each cut by a hash where it has over ``size`` rows."""
    stats = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
    ring = F.least(F.ceil(F.col("n") / size) - 1, F.floor((F.col("far") - F.col("low")) / (F.col("high") - F.col("low") + 1e-9) * F.ceil(F.col("n") / size))).cast("int")
    rows = rows.join(stats, key).withColumn("ring", ring).drop("n", "low", "high")
    crowds = rows.groupBy(*key, "ring").agg(F.count("*").alias("n")).where(F.col("n") > size)
    salt = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") * 1.25 / size)))
    return rows.join(crowds, [*key, "ring"], "left").withColumn("part", F.xxhash64("ring", salt)).drop("n", "ring")


def bundles(rows: DataFrame, space: Space) -> DataFrame:
    """``(dim, cell, part, vec_id, label, data, near, far)``: the rows in bundles, stored."""
    return _packed(_cut(_in_cells(rows, space, False), ["dim", "cell"], BUNDLE), ["dim", "cell", "part"], ["vec_id", "label"], "bundles")


def _groups(queries: DataFrame, space: Space) -> DataFrame:
    """Queries in groups of about GROUP by regions of neighbouring pivots, packed."""
    n = queries.count()
    seeds = min(len(space.pivots), max(1, n // GROUP))
    region = np.zeros(max(1, len(space.pivots)), int)
    if seeds > 1:
        p = space.pivots
        region = ((p[:, None, :] - p[None, :: max(1, len(p) // seeds)][:, :seeds, :]) ** 2).sum(axis=2).argmin(axis=1)
    regions = F.array(*[F.lit(int(r)) for r in region])
    rows = _in_cells(queries, space, True)
    rows = rows.withColumn("region", F.when(F.col("cell") < 0, F.lit(-1)).otherwise(F.element_at(regions, F.greatest(F.col("cell"), F.lit(0)) + 1)))
    crowds = rows.groupBy("dim", "region").agg(F.count("*").alias("n"))
    rows = rows.join(crowds, ["dim", "region"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "positive_id"), F.ceil(F.col("n") / GROUP)))
    rows = rows.withColumn("grp", F.xxhash64("dim", "region", "part"))
    return _packed(rows.drop("region", "n", "part"), ["dim", "grp"], ["vec_id", "positive_id", "label", "low", "high", "cell"], "groups")


def _radii(space: Space, data: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outer and inner radius of each query: rows with scores from ``low`` to ``high`` are between them."""
    both = (data.astype(float) ** 2).sum(axis=1) + space.norm2
    outer = np.where(low == _LONG.min, np.inf, np.sqrt(np.maximum(0.0, both - 2.0 * low.astype(float))) + space.slack())
    inner = np.where(high == _LONG.max, 0.0, np.sqrt(np.maximum(0.0, both - 2.0 * high.astype(float))) - space.slack())
    return outer, inner


def _served(groups: DataFrame, space: Space, cells: list[tuple[int, int]], home: bool) -> DataFrame:
    """``(dim, grp, cell, least, most)``: a bundle of the cell may serve the group if its largest distance to the pivot is
    ``least`` or more and its smallest ``most`` or less. ``home``: the queries' own cells only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g in pdf.itertuples():
                own = np.frombuffer(g.cell, np.int64)
                if g.dim != space.dim or not len(space.pivots):
                    out += [(g.dim, g.grp, c, -np.inf, np.inf) for d, c in cells if d == g.dim]
                    continue
                data = np.frombuffer(g.data, np.int64).reshape(-1, g.dim)
                far = space.distances(data.astype(float), True)
                outer, inner = _radii(space, data, np.frombuffer(g.low, np.int64), np.frombuffer(g.high, np.int64))
                for c in [c for d, c in cells if d == g.dim]:
                    if home:
                        out += [(g.dim, g.grp, c, -np.inf, np.inf)] * bool((own == c).any())
                    else:  # a row at distance t from the pivot is between |at - t| and at + t from the query
                        at = far[:, c]
                        out.append((g.dim, g.grp, c, float(np.maximum(at - outer, inner - at).min()), float((at + outer).max())))
            yield pd.DataFrame(out, columns=["dim", "grp", "cell", "least", "most"])

    return groups.mapInPandas(run, "dim int, grp long, cell int, least double, most double")


def _search(groups: DataFrame, index: DataFrame, served: DataFrame, space: Space, k: int, same_label: bool) -> DataFrame:
    """``(anchor_id, positive_id, vec_id, score)``: for every query its ``k`` best rows of the bundles that may serve it, by slice."""
    light = index.select("dim", "cell", "part", "near", "far")
    pairs = served.join(light, ["dim", "cell"]).where((F.col("far") >= F.col("least")) & (F.col("near") <= F.col("most")))
    slices = F.greatest(F.lit(1), F.ceil(F.count("*") / SLICE))
    pairs = pairs.join(pairs.groupBy("grp").agg(slices.alias("slices")), "grp").withColumn("slice", F.pmod(F.xxhash64("cell", "part"), F.col("slices")))
    pairs = materialize(pairs.select("dim", "grp", "cell", "part", "slice"), "pairs")
    left = groups.join(pairs.select("dim", "grp", "slice").distinct(), ["dim", "grp"]).groupBy("grp", "slice")
    right = index.join(pairs, ["dim", "cell", "part"]).select(*[F.col(c).alias(c) for c in ("grp", "slice", "cell", "vec_id", "label", "data")]).groupBy("grp", "slice")

    def join(group: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        g = group.iloc[0]
        ids, positives, labels, low, high = (np.frombuffer(g[c], np.int64) for c in ("vec_id", "positive_id", "label", "low", "high"))
        queries = np.frombuffer(g["data"], np.int64).reshape(len(ids), int(g["dim"]))
        best: list[list[tuple]] = [[] for _ in ids]
        for names, kinds, data in zip(rows["vec_id"], rows["label"], rows["data"]):
            names, kinds = np.frombuffer(names, np.int64), np.frombuffer(kinds, np.int64)
            scores = products(queries, np.frombuffer(data, np.int64).reshape(len(names), queries.shape[1]))
            for q in range(len(ids)):
                own = scores[q]
                least = max(low[q], best[q][-1][0] * -1) if len(best[q]) == k else low[q]
                fit = np.flatnonzero((own >= least) & (own <= high[q]) & ((kinds == labels[q]) == same_label) & (names != ids[q]))
                if len(fit) > 4 * k:  # ties with the k-th stay
                    fit = fit[own[fit] >= np.partition(own[fit], len(fit) - k)[len(fit) - k]]
                if len(fit):
                    best[q] = sorted(best[q] + [(-int(s), int(i)) for s, i in zip(own[fit], names[fit])])[:k]
        out = [(int(ids[q]), int(positives[q]), i, -s) for q in range(len(ids)) for s, i in best[q]]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "vec_id", "score"], dtype="int64")

    return left.cogroup(right).applyInPandas(join, "anchor_id long, positive_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def share_of(score: str, parts: int, whole: int, up: bool) -> Column:
    """``parts / whole`` of a whole number of 0 or more, rounded up or down, without passing the range of a long on the way."""
    return F.expr(f"({score} div {whole}) * {parts} + (({score} % {whole}) * {parts} + {whole - 1 if up else 0}) div {whole}")


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``(vec_id, label, v, dim)``: floor(scale * x) of every component, one row for each id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.dropna().where(fine).withColumn("v", F.transform("x", lambda x: F.floor(x * scale).cast("long")))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v", F.size("r.v").alias("dim"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Scores are inner products of the vectors times ``scale``, rounded down to whole numbers. An anchor (condition on vec_id)
    has as positives its best other rows of the same label, and for each positive as negatives the best rows of other labels
    whose score is from ``low`` to ``high`` percent of the positive's. Ties go to the smaller vec_id; fewer rows give
    fewer results. A negative positive score has no such range, so it gives none.

    Rows with a null id or label, a null vector or a null or non-finite component take no part; numbers of a label are compared
    as longs. Vectors of different lengths have no inner product and never meet. Rows that share an id are one, the one
    with the smallest (label, vector). Numbers of any size give exact scores, those beyond a long its ends. An empty
    table gives no rows; other columns are not read.
    """
    fine = materialize(quantised(vectors, id_col, vector_col, label_col, scale), "vectors")
    space = _space(fine)
    index = bundles(fine, space)
    cells = [(r.dim, r.cell) for r in index.select("dim", "cell").distinct().collect()]
    whole = [F.lit(int(_LONG.min)).alias("low"), F.lit(int(_LONG.max)).alias("high")]
    anchors = fine.where(is_anchor).select("vec_id", F.col("vec_id").alias("positive_id"), "label", "v", "dim", *whole)
    groups = _groups(anchors, space)
    first = materialize(_search(groups, index, _served(groups, space, cells, True), space, positives, True), "near-positives")
    reach = _ranked(first, positives).where(F.col("rank") == positives).select(F.col("anchor_id").alias("vec_id"), F.col("score").alias("reached"))
    wide = anchors.join(reach, "vec_id", "left").withColumn("low", F.coalesce("reached", "low")).drop("reached")
    groups = _groups(wide, space)
    good = _ranked(_search(groups, index, _served(groups, space, cells, False), space, positives, True), positives)
    good = materialize(good.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    ranges = good.where("positive_score >= 0").select(F.col("anchor_id").alias("vec_id"), "positive_id", share_of("positive_score", low, 100, True).alias("low"), share_of("positive_score", high, 100, False).alias("high"))
    asked = anchors.drop("positive_id", "low", "high").join(ranges, "vec_id").select("vec_id", "positive_id", "label", "v", "dim", "low", "high")
    groups = _groups(asked, space)
    bad = _ranked(_search(groups, index, _served(groups, space, cells, False), space, negatives, False), negatives)
    bad = bad.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return bad.join(good, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
