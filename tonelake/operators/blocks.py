"""A stated query set against all items, block by block: nearest items, places of given items, average precision.

Queries and items are dealt to blocks and a pair of blocks is one matrix product, so neither pairs nor a query's ranking
are rows of a shuffle. Products only tell which pairs are in doubt; those are added up again in the order of the elements,
so results are those of a plain sum, ties included. Scores are dot products (larger is nearer) or Euclidean distances
(``metric="distance"``, smaller is nearer), rounded to 9 digits where ``rounded``. A null vector, one with a null, or one of another
length has a null score, which comes last; NaN counts as the largest number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from hashlib import md5
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tonelake.functions.hashing import laid_out, md5_heads
from tonelake.sources.shared import materialize, shuffles_deleted

#: Rows of a block at most, scores of a pair of blocks that are held at once, and pairs of blocks that are made at least.
QUERIES, ITEMS, HELD, PAIRS = 4096, 16384, 1 << 21, 48
DIGITS = 1e9


def _vectors(column: pa.ChunkedArray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows, short ones padded with zeros, and their lengths; null vectors and such with a null have length ``none``."""
    lists = pa.concat_arrays(column.chunks)
    sizes, values = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), lists.flatten()
    rows = np.zeros((len(sizes), max(sizes.max(initial=0), 1)))
    filled = np.arange(rows.shape[1]) < sizes[:, None]
    rows[filled] = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = lists.is_null().to_numpy(zero_copy_only=False)
    if values.null_count:
        gaps = np.zeros(rows.shape, bool)
        gaps[filled] = values.is_null().to_numpy(zero_copy_only=False)
        bad = bad | gaps.any(axis=1)
        rows[bad] = 0
    return rows, np.where(bad, none, sizes)


def _wide(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Numbers for the values of the columns, equal for equal values and in their order; null is -1."""
    values = [c.to_pandas().to_numpy() if c.null_count or not pa.types.is_integer(c.type) else c.to_numpy() for c in columns]
    known = [~c.is_null().to_numpy() for c in columns]
    codes = np.full(sum(map(len, values)), -1)
    at = np.concatenate(known)
    codes[at] = np.unique(np.concatenate([v[k] for v, k in zip(values, known)]), return_inverse=True)[1]
    return np.split(codes, np.cumsum([len(v) for v in values])[:-1])


def _exact(x: np.ndarray, y: np.ndarray, distance: bool, rounded: bool) -> np.ndarray:
    """Scores of rows of ``x`` with the same rows of ``y``, added up in the order of the elements."""
    out = np.zeros(max(len(x), len(y)) if x.ndim == y.ndim == 2 else np.broadcast_shapes(x.shape, y.shape)[:-1])
    for k in range(x.shape[-1]):
        out += (x[..., k] - y[..., k]) ** 2 if distance else x[..., k] * y[..., k]
    out = np.sqrt(out) if distance else out
    return np.copysign(np.floor(np.abs(out) * DIGITS + 0.5) / DIGITS, out) if rounded else out


class _Meeting:
    """Queries ``x`` and items ``y`` of one pair of blocks."""

    def __init__(self, one: pa.Table, two: pa.Table, distance: bool, rounded: bool):
        (x, xs), (y, ys) = _vectors(one["_v"], -1), _vectors(two["_v"], -2)
        width = max(x.shape[1], y.shape[1])
        self.x, self.y, self.xs, self.ys = _wide(x, width), _wide(y, width), xs, ys
        self.distance, self.rounded = distance, rounded
        self.uniform = len({*xs, *ys}) == 1
        self.finite = bool(np.isfinite(self.x).all() and np.isfinite(self.y).all())
        self.xx, self.yy = (self.x**2).sum(axis=1), (self.y**2).sum(axis=1)

    def chunks(self) -> Iterator[tuple[slice, np.ndarray, float]]:
        """Rows of queries, how near each item is (larger is nearer), and what a difference has to exceed to be sure of the order."""
        step = max(1, HELD // max(1, len(self.y)))
        eps = 4e-16 * (self.x.shape[1] + 4)
        for at in range(0, len(self.x), step):
            rows = slice(at, at + step)
            x, xx = self.x[rows], self.xx[rows]
            if not self.finite or self.x.shape[1] <= 3:
                near, slack = self.exact_all(rows), 0.0
            elif self.distance:
                near = x @ self.y.T
                near *= 2
                near -= xx[:, None]
                near -= self.yy[None, :]
                off = 4 * eps * (xx.max() + self.yy.max(initial=0))
                slack = 2 * off + 4e-9 * np.sqrt(2 * (xx.max() + self.yy.max(initial=0))) + 1e-17
            else:
                near = x @ self.y.T
                slack = 2 * eps * np.sqrt(xx.max() * self.yy.max(initial=0)) + 2e-9
            if not self.uniform:
                near[self.xs[rows, None] != self.ys[None, :]] = -np.inf
            yield rows, near, slack

    def exact_all(self, rows: slice) -> np.ndarray:
        s = np.zeros((len(self.x[rows]), len(self.y)))
        for k in range(self.x.shape[1]):
            s += (self.x[rows, k, None] - self.y[None, :, k]) ** 2 if self.distance else self.x[rows, k, None] * self.y[None, :, k]
        s = np.sqrt(s) if self.distance else s
        s = np.copysign(np.floor(np.abs(s) * DIGITS + 0.5) / DIGITS, s) if self.rounded else s
        s[np.isnan(s)] = np.inf
        return -s if self.distance else s

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Scores of the pairs; NaN where a vector has a NaN, and null ones as -inf or, for distances, inf."""
        out = np.concatenate([_exact(self.x[i[a : a + 65536]], self.y[j[a : a + 65536]], self.distance, self.rounded) for a in range(0, len(i), 65536)] or [np.zeros(0)])
        out[self.xs[i] != self.ys[j]] = np.inf if self.distance else -np.inf
        return out

    def order(self, score: np.ndarray) -> np.ndarray:
        """What sorts the nearest first."""
        return np.where(np.isnan(score), np.inf, score) if self.distance else -np.where(np.isnan(score), np.inf, score)

    def goal(self, score: np.ndarray) -> np.ndarray:
        """A score on the scale of chunks()."""
        if not self.distance:
            return score
        return -score if not self.finite or self.x.shape[1] <= 3 else -(score**2)


def _blocks(queries: DataFrame, items: DataFrame, items_most: int | None = None, queries_most: int | None = None, ranges: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both sides, dealt to pairs of blocks (p, q), ready to be cogrouped. With ``ranges`` q follows the order of ``item``, a number."""
    m, n, items_most, queries_most = queries.count(), items.count(), items_most or ITEMS, queries_most or QUERIES
    nq = max(1, -(-n // items_most))
    np_ = max(1, -(-m // queries_most), min(-(-PAIRS // nq), m // 16))
    if ranges:
        bounds = [F.lit(b) for b in sorted(set(items.stat.approxQuantile("item", [i / nq for i in range(1, nq)], 0.001)))] if nq > 1 else []
        q = sum(((F.col("item") > b).cast("int") for b in bounds), F.lit(0))
    else:
        q = F.pmod(F.xxhash64("item"), F.lit(nq)).cast("int")
    # The numbers of parts are given, since adaptive execution would join small parts that hold much work.
    parts = min(2048, 2 * np_ * nq)
    left = queries.withColumn("p", F.pmod(F.xxhash64(*[c for c in queries.columns if c != "_v"]), F.lit(np_)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    right = items.withColumn("q", q).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(np_ - 1))))
    return left.repartition(parts, "p", "q"), right.select(*[F.col(c).alias(c) for c in right.columns]).repartition(parts, "p", "q")


def _cogrouped(left: DataFrame, right: DataFrame, meet, schema: str) -> DataFrame:
    empty = to_arrow_schema(left.sparkSession.createDataFrame([], schema).schema).empty_table()

    def guarded(one: pa.Table, two: pa.Table) -> pa.Table:
        return meet(one, two).select(empty.column_names).cast(empty.schema) if one.num_rows and two.num_rows else empty

    return left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInArrow(guarded, schema)


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def nearest_to(queries: DataFrame, items: DataFrame, k: int, metric: str = "dot", rounded: bool = True, group: bool = False, itself: bool = False) -> DataFrame:
    """``(query, item, score, rank, ...)``: the ``k`` nearest items of each query, ties to the smaller item; further columns stay.

    ``queries``: (query, _v, ...), ``items``: (item, _v, ...); with ``group`` both have ``_g`` and items of the query's own group, or
    of a null one, are left out. A query's own item is one of them only with ``itself``. A pair of blocks gives k rows for a query at most.
    """
    distance = metric == "distance"
    q_more, i_more = ([c for c in df.columns if c not in ("_v", "_g")] for df in (queries, items))

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        m = _Meeting(one, two, distance, rounded)
        a, b = _codes(one["query"], two["item"])
        ga, gb = _codes(one["_g"], two["_g"]) if group else (None, None)
        found = []
        for rows, near, slack in m.chunks():
            out = np.zeros(near.shape, bool) if itself else a[rows, None] == b[None, :]
            if group:
                out |= (ga[rows, None] == gb[None, :]) | (ga[rows, None] < 0) | (gb[None, :] < 0)
            near[out] = -np.inf
            least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
            i, j = np.nonzero((near >= (least - slack)[:, None]) & ~out)
            i = i + rows.start
            score = m.exact(i, j)
            best = np.lexsort((b[j], m.order(score), i))
            i, j, score = i[best], j[best], score[best]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((i[keep], j[keep], score[keep]))
        i, j, score = (np.concatenate(c) for c in zip(*found))
        score = pa.array(score, mask=np.isinf(score) & (m.xs[i] != m.ys[j]))
        return pa.table([*[one[c].take(pa.array(i)) for c in q_more], *[two[c].take(pa.array(j)) for c in i_more], score], names=[*q_more, *i_more, "score"])

    rows = _cogrouped(*_blocks(queries, items), meet, f"{_kinds(queries, q_more)}, {_kinds(items, i_more)}, score double")
    by = F.col("score").asc_nulls_last() if distance else F.col("score").desc_nulls_last()
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(by, "item"))).where(F.col("rank") <= k)


def places(goals: DataFrame, items: DataFrame, metric: str = "dot", ties: bool = True) -> DataFrame:
    """``(query, goal_item, place)``: one more than the number of items nearer to the query than ``goal`` is, the query's own left out.

    ``goals``: (query, goal_item, goal, _v), ``items``: (item, _v). With ``ties`` items as near as the goal count if they are smaller than
    ``goal_item``. A goal without a score has a null place. Each pair of blocks gives one number for a goal.
    """
    distance = metric == "distance"

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        m = _Meeting(one, two, distance, True)
        a, g, b = _codes(one["query"], one["goal_item"], two["item"])
        score = one["goal"].to_numpy().astype(float)
        goal, counts = m.goal(score), np.zeros(len(a), np.int64)
        for rows, near, slack in m.chunks():
            near[a[rows, None] == b[None, :]] = -np.inf
            off = near - goal[rows, None]
            counts[rows] = (off > slack).sum(axis=1)
            i, j = np.nonzero((np.abs(off) <= slack) & (near > -np.inf))
            i = i + rows.start
            s, at = m.order(m.exact(i, j)), m.order(score[i])
            counts += np.bincount(i[(s < at) | (ties & (s == at) & (b[j] < g[i]))], minlength=len(a))
        return pa.table([one["query"], one["goal_item"], pa.array(counts)], names=["query", "goal_item", "n"])

    known = goals.where("goal is not null")
    rows = _cogrouped(*_blocks(known, items), meet, f"{_kinds(goals, ['query', 'goal_item'])}, n long")
    return rows.groupBy("query", "goal_item").agg((F.sum("n") + 1).alias("place"))


# ---- average precision ----------------------------------------------------------------------------------------------

#: Larger blocks of items: the scores of one are sorted, and their steps take two bytes each where they are small.
SORTED_ITEMS, SORTED_QUERIES = 1 << 17, 1024
#: Bytes that a round hands on, at PAIR_BYTES for each pair of a query and an item; so many lie on all disks together at a time.
ROUND, PAIR_BYTES = 1 << 31, 2.5


def _packed(scores: np.ndarray) -> tuple[bool, bytes]:
    """Falling whole numbers as steps; a step of 65535 or more takes further numbers, or all take eight bytes where that is shorter."""
    steps = scores[:-1] - scores[1:]
    more = steps // 65535
    if more.sum() > 3 * len(steps):
        return True, steps.astype("<i8").tobytes()
    out = np.full(len(steps) + int(more.sum()), 65535, "<u2")
    out[np.cumsum(more + 1) - 1] = steps % 65535
    return False, out.tobytes()


def _unpacked(first: int, wide: bool, data: bytes) -> np.ndarray:
    if wide:
        steps = np.frombuffer(data, "<i8")
    else:
        parts = np.frombuffer(data, "<u2").astype(np.int64)
        ends = np.flatnonzero(parts < 65535)
        steps = np.diff(np.cumsum(parts)[ends], prepend=0)
    return first - np.concatenate([[0], np.cumsum(steps)]).astype(np.int64)


def average_precision(queries: DataFrame, items: DataFrame, support: int = 1) -> DataFrame:
    """``(query, ap)`` as ``evaluation.average_precision`` over all other items by falling dot product, rounded, ties by item; items
    with the query's ``_label`` are relevant. ``queries``: (query, _v, _label), ``items``: (item, _v, _label), items are numbers.

    A pair of blocks sorts its scores and hands on their steps, two or three bytes for a pair; a query's runs are merged in one group.
    Where all pairs are more than ROUND bytes, the queries are taken in rounds, each stored and its shuffles deleted before the next.
    """
    rounds = ceil(queries.count() * items.count() * PAIR_BYTES / ROUND)
    if rounds <= 1:
        return _average_precision(queries, items, support)
    done = []
    with shuffles_deleted(queries.sparkSession):
        for r in range(rounds):
            some = queries.where(F.pmod(F.xxhash64("query"), F.lit(rounds)) == r)
            done.append(materialize(_average_precision(some, items, support), "average-precision"))
    return reduce(DataFrame.unionByName, done)


def _average_precision(queries: DataFrame, items: DataFrame, support: int) -> DataFrame:
    worst = -(2**62)  # null scores

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        two = two.sort_by("item")
        m = _Meeting(one, two, False, True)
        a, b = _codes(one["query"], two["item"])
        la, lb = _codes(one["_label"], two["_label"])
        out = []
        for rows, near, _ in m.chunks():
            near *= DIGITS
            whole = np.floor(np.abs(near) + 0.5)
            if m.finite and m.x.shape[1] > 3:
                room = 1e9 * 1e-14 * (m.x.shape[1] + 4) * np.sqrt(m.xx[rows].max() * m.yy.max()) + 1e-6
                i, j = np.nonzero(np.abs(np.abs(near) + 0.5 - np.rint(np.abs(near) + 0.5)) <= room)
                whole[i, j] = np.abs(np.rint(np.clip(m.exact(i + rows.start, j) * DIGITS, -4e18, 4e18)))
            whole = np.clip(np.copysign(whole, near), -4e18, 4e18).astype(np.int64)
            if not m.uniform:
                whole[m.xs[rows, None] != m.ys[None, :]] = worst
            best = np.argsort(-whole, axis=1, kind="stable")
            for i in range(len(whole)):
                at = best[i][b[best[i]] != a[rows.start + i]]
                if len(at):
                    own = la[rows.start + i]
                    out.append((rows.start + i, int(whole[i, at[0]]), *_packed(whole[i, at]), np.packbits((lb[at] == own) & (own >= 0)).tobytes(), len(at)))
        i, first, wide, steps, hits, n = zip(*out) if out else ((),) * 6
        block = [two["q"][0].as_py()] * len(i)
        return pa.table([one["query"].take(pa.array(i, pa.int64())), pa.array(block, pa.int32()), pa.array(first, pa.int64()), pa.array(wide, pa.bool_()), pa.array(steps, pa.binary()), pa.array(hits, pa.binary()), pa.array(n, pa.int64())], names=["query", "block", "first", "wide", "steps", "hits", "n"])

    kind_of_query = to_arrow_schema(queries.select("query").schema).field("query").type

    def merge(runs: pa.Table) -> pa.Table:
        runs = runs.sort_by("block").to_pylist()
        scores = np.concatenate([_unpacked(r["first"], r["wide"], r["steps"]) for r in runs])
        hits = np.concatenate([np.unpackbits(np.frombuffer(r["hits"], np.uint8), count=r["n"]) for r in runs]).astype(bool)
        at = np.flatnonzero(hits[np.argsort(-scores, kind="stable")]) + 1
        ap = float((np.arange(1, len(at) + 1) / at).mean()) if len(at) else None
        return pa.table([pa.array([runs[0]["query"]], kind_of_query), pa.array([ap], pa.float64()), pa.array([len(at)], pa.int64())], names=["query", "ap", "n"])

    kind = _kinds(queries, ["query"])
    runs = _cogrouped(*_blocks(queries, items, SORTED_ITEMS, SORTED_QUERIES, ranges=True), meet, f"{kind}, block int, first long, wide boolean, steps binary, hits binary, n long")
    return runs.groupBy("query").applyInArrow(merge, f"{kind}, ap double, n long").where(F.col("n") >= support).select("query", "ap")


def _alike(sizes: np.ndarray, most: int = 8192) -> list[np.ndarray]:
    """Where equal sizes stand, each place once, in runs of ``most`` that stay in a core's cache."""
    return [at[i : i + most] for n in np.unique(sizes) for at in [np.flatnonzero(sizes == n)] for i in range(0, len(at), most)]


def chance_level(queries: DataFrame, items: DataFrame, draws: int = 20, seed: str = "0") -> DataFrame:
    """``(ap)`` as ``evaluation.chance_level``, every other item being ranked: mean average precision over rankings by a hash.

    ``queries``: (query, _label), ``items``: (item, _label), both whole numbers. Only numbers and labels are dealt, to each block of
    queries; a ranking is made and summed up where they meet, one draw of one query at a time, so no ranking is stored.
    """

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        la, lb = _codes(one["_label"], two["_label"])
        numbers, out = two["item"].to_numpy(), []
        texts = two["item"].cast(pa.string()).to_numpy().astype("S")
        sizes = np.char.str_len(texts)
        alike = _alike(sizes)
        digits = [np.ascontiguousarray(texts[at]).view(np.uint8).reshape(len(at), -1)[:, : sizes[at[0]]] for at in alike]
        laid = lru_cache(2)(lambda start: [laid_out(d, start) for d in digits])
        heads = np.zeros(len(numbers), np.uint64)
        for q, own in zip(one["query"].to_pylist(), la):
            keep = numbers != q
            hits = (lb == own) & keep & (own >= 0)
            if not hits.any():
                continue
            total = 0.0
            for k in range(1, draws + 1):
                before, after = b"%d:" % q, b":%d:%s" % (k, seed.encode())
                for at, number, words in zip(alike, digits, laid(len(before))):
                    heads[at] = md5_heads(before, words, number.shape[1], after)
                ranked = np.sort(heads[keep])
                if (ranked[1:] == ranked[:-1]).any():  # then the rest of the hash decides
                    order = sorted(np.flatnonzero(keep), key=lambda i: (md5(b"%d:%d:%d:%s" % (q, numbers[i], k, seed.encode())).digest(), numbers[i]))
                    at = np.flatnonzero(hits[order]) + 1
                else:
                    at = np.searchsorted(ranked, np.sort(heads[hits])) + 1
                total += float((np.arange(1, len(at) + 1) / at).mean())
            out.append((total, draws))
        total, n = zip(*out) if out else ((), ())
        return pa.table([pa.array(total, pa.float64()), pa.array(n, pa.int64())], names=["total", "n"])

    m = queries.count()
    left, right = _blocks(queries, items, 1 << 62, max(16, -(-m // 128)))
    sums = _cogrouped(left, right, meet, "total double, n long")
    return sums.agg((F.sum("total") / F.sum("n")).alias("ap"))


# ---- two distances of the same pairs --------------------------------------------------------------------------------

#: Pairs that a task takes at once, to make them or to rank them; rows of a block of queries and of items for that.
RANKED, RANKED_QUERIES, RANKED_ITEMS = 1 << 21, 512, 4096
_SUMS = {c: "double" for c in ("a", "b", "aa", "bb", "ab", "off", "square")}


def _shrunk(values: np.ndarray) -> bytes:
    return values.astype("<u4" if values.max(initial=0) < 2**32 else "<i8").tobytes()


def _grown(column: pa.ChunkedArray, sizes: list[int]) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u4" if len(b) == 4 * n else "<i8").astype(np.int64) for b, n in zip(column.to_pylist(), sizes)]


def _counted(o: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of numbers, sorted, and how often each is there."""
    if max(o.max(initial=0), p.max(initial=0)) < 2**32:
        both, n = np.unique(o.astype(np.uint64) << np.uint64(32) | p.astype(np.uint64), return_counts=True)
        return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(2**32 - 1)).astype(np.int64), n
    order = np.lexsort((p, o))
    o, p = o[order], p[order]
    first = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (p[1:] != p[:-1]))[: len(o)])
    return o[first], p[first], np.diff(np.append(first, len(o)))


def _twice_ranked(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Twice the mean place of each value, from 1, each being there ``n`` times."""
    _, which = np.unique(values, return_inverse=True)
    sizes = np.bincount(which, n).astype(np.int64)
    return (2 * np.cumsum(sizes) - sizes + 1)[which]


def compared(queries: DataFrame, items: DataFrame) -> DataFrame:
    """``(stress, correlation)`` of two distances over all pairs of a query and another item: by ``_v`` and by ``_w``.

    ``queries``: (query, _v, _w), ``items``: (item, _v, _w), all of one length, without nulls. Stress is the root of the squared differences
    over the squared distances by ``_v``; correlation is by ranks, equal distances sharing their mean place. A pair of blocks makes the distances, rounded to 9 digits, and deals
    them to ranges of the first; a range is ranked and dealt to ranges of the second; each hands on the sums of places within two ranges, to which
    the places before them are added. Ranges hold about RANKED pairs, equal pairs being one, and a pair is 16 bytes of shuffle in all.
    """
    m, n = queries.count(), items.count()
    some = lambda df, key, rows: [np.array([r[c] for r in part], float).reshape(len(part), -1) for part in [df.orderBy(F.xxhash64(key), key).limit(rows).collect()] for c in ("_v", "_w")]
    ranges = max(1, -(-m * n // RANKED))
    bounds = []  # where ranges end, after a sample of pairs; they decide nothing but who adds up what
    for x, y in zip(some(queries, "query", 64), some(items, "item", 2048)):
        known = np.concatenate([np.sqrt(((one - y) ** 2).sum(axis=1)) for one in x] or [np.zeros(0)])
        known = known[np.isfinite(known)]
        bounds.append(np.unique((np.quantile(known, np.arange(1, ranges) / ranges) * DIGITS).astype(np.int64)) if len(known) else np.zeros(0, np.int64))

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        sides = [_Meeting(pa.table({"_v": one[c]}), pa.table({"_v": two[c]}), True, True) for c in ("_v", "_w")]
        a, b = _codes(one["query"], two["item"])
        made = [], []
        step = max(1, (1 << 15) // max(1, len(b)))  # sums that stay in a core's cache
        for at in range(0, len(a), step):
            rows = slice(at, at + step)
            other = a[rows, None] != b[None, :]
            for side, out in zip(sides, made):
                out.append(np.rint(np.clip(-side.exact_all(rows)[other] * DIGITS, 0, 4e18)).astype(np.int64))
        o, p, c = _counted(*map(np.concatenate, made))
        ends = [0, *np.searchsorted(o, bounds[0]), len(o)]
        out = []
        for r, (start, end) in enumerate(zip(ends, ends[1:])):
            if end > start:
                x, y, k = o[start:end], p[start:end], c[start:end]
                out.append((r, end - start, _shrunk(x), _shrunk(y), _shrunk(k) if k.max() > 1 else b"", float((k * ((x - y) / DIGITS) ** 2).sum()), float((k * (x / DIGITS) ** 2).sum())))
        return pa.table([*map(list, zip(*out))] or [[]] * 7, names=["r", "n", "o", "p", "k", "off", "square"])

    def gathered(parts: pa.Table, *names: str) -> tuple[np.ndarray, ...]:
        sizes = parts["n"].to_pylist()
        counts = [_grown(pa.chunked_array([[k]]), [n])[0] if k else np.ones(n, np.int64) for k, n in zip(parts["k"].to_pylist(), sizes)]
        return *[np.concatenate(_grown(parts[c], sizes)) for c in names], np.concatenate(counts)

    def rank(parts: pa.Table) -> pa.Table:
        o, p, k = gathered(parts, "o", "p")
        a, r = _twice_ranked(o, k), parts["r"][0].as_py()
        order = np.argsort(p, kind="stable")
        a, p, k = a[order], p[order], k[order]
        ends = [0, *np.searchsorted(p, bounds[1]), len(p)]
        rest = [sum(parts["off"].to_pylist()), sum(parts["square"].to_pylist())]
        out = []
        for s, (start, end) in enumerate(zip(ends, ends[1:])):
            if end > start:
                out.append((s, r, end - start, _shrunk(a[start:end]), _shrunk(p[start:end]), _shrunk(k[start:end]) if k[start:end].max() > 1 else b"", *rest))
                rest = [0.0, 0.0]
        return pa.table([*map(list, zip(*out))], names=["s", "r", "n", "a", "p", "k", "off", "square"])

    def add_up(parts: pa.Table) -> pa.Table:
        a, p, k = gathered(parts, "a", "p")
        a, b = a / 2, _twice_ranked(p, k) / 2
        numbers = parts["r"].to_numpy()
        kinds, r = np.unique(np.repeat(numbers, parts["n"].to_numpy()), return_inverse=True)
        sums = {"a": a, "b": b, "aa": a * a, "bb": b * b, "ab": a * b}
        kept = {name: np.bincount(r, k * x, len(kinds)) for name, x in sums.items()}
        more = {name: np.bincount(np.searchsorted(kinds, numbers), parts[name].to_numpy(), len(kinds)) for name in ("off", "square")}
        s = np.full(len(kinds), parts["s"][0].as_py())
        return pa.table({"r": kinds, "s": s, "n": np.bincount(r, k, len(kinds)), **kept, **more})

    def dealt(df: DataFrame, by: str, run, schema: str) -> DataFrame:
        return df.repartition(min(2048, max(48, ranges)), by).groupBy(by).applyInArrow(run, schema)

    pairs = _cogrouped(*_blocks(queries, items, RANKED_ITEMS, RANKED_QUERIES), meet, "r long, n long, o binary, p binary, k binary, off double, square double")
    ranked = dealt(pairs, "r", rank, "s long, r long, n long, a binary, p binary, k binary, off double, square double")
    sums = materialize(dealt(ranked, "s", add_up, f"r long, s long, n double, {', '.join(f'{c} {t}' for c, t in _SUMS.items())}"), "sums")
    total = sums.agg(F.sum("n")).first()[0] or 0
    before = lambda c: sums.groupBy(c).agg(F.sum("n").alias("_n")).select(c, (F.sum("_n").over(W.orderBy(c)) - F.col("_n") - (total + 1) / 2).alias(f"_{c}"))
    placed = sums.join(before("r"), "r").join(before("s"), "s")
    x, y = F.col("_r"), F.col("_s")
    cross = F.sum(F.col("n") * x * y + x * F.col("b") + y * F.col("a") + F.col("ab"))
    square = lambda at, c: F.sum(F.col("n") * at * at + 2 * at * F.col(c) + F.col(c * 2))
    spread = F.sqrt(square(x, "a")) * F.sqrt(square(y, "b"))
    squares = F.sum("square")
    return placed.agg(F.when(squares > 0, F.sqrt(F.sum("off") / squares)).alias("stress"), F.when(spread > 0, cross / spread).alias("correlation"))
