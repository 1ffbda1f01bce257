"""Exact top-k inner products by block-at-a-time pruning.

Vectors are quantised to integers and stored in blocks of neighbouring ids: a block's forward index is its matrix, its
summary the largest and smallest value of every component (term). A query's score against any vector of a block is at
most the sum over terms of the larger of query value times maximum and query value times minimum. Per query, blocks
are visited in the order of these bounds, and scoring stops when the next bound falls below the k-th score so far.

Work is dealt by pairs of a chunk of queries and a group of blocks, so no task holds more than a chunk and a group,
whatever the table's size and however its ids are spread; each pair returns k rows per query and a last window merges
them. Pruning works inside each pair; no query list, index or score passes through the driver.

Scores are exact integers: where sums of products may pass 2**53, numbers of any size are multiplied instead of
doubles, and nothing is pruned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.sources.shared import materialize

BLOCK = 256
GROUP_BLOCKS = 32
CHUNK = 1024
_LONG = np.iinfo(np.int64)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(vec_id, v)``: floor(scale * x) of every component; vectors that are null or hold null, NaN or infinity go."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Summed term maxima: queries by blocks."""
    return np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by falling score, then rising id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def search_group(queries: np.ndarray, own: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best k scores and ids of each query in a group of blocks (ids, matrix), and the number of scored block visits.

    ``own`` are the queries' ids, which never match; places that stay empty hold minus infinity.
    """
    n = len(queries)
    best, names = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    most = np.stack([m.max(axis=0) for _, m in blocks])
    least = np.stack([m.min(axis=0) for _, m in blocks])
    limit = bounds(queries, most, least)
    visit = np.argsort(-limit, axis=1, kind="stable")
    visits = 0
    for turn in range(len(blocks)):
        at = visit[:, turn]
        # A bound equal to the k-th score is visited, too: an equal score with a smaller id would win.
        going = np.flatnonzero(limit[np.arange(n), at] >= best[:, -1])
        if not len(going):
            break
        for b in np.unique(at[going]):
            mine = going[at[going] == b]
            ids, matrix = blocks[b]
            scores = queries[mine] @ matrix.T
            scores[own[mine][:, None] == ids[None, :]] = -np.inf
            if scores.shape[1] > 4 * k:  # all rows at or above the k-th score of the block, ties included
                kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
                keep = scores >= np.maximum(kth, best[mine, -1])[:, None]
                width = max(1, int(keep.sum(axis=1).max()))
                order = np.argsort(~keep, axis=1, kind="stable")[:, :width]
                scores, cand = np.where(np.take_along_axis(keep, order, 1), np.take_along_axis(scores, order, 1), -np.inf), ids[order]
            else:
                cand = np.broadcast_to(ids, scores.shape)
            best[mine], names[mine] = _top(np.hstack([best[mine], scores]), np.hstack([names[mine], cand]), k)
            visits += len(mine)
    return best, names, visits


def _exact(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int) -> pd.DataFrame:
    """search_group() for integers of any size, as rows; a score beyond the range of a long becomes its nearest end."""
    out, large = [], matrix.astype(object)
    for q, me in zip(queries, own):
        scores = large @ q.astype(object)
        best = sorted((-s, i) for s, i in zip(scores, ids.tolist()) if i != me)[:k]
        out += [(int(me), i, max(_LONG.min, min(_LONG.max, -s))) for s, i in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, dim)


def _largest(matrix: np.ndarray) -> int:
    return max(abs(int(matrix.max())), abs(int(matrix.min())))


def _packed(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """A row for each ``key``: ids and vectors of its members in the order of the ids, as bytes of longs."""
    held = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("rows"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = [np.array([m["vec_id"] for m in r], np.int64).tobytes() for r in pdf["rows"]]
            data = [np.array([m["v"] for m in r], np.int64).tobytes() for r in pdf["rows"]]
            yield pdf[key].assign(ids=ids, data=data)

    kinds = ", ".join(f"{c} {t}" for c, t in held.select(*key).dtypes)
    return materialize(held.mapInPandas(pack, f"{kinds}, ids binary, data binary"), name)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each vector with ``is_query`` its k best others by integer inner product.

    ``is_query`` is a condition on ``vec_id``. Ties go to the smaller vec_id; fewer than k others give fewer rows.
    Vectors that are null, empty or hold null or non-finite components take no part, and neither do null ids. Vectors
    of different lengths have no inner product: each is held against those of its own length. Rows that repeat an id
    are other vectors to each other's queries but never to a query of their own id, and a repeated query is searched
    once, with its smallest vector (of each length). Ids may be any longs. An empty table gives no rows; other columns
    are not read.
    """
    rows = quantised(vectors, id_col, vector_col, scale).withColumn("dim", F.size("v")).where("dim > 0")
    # Of rows equal in id and vector no more than k can be among the best.
    copies = rows.groupBy("vec_id", "dim", "v").agg(F.count("*").alias("n"))
    rows = copies.select("vec_id", "dim", "v", F.explode(F.array_repeat(F.lit(0), F.least(F.col("n"), F.lit(k)).cast("int")))).drop("col")
    least, most, n, asked_n = rows.agg(F.min("vec_id"), F.max("vec_id"), F.count("*"), F.count_if(is_query)).first()
    n_blocks = max(1, -(-n // BLOCK))
    # Blocks are ranges of ids; a range that many vectors share is cut by a hash, so that no block grows with them.
    width = ((most or 0) - (least or 0) + 1) / n_blocks
    rows = rows.withColumn("block", F.floor((F.col("vec_id").cast("double") - float(least or 0)) / width))
    crowd = rows.groupBy("dim", "block").agg(F.count("*").alias("n")).where(F.col("n") > 2 * BLOCK)
    salt = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("vec_id", "v"), F.ceil(F.col("n") / BLOCK)))
    grp = F.pmod(F.xxhash64("block", "salt"), F.lit(-(-n_blocks // GROUP_BLOCKS)))
    index = _packed(rows.join(crowd, ["dim", "block"], "left").withColumn("salt", salt).withColumn("grp", grp), ["dim", "grp", "block", "salt"], "blocks")
    asked = rows.where(is_query).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    questions = _packed(asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-asked_n // CHUNK))))), ["dim", "chunk"], "questions")
    groups = index.select("dim", "grp").distinct()

    def search(key: tuple, pdf: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out, dim = [], int(key[0])
        if len(pdf) and len(others):
            blocks = [(np.frombuffer(i, np.int64), _matrix(d, dim)) for i, d in zip(others["ids"], others["data"])]
            largest, fast = max(_largest(m) for _, m in blocks), [(i, m.astype(float)) for i, m in blocks]
            for ids, data in zip(pdf["ids"], pdf["data"]):
                own, q = np.frombuffer(ids, np.int64), _matrix(data, dim)
                if _largest(q) * largest * dim >= 2**53:
                    out.append(_exact(q, own, np.concatenate([i for i, _ in blocks]), np.concatenate([m for _, m in blocks]), k))
                    continue
                for a in range(0, len(own), CHUNK):
                    mine = slice(a, a + CHUNK)
                    best, names, _ = search_group(q[mine].astype(float), own[mine], fast, k)
                    r, c = np.nonzero(best > -np.inf)
                    out.append(pd.DataFrame({"query_id": own[mine][r], "vec_id": names[r, c], "score": best[r, c].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})

    chunks = questions.select("dim", "chunk").distinct()
    pairs = chunks.join(groups, "dim")
    left = questions.join(pairs, ["dim", "chunk"]).groupBy("dim", "chunk", "grp")
    right = index.join(pairs, ["dim", "grp"])  # the stated queries against all rows, in blocks
    right = right.select(*[F.col(c).alias(c) for c in right.columns]).groupBy("dim", "chunk", "grp")  # new names for cogroup
    found = left.cogroup(right).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
