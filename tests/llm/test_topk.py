import math

import numpy as np
from pyspark.sql import functions as F

from tonelake.llm import topk


def brute(rows, is_query, k=5, scale=256):
    fine = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, asked = [], {}
    for i, v in fine:
        if is_query(i):
            asked[i] = min(asked.get(i, v), v)
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(v) == len(w))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def got(df, cond, **kw):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, cond, **kw).collect())


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [0.5, -0.25]), (3, None), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 0.1]), (None, [1.0, 1.0]), (50, [-0.001, 0.001]), (100, [0.9, 0.9])]
    rows += [(7, [0.25, 0.5])] * 8 + [(-50, [0.1, 0.1])]
    df = spark.createDataFrame([(i, v, "z", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, n int")
    want = brute(rows, lambda i: i % 50 == 0)
    assert got(df, F.col("vec_id") % 50 == 0) == want and want
    assert got(df.limit(0), F.col("vec_id") % 50 == 0) == []
    odd = [(0, []), (1, [0.5, 0.5]), (2, [0.1]), (3, [0.2, 0.1]), (50, [0.7, 0.1]), (51, [0.1, 0.2, 0.3]), (100, [0.4]), (150, [0.1, 0.2, 0.4])]
    assert got(spark.createDataFrame(odd, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0) == brute(odd, lambda i: i % 50 == 0)
    large = [(i * 2**56, [1e6 + i / 8, -1e6 + i, 3.5e6]) for i in range(-3, 4)] + [(5, [1e12, 1e12, 1e12])]
    assert got(spark.createDataFrame(large, "vec_id long, embedding array<double>"), F.col("vec_id") % 2 == 0) == [(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in brute(large, lambda i: i % 2 == 0)]
    few = [(0, [0.5]), (1, [0.1])]
    assert got(spark.createDataFrame(few, "vec_id long, embedding array<float>"), F.col("vec_id") == 0) == [(0, 1, 1, 128 * 25)]


def test_table_and_crowded_ids(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert got(df, F.col("vec_id") % 50 == 0) == brute(rows, lambda i: i % 50 == 0)
    rng = np.random.default_rng(0)
    rows = [(int(i % 13), [float(x) for x in rng.normal(0, 0.3, 3).round(1)]) for i in range(900)]
    crowded = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(crowded, F.col("vec_id") % 2 == 0, k=7) == brute(rows, lambda i: i % 2 == 0, 7)


def test_pruning_skips_blocks_and_stays_exact():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (16, 8)) * 200
    blocks = [(np.arange(b * 50, b * 50 + 50), np.floor(centres[b] + rng.normal(0, 8, (50, 8)))) for b in range(16)]
    queries, own = np.stack([m[0] for _, m in blocks]), np.array([i[0] for i, _ in blocks])
    best, names, visits = topk.search_group(queries, own, blocks, 5)
    assert visits < len(queries) * len(blocks) / 2
    for q in range(len(queries)):
        every = sorted((-float(queries[q] @ v), int(i)) for ids, m in blocks for i, v in zip(ids, m) if i != own[q])[:5]
        assert [(-s, i) for s, i in zip(best[q], names[q])] == every
