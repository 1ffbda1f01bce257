import math
import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import check, connection
from tonelake.llm import negatives, queries

LEAST, MOST = -(2**63), 2**63 - 1


def brute(rows, every=2, positives=5, hard=10, low=30, high=90):
    one = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            row = (label, [math.floor(256 * float(x)) for x in v])
            one[i] = min(one.get(i, row), row)
    out = []
    for a, (label, v) in one.items():
        if a % every:
            continue
        score = {i: max(LEAST, min(MOST, sum(x * y for x, y in zip(v, w)))) for i, (_, w) in one.items() if i != a and len(w) == len(v)}
        best = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in best if one[i][0] == label][:positives]:
            fit = [i for i in best if one[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fit[:hard], 1)]
    return sorted(out)


def got(df, every=2, **kw):
    out = negatives.hard_negatives(df, F.col("vec_id") % every == 0, **kw)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, dim int, cell string")


@pytest.fixture
def small_cells(monkeypatch):
    for name, value in (("CELL", 40), ("BUNDLE", 16), ("GROUP", 20), ("SLICE", 3)):
        monkeypatch.setattr(negatives, name, value)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25], 1), (1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1), (3, None, 1), (4, [nan, 1.0], 1), (6, [inf, 0.0], 2), (8, [None, 0.1], 2), (None, [1.0, 1.0], 1), (10, [0.9, 0.9], None)]
    rows += [(11, [0.2, 0.2], 2), (12, [0.25, 0.2], 2), (13, [0.25, 0.2], 3), (14, [0.2, 0.3], 2), (15, [0.3, 0.3], 1), (15, [0.3, 0.3], 1), (16, [0.1, 0.9], 2), (16, [0.9, 0.1], 2), (18, [-0.4, -0.4], 1)]
    rows += [(20, [], 1), (21, [], 1), (22, [], 2), (24, [0.5], 1), (25, [0.6], 1), (26, [0.3], 2), (27, [0.2, 0.1, 0.3], 1)]
    rows += [(-50 - i, [0.3, 0.1], i % 2) for i in range(40)]
    want = brute(rows)
    assert got(frame(spark, rows)) == want and want
    assert got(frame(spark, rows).limit(0)) == []
    large = [(i, [1e9 + 1e7 * i, -1e9 + i, 3.5e8], i % 2) for i in range(12)] + [(20, [1e15, 1e15, 1e15], 1), (22, [1e15, 9e14, 1e15], 1), (23, [2e9, 1e9, 2e8], 0)]
    assert got(frame(spark, large)) == brute(large)


def test_many_cells_groups_and_copies(spark, small_cells):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 0.5) for _ in range(6)] for _ in range(7)]
    rows = [(i, [round(c + rng.gauss(0, 0.1), 2) for c in centres[i % 7]], rng.choice([i % 7, i % 3])) for i in range(700)]
    rows += [(1000 + i, centres[0], i % 4) for i in range(200)] + [(2000 + i, centres[1][:3], i % 2) for i in range(30)]
    assert got(frame(spark, rows), 5) == brute(rows, 5)
    assert got(frame(spark, rows), 7, positives=2, negatives=3, low=0, high=100) == brute(rows, 7, 2, 3, 0, 100)


def test_bundles_out_of_reach_are_not_sent(spark, small_cells):
    rng = random.Random(6)
    rows = [(i, [(-1) ** (i % 2) * 3 + rng.gauss(0, 0.05), (i % 5) * 2 + rng.gauss(0, 0.05)], i % 10) for i in range(600)]
    fine = negatives.quantised(frame(spark, rows), "vec_id", "embedding", "label", 256)
    space = negatives._space(fine)
    index = negatives.bundles(fine, space)
    cells = [(r.dim, r.cell) for r in index.select("dim", "cell").distinct().collect()]
    own = fine.where("vec_id % 20 = 0").join(fine.select(F.col("label"), F.expr("aggregate(v, 0L, (a, x) -> a + x * x)").alias("n")).groupBy("label").agg(F.max("n").alias("n")), "label")
    asked = own.select("vec_id", F.col("vec_id").alias("positive_id"), "label", "v", "dim", F.expr("cast(n * 0.95 as long)").alias("low"), F.lit(MOST).alias("high"))
    groups = negatives._groups(asked, space)
    sent = index.select("dim", "cell", "near", "far").join(negatives._served(groups, space, cells, False), ["dim", "cell"]).where("far >= least and near <= most").count()
    assert 0 < sent < 0.8 * groups.count() * index.count()


def test_table(spark, sf_dir):
    check(spark, connection(sf_dir), sf_dir, queries.op11_negatives, queries.ORACLES["op11_negatives"])
