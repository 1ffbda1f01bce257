import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.oracle import check, connection
from tonelake.llm import mixing, queries


def filled(sizes, weights=(1, 2, 3)):
    """Targets by sharing again and again what stands above the caps."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: share.get(s, 3.0 * sizes[s]) for s in order}
        capped |= over


def fitted(docs, sizes, targets):
    """Words taken of every (source, hash): whole rounds, then every document that still fits in the order of the hashes."""
    out, by = {}, defaultdict(lambda: defaultdict(list))
    for d in docs:
        by[d.source][d.h].append(d.size)
    for source, hashes in by.items():
        base = round(targets[source]) // sizes[source] if sizes[source] else 0
        gap, left = round(targets[source]) - base * sizes[source], []
        for h in sorted(hashes):
            fits = sum(hashes[h]) <= gap
            gap -= sum(hashes[h]) * fits
            out[source, h] = base + fits
            left += [(sum(hashes[h]), h)] * (not fits)
        if left and sum(hashes[min(left)[1]]) < 2 * gap:
            out[source, min(left)[1]] += 1
    return out


def verify(df, **kw):
    docs = mixing.sized(df, **kw).collect()
    rows = mixing.mix(df, **kw).collect()
    sizes = defaultdict(int)
    for d in docs:
        sizes[d.source] += d.size
    want = filled(sizes) if docs else {}
    taken = fitted(docs, sizes, want)
    got = sorted(((r.doc_id, r.source, r.size, r.source_size, r.taken) for r in rows), key=str)
    assert got == sorted(((d.doc_id, d.source, d.size, sizes[d.source], taken[d.source, d.h] * d.size) for d in docs), key=str)
    assert all(r.target == pytest.approx(want[r.source], rel=1e-12) and r.taken == r.copies * r.size <= 3 * r.size for r in rows)
    return rows


def test_edge_rows(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["wört"] * rng.choice([0, 1, 2, 3, 5, 40])), rng.choice(["a", "b", "B", "é", "", None, "c", "c", "c", "c", "c"])) for i in range(400)]
    rows += [(None, "x y z", "a"), (None, "x y", "a"), (7, None, "c"), (900, "again and again", "b"), (900, "again and again", "b"), (901, "w " * 30_000, "a"), (902, " \t\n\x0b\x0c\r\x1c ", "d"), (903, None, "only nulls")]
    df = spark.createDataFrame([(*r, 5, 1, "x") for r in rows], "doc_id long, text string, source string, size int, h int, sid string").repartition(7)
    rows = verify(df)
    assert {r.size for r in rows if r.source == "d"} == {1}  # the last two characters are not white here
    again = {(r.doc_id, r.source, r.size): r.taken for r in mixing.mix(df.repartition(2)).collect()}
    assert again == {(r.doc_id, r.source, r.size): r.taken for r in rows}
    assert verify(df.limit(0)) == []
    assert {r.taken for r in verify(df.withColumn("text", F.lit("")))} == {0}
    verify(df, seed="other")


def test_one_source_and_refined_hashes(spark, monkeypatch):
    df = spark.createDataFrame([(i, "w " * (i % 7)) for i in range(300)], "doc_id long, text string").withColumn("source", F.lit("s"))
    assert {r.taken - r.size for r in verify(df)} == {0}
    monkeypatch.setattr(mixing, "LEVEL", 2)
    monkeypatch.setattr(mixing, "PLACES", 4)
    verify(df.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "s").otherwise((F.col("doc_id") % 5).cast("string"))))


def test_words_come_near_the_targets(spark, sf_dir):
    rows = queries.op13_mixing(spark, sf_dir).collect()
    by = defaultdict(int)
    for r in rows:
        by[r.source_size, r.target] += r.taken
    assert all(abs(words - target) <= 0.1 * target for (_, target), words in by.items())  # ten documents each
    assert sum(by.values()) == pytest.approx(sum(r.size for r in rows), rel=0.01)


def test_sql_and_plan(spark, sf_dir):
    check(spark, connection(sf_dir), sf_dir, queries.op13_mixing, queries.ORACLES["op13_mixing"])
    plan = queries.op13_mixing(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
