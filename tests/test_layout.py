import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.operators import layout


def table(spark, points, landmarks, diagonal=True):
    rows = [(i, m, float(np.linalg.norm(points[i] - points[m]))) for i in range(len(points)) for m in landmarks if diagonal or i != m]
    return spark.createDataFrame(rows, "item long, landmark long, distance double")


@pytest.mark.parametrize("diagonal", [True, False])
def test_a_plane_comes_back(spark, diagonal):
    points = np.random.default_rng(0).normal(size=(60, 2))
    out = {r["item"]: (r.x, r.y) for r in layout.landmark_layout(table(spark, points, range(0, 60, 4), diagonal)).collect()}
    got = np.array([out[i] for i in range(60)])
    want = np.linalg.norm(points[:, None] - points[None], axis=2)
    assert np.allclose(np.linalg.norm(got[:, None] - got[None], axis=2), want, atol=1e-6)


def test_as_classical_scaling_where_all_are_landmarks(spark):
    points = np.random.default_rng(1).normal(size=(30, 5)) * [4, 2, 1, 0.5, 0.2]
    out = {r["item"]: (r.x, r.y) for r in layout.landmark_layout(table(spark, points, range(30))).collect()}
    centred = points - points.mean(axis=0)
    u, s, _ = np.linalg.svd(centred)
    want = u[:, :2] * s[:2]
    got = np.array([out[i] for i in range(30)])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_edges(spark):
    rows = table(spark, np.zeros((4, 2)), [0, 2])
    assert {(r.x, r.y) for r in layout.landmark_layout(rows).collect()} == {(0.0, 0.0)}
    assert layout.landmark_layout(rows.limit(0)).collect() == []
    line = table(spark, np.array([[0.0], [1.0], [5.0], [7.0]]), [0, 3])
    placed = {r["item"]: r.x for r in layout.landmark_layout(line.where("not (item = 2 and landmark = 3)")).collect()}
    assert set(placed) == {0, 1, 3} and abs(placed[3] - placed[0]) == pytest.approx(7)
    gone = line.withColumn("distance", F.when(F.col("item") != 1, F.col("distance")))
    assert {r["item"] for r in layout.landmark_layout(gone).collect()} == {0, 2, 3}


def test_preservation(spark):
    points = np.random.default_rng(2).normal(size=(40, 2))
    pairs = table(spark, points, range(0, 40, 2)).where("item <> landmark").withColumnRenamed("landmark", "query")
    same = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "item long, x double, y double")
    good = layout.preservation(pairs.withColumn("distance", F.round("distance", 9)), same).first()
    assert good.stress == pytest.approx(0, abs=1e-6) and good.correlation == pytest.approx(1) and good.trustworthiness == 1
    bad = layout.preservation(pairs, same.withColumn("x", F.pmod(F.col("item") * 7, F.lit(11)).cast("double"))).first()
    assert bad.stress > 0.3 and bad.correlation < 0.9 and bad.trustworthiness < 0.95


def test_only_the_landmarks_in_use_are_met(spark):
    points = np.random.default_rng(3).normal(size=(40, 2))
    rows = table(spark, points, range(0, 40, 2))
    names = layout.landmarks_of(rows, landmarks=6)
    assert len(names) == 6
    want = {r["item"]: (r.x, r.y) for r in layout.landmark_layout(rows, landmarks=6).collect()}
    got = {r["item"]: (r.x, r.y) for r in layout.landmark_layout(rows.where(F.col("landmark").isin(names)), landmarks=6).collect()}
    assert got == want


def test_distances_are_not_stored(spark, monkeypatch):
    monkeypatch.setattr(layout, "materialize", lambda df, name: pytest.fail(f"{name} are stored"))
    points = np.random.default_rng(4).normal(size=(30, 2))
    for diagonal in (True, False):  # half of the landmarks' own distances are there, or none
        rows = table(spark, points, range(0, 30, 3), diagonal).where("item <> landmark or item % 2 = 0")
        out = layout.landmark_layout(rows)
        assert "LeftAnti" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r["item"]: (r.x, r.y) for r in out.collect()}
        want = np.linalg.norm(points[:, None] - points[None], axis=2)
        at = np.array([got[i] for i in range(30)])
        assert np.allclose(np.linalg.norm(at[:, None] - at[None], axis=2), want, atol=1e-6)


@pytest.mark.parametrize("scale", [1.0, 40.0])
def test_preservation_by_blocks_as_over_pairs(spark, monkeypatch, scale):
    for name, n in dict(RANKED=150, RANKED_QUERIES=7, RANKED_ITEMS=16).items():
        monkeypatch.setattr(layout.blocks, name, n)
    points = np.random.default_rng(6).normal(size=(60, 4)).round(1) * scale
    points[40:] = points[:20]  # copies, so that distances tie
    items = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "item long, v array<double>")
    at = spark.createDataFrame([(i, float(x), float(round(y))) for i, (x, y) in enumerate(points[:, :2]) if i != 8], "item long, x double, y double")
    pairs = table(spark, points, range(0, 60, 2)).where("item <> landmark").withColumnRenamed("landmark", "query").withColumn("distance", F.round("distance", 9))
    want = layout.preservation(pairs, at).first()
    out = layout.preservation_of_vectors(items, at, F.col("item") % 2 == 0)
    got = out.first()
    assert tuple(got) == pytest.approx(tuple(want), abs=1e-12) and 0.1 < got.correlation < 0.99
    none = layout.preservation_of_vectors(items, at.limit(1), F.col("item") % 2 == 0).select("stress", "correlation").first()
    assert tuple(none) == (None, None)


def test_pairs_are_no_rows_of_a_layout(spark, sf_dir):
    from tests.test_queries import plan
    from tonelake import queries

    stored, keep = [], layout.materialize
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(layout, "materialize", lambda df, name: stored.append(name) or keep(df, name))
        found = plan(queries.QUERIES["layout_preservation"](spark, sf_dir))
    assert "pairs" not in stored and "Window [row_number" not in found


def test_distances_to_landmarks_as_by_columns(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(300)] + [(900, None), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("nan")] * 5)]
    items = spark.createDataFrame(rows, "item long, v array<double>")
    got = layout.distances_to(items, "item", "v", [0, 7, 299])
    marks = items.where("item in (0, 7, 299)").select(F.col("item").alias("landmark"), F.col("v").alias("w"))
    want = items.where("item <> 900").crossJoin(marks).select("landmark", "item", layout.vectors.euclidean(F.col("v"), F.col("w")).alias("distance"))
    key = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert key(got.where("item <> 900")) == key(want)
    assert [r.distance for r in got.where("item = 900").collect()] == [None] * 3
    assert layout.distances_to(items, "item", "v", []).collect() == []
    with pytest.raises(Exception, match="differ in length"):
        layout.distances_to(items.withColumn("v", F.slice("v", 1, 5 - (F.col("item") % 2).cast("int"))), "item", "v", [0]).collect()
