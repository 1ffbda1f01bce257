import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_queries import plan
from tonelake import queries
from tonelake.functions import vectors
from tonelake.functions.hashing import laid_out, md5_heads
from tonelake.operators import blocks, similarity
from tonelake.operators import evaluation as ev

NAN = float("nan")


@pytest.fixture(scope="module", params=[False, True])
def items(request, spark):
    """Vectors with copies, and, the second time, null ones, NaN, nulls and another length among them."""
    rng = np.random.default_rng(5)
    rows = [(i, i % 4, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(120)]
    rows += [(i + 200, (i + i % 2) % 4, v) for i, _, v in rows[:80]]
    if request.param:
        rows += [(401, 1, None), (402, 2, [1.0] * 5), (403, 3, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (404, 0, [NAN] * 6), (405, None, [1.0] * 6), (420, 1, None)]
    return spark.createDataFrame(rows, "id long, label int, v array<double>").cache()


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    for name, n in dict(ITEMS=50, QUERIES=4, SORTED_ITEMS=64, SORTED_QUERIES=4, HELD=150).items():
        monkeypatch.setattr(blocks, name, n)


def sides(items, **more):
    name = lambda key: items.select(F.col("id").alias(key), F.col("v").alias("_v"), *[F.col(c).alias(n) for n, c in more.items()])
    return name("query").where("query % 20 = 0 or query > 400"), name("item")


def rows(df, digits=9):
    return sorted((tuple("nan" if v != v else round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("group", [False, True])
@pytest.mark.parametrize("k", [1, 7, 500])
def test_nearest_as_the_ranking(items, group, k):
    q, i = sides(items, _g="label")
    got = blocks.nearest_to(q if group else q.drop("_g"), i if group else i.drop("_g"), k, group=group)
    want = ev.ranked_others(items, "id", "v", group="label" if group else None, queries=F.expr("id % 20 = 0 or id > 400"))
    assert rows(got.select("query", "item", "score", "rank")) == rows(want.where(F.col("rank") <= k).select("query", "item", "similarity", "rank"))


def test_average_precision_and_chance_as_over_the_ranking(items):
    q, i = sides(items, _label="label")
    want = ev.ranked_others(items, "id", "v", queries=F.expr("id % 20 = 0 or id > 400"), carry=["label"])
    same = F.col("q_label") == F.col("i_label")
    for support in (1, 30):
        assert rows(blocks.average_precision(q, i, support)) == rows(ev.average_precision(want, same, support))
    assert blocks.chance_level(q.drop("_v"), i.drop("_v"), 3).first().ap == pytest.approx(ev.chance_level(want.drop("rank"), "query", "item", same, 3).first().ap, abs=1e-12)


@pytest.mark.parametrize("metric", ["dot", "distance"])
def test_places(items, metric):
    q, i = sides(items.where("id < 400"))
    score = F.round((vectors.dot if metric == "dot" else vectors.euclidean)(F.col("_v"), F.col("w")), 9)
    pairs = q.crossJoin(i.withColumnRenamed("_v", "w")).where("query <> item").withColumn("s", score).drop("w").cache()
    goals = pairs.where("item % 3 = 1").select("query", F.col("item").alias("goal_item"), F.col("s").alias("goal"), "_v")
    nearer = F.expr("p.s > g.goal") if metric == "dot" else F.expr("p.s < g.goal")
    for ties in (True, False):
        on = (F.col("p.query") == F.col("g.query")) & (nearer | (F.lit(ties) & F.expr("p.s = g.goal and p.item < g.goal_item")))
        want = goals.alias("g").join(pairs.alias("p"), on, "left").groupBy("g.query", "goal_item").agg((F.count("p.item") + 1).alias("place"))
        assert rows(blocks.places(goals, i, metric, ties)) == rows(want)


def test_ideal_gains(items):
    q, i = sides(items, q_label="label"), sides(items, i_label="label")
    q, i = q[0], i[1]
    gain = 1 / (1 + F.abs(F.col("q_label") - F.col("i_label")))
    ranked = ev.ranked_others(items, "id", "v", queries=F.expr("id % 20 = 0 or id > 400"), carry=["label"])
    best = ev.best_gains(q.select("query", "q_label"), i.select("i_label"), F.col("q_label") == F.col("i_label"), gain, 10)
    assert rows(ev.ndcg_of_best(blocks.nearest_to(q, i, 10), best, gain, 10)) == rows(ev.ndcg(ranked, gain, 10))


def test_steps_of_scores_come_back():
    for scores in ([5], [9, 9, 3], [10**9, 7, -(10**9)], [2**62, 5, -(2**62)], [65535, 0, -65534, -(2 * 65535)]):
        wide, data = blocks._packed(np.array(scores))
        assert blocks._unpacked(scores[0], wide, data).tolist() == scores


def test_hashes_of_many_texts():
    for before, size, after in ((b"1:", 1, b":1:0"), (b"12345:", 7, b":20:0"), (b"", 55, b"")):
        middle = np.random.default_rng(size).integers(48, 58, (20, size)).astype(np.uint8)
        want = [int(hashlib.md5(before + m.tobytes() + after).hexdigest()[:16], 16) for m in middle]
        assert md5_heads(before, laid_out(middle, len(before)), size, after).tolist() == want


@pytest.mark.parametrize("name", ["ndcg_at_10", "average_precision", "ranking_outside_group", "retrieval_rank", "retrieval_summary", "knn_regression", "rank_one_share", "trustworthiness", "chance_level"])
def test_pairs_are_not_rows(spark, sf_dir, name):
    assert "FlatMapCoGroupsInArrow" in plan(queries.QUERIES[name](spark, sf_dir)) or name == "trustworthiness"


def test_rows_go_to_a_bounded_number_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCKS", 4)
    one = spark.range(900).select("id", F.array(F.sin("id"), F.cos("id")).alias("v"))
    joined = similarity.self_join(one, "id", "v", 0.999, block=10)
    found = plan(joined)
    assert "Generate" in found and "Join" not in found  # no join with a table of pairs
    assert similarity._blocks(one, "id", "v", [], 10)[1] == 4
    x = np.array([[np.sin(i), np.cos(i)] for i in range(900)])
    assert joined.count() == (np.triu(x @ x.T, 1) >= 0.999).sum()


def test_average_precision_in_rounds(items, monkeypatch):
    """Each round is stored and its shuffles are gone before the next; the results are those of one round."""
    q, i = sides(items, _label="label")
    want, stored, keep = rows(blocks.average_precision(q, i, 5)), [], blocks.materialize
    monkeypatch.setattr(blocks, "ROUND", q.count() * i.count() * blocks.PAIR_BYTES / 3)
    monkeypatch.setattr(blocks, "materialize", lambda df, name: stored.append(keep(df, name)) or stored[-1])
    assert rows(blocks.average_precision(q, i, 5)) == want and len(want) > 3
    assert len(stored) == 3 and sum(1 for s in stored if 0 < s.count() < len(want)) > 1
    assert q.sparkSession.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_every_item_is_hashed_in_a_run():
    """Items left without a hash tie at 0, and then every ranking is made again by one call for each text."""
    sizes = np.char.str_len(np.arange(40_000).astype("S"))
    runs = blocks._alike(sizes)
    assert sorted(np.concatenate(runs).tolist()) == list(range(40_000))
    assert all(len(r) <= 8192 and len(set(sizes[r].tolist())) == 1 for r in runs)
