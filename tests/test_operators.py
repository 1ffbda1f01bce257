import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.operators import aggregates as agg
from tonelake.operators import evaluation as ev
from tonelake.operators import history, publish
from tonelake.operators import relational as rel
from tonelake.operators import similarity as sim
from tonelake.sources import tables as tab


def test_usage_stays_with_its_rate(spark):
    usage = spark.createDataFrame([("a", 8363, 60), ("a", 8363, 72), ("a", 8363, 72), ("a", 4181, 84), ("b", 1, 0)], "s string, rate int, note int")
    got = {(r.s, r.hz): r.events for r in agg.fold_rates(usage, "s", "rate", "note").collect()}
    assert got == {("a", 8363): 1, ("a", 16726): 2, ("a", 16724): 1}
    assert [tuple(r) for r in agg.dominant_rate(agg.fold_rates(usage, "s", "rate", "note"), "s").collect()] == [("a", 16726)]


def test_dominant_takes_the_smallest_of_equals(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, None), (1, None), (2, None), (3, "x")], "k int, v string")
    assert {r.k: r.dominant for r in agg.dominant(rows, "k", "v").collect()} == {1: "a", 3: "x"}


def test_pages_are_disjoint_and_complete(spark):
    rows = spark.range(95).withColumn("v", F.col("id") % 7)
    seen = [r.id for k in range(0, 100, 20) for r in rel.page(rows, [F.desc("v"), F.asc("id")], 20, k).collect()]
    assert len(seen) == 95 == len(set(seen))


def test_ranks_of_new_tags_follow_the_known(spark):
    uses = spark.createDataFrame([("x", 5), ("y", 2), ("z", 9), ("y", 1)], "tag string, at int")
    assert {r.tag: r["rank"] for r in rel.rank_first_use(uses, "tag", "at").collect()} == {"y": 1, "x": 2, "z": 3}
    known = spark.createDataFrame([("z", 4)], "tag string, rank int")
    assert {r.tag: r["rank"] for r in rel.rank_first_use(uses, "tag", "at", known).collect()} == {"z": 4, "y": 5, "x": 6}


def test_validation(spark):
    rows = spark.createDataFrame([(1, 1, 2), (2, None, 2), (3, None, None)], "k int, a int, b int")
    bad = rel.validate(rows, {"pair": rel.all_or_none("a", "b"), "small": F.col("a") < 1, "one": rel.exactly_one(["a"], ["b"])})
    assert {r.k: r.broken for r in bad.collect()} == {1: ["small", "one"], 2: ["pair"], 3: ["one"]}


def test_state_at_every_moment(spark):
    rng = random.Random(2)
    day = lambda n: datetime.datetime(2024, 1, 1 + n)
    log = [(i, rng.randrange(4), day(i // 2), rng.choice(["insert", "update", "delete"]), rng.randrange(9)) for i in range(24)]
    df = spark.createDataFrame(log, "id int, key int, recorded_at timestamp, operation string, v int")
    for moment in {r[2] for r in log}:
        want = {}
        for i, k, at, op, v in log:
            if at <= moment:
                want[k] = None if op == "delete" else v
        got = {r.key: r.v for r in history.state_as_of(df, "key", ["id"], F.lit(moment)).collect()}
        assert got == {k: v for k, v in want.items() if v is not None}


def test_restore_plan_applied_gives_the_target(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    goal = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    plan = {r.k: (r.action, r.v) for r in history.restore_plan(now, goal, "k", ["v"]).collect()}
    assert plan == {1: ("remove", "a"), 2: ("upsert", "c"), 3: ("keep", None), 4: ("upsert", "d")}
    log = {r.k: (r.operation, r.previous, r.current) for r in history.capture_changes(now, goal, "k", ["v"]).collect()}
    assert log == {1: ("delete", '{"v":"a"}', None), 2: ("update", '{"v":"b"}', '{"v":"c"}'), 4: ("insert", None, '{"v":"d"}')}


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "seen"), (2, "b", None)], "k int, v string, review string")
    new = spark.createDataFrame([(2, "c", None), (3, "d", None)], "k int, v string, review string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(tab.upsert(old, new.withColumn("review", F.lit("new")), ["k"], keep=["review"])) == [(1, "a", "seen"), (2, "c", None), (3, "d", "new")]
    assert rows(tab.insert_absent(old, new, ["k"])) == [(3, "d", None)]
    assert rows(tab.delete(old, new, ["k"])) == [(1, "a", "seen")]


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = unit(centres[rng.integers(0, 12, 200)] + rng.normal(0, 0.15, (200, 16)))
    lengths = rng.integers(50, 900, 200)
    return x, lengths, spark.createDataFrame([(i, v.tolist(), int(n)) for i, (v, n) in enumerate(zip(x, lengths))], "id long, v array<double>, length int")


@pytest.mark.parametrize("block", [7, 64, 500])
def test_self_join_is_exact_for_any_block(planted, block):
    x, lengths, df = planted
    s = x @ x.T
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if s[i, j] >= 0.8 and abs(lengths[i] - lengths[j]) <= 32}
    got = {(r.a, r.b) for r in sim.self_join(df, "id", "v", 0.8, ["length"], sim.gain_candidates, block=block).collect()}
    assert got == want and want


@pytest.mark.parametrize("split", [1, 57, 199])
def test_new_pairs_and_old_pairs_make_the_whole(planted, split):
    _, _, df = planted
    pairs = lambda d, **kw: {(r.a, r.b) for r in sim.self_join(d, "id", "v", 0.9, block=64, **kw).collect()}
    old, new, whole = pairs(df.where(f"id < {split}")), pairs(df, new=F.col("id") >= split), pairs(df)
    assert old | new == whole and not old & new


def test_chamfer(spark):
    items = spark.createDataFrame([("kick", [0.0, 0.0]), ("snare", [3.0, 0.0]), ("pad", [0.0, 4.0]), ("bell", [30.0, 40.0])], "s string, v array<double>")
    sets = {"a": ["kick", "snare"], "b": ["kick", "snare", "pad"], "c": ["kick"], "d": ["pad"], "e": ["snare", "pad"], "f": ["kick", "snare"]}
    rows = spark.createDataFrame([(k, s) for k, v in sets.items() for s in v], "m string, s2 string")
    got = {(r.a, r.b): r.distance for r in sim.chamfer(items, "s", "v", rows, "m", "s2").collect()}
    assert got["a", "f"] == pytest.approx(0) and got["a", "b"] == pytest.approx(4 / 6) and got["c", "d"] == pytest.approx(4) and got["c", "e"] == pytest.approx(0.5 * (3 + 3.5))


def test_classes_keep_items_without_links(spark):
    items = spark.createDataFrame([(i,) for i in range(6)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 5)], "a long, b long")
    got = {r.id: (r.component, r.class_size) for r in sim.classes(items, "id", edges).collect()}
    assert got == {0: (0, 1), 1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 1), 5: (5, 1)}


def test_measures_find_structure_and_its_absence(spark):
    rng = np.random.default_rng(0)
    kinds = np.repeat(np.arange(4), 8)
    clean = np.eye(6)[kinds] * 10 + rng.normal(0, 0.1, (32, 6))
    for x, low, high in ((clean, 0.99, 1.01), (rng.normal(size=(32, 6)), 0.0, 0.6)):
        df = spark.createDataFrame([(i, unit(x)[i].tolist(), int(k)) for i, k in enumerate(kinds)], "id long, v array<double>, kind int")
        ranked = ev.ranked_others(df, "id", "v", carry=["kind"]).cache()
        same = F.col("q_kind") == F.col("i_kind")
        ap = ev.average_precision(ranked, same, 5).agg(F.avg("ap")).first()[0]
        gain = ev.ndcg(ranked, same.cast("int"), 7).agg(F.avg("ndcg")).first()[0]
        assert low <= ap <= high and (gain > 0.99 if low > 0.9 else gain < 0.7)
        chance = ev.chance_level(ranked.drop("rank"), "query", "item", same, 10).first()[0]
        assert chance < 0.4
        ranked.unpersist()


def test_rank_measures(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 12, 80), rng.integers(0, 5, 80)
    df = spark.createDataFrame([(int(x), float(y), int(x + y > 8)) for x, y in zip(a, b)], "a int, b double, p int")
    ranks = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    assert ev.spearman(df, "a", "b").first().rho == pytest.approx(np.corrcoef(ranks(a), ranks(b))[0, 1])
    pos, neg = a[a + b > 8], a[a + b <= 8]
    assert ev.auc(df, "a", F.col("p") == 1).first().auc == pytest.approx(np.mean([(x > y) + (x == y) / 2 for x in pos for y in neg]))
    means = ev.bootstrap(df.withColumn("id", F.monotonically_increasing_id()), "id", "b", 300).first()
    assert means.low < means["mean"] < means.high and means.high - means.low < 1


def test_layout_follows_the_leading_components(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)) * [5, 3, 0.1, 0.1, 0.1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r.id: (r.x, r.y) for r in sim.layout_pca(df, "id", "v").collect()}
    assert abs(np.corrcoef([got[i][0] for i in range(300)], x[:, 0])[0, 1]) > 0.99
    assert abs(np.corrcoef([got[i][1] for i in range(300)], x[:, 1])[0, 1]) > 0.99


def test_publication_leaves_nothing_private(spark):
    t = spark.createDataFrame([(1, "/home/ann/a", '{"vocabulary":"v","path":"/home/ann"}'), (2, "/other", None)], "k int, dir string, params string")
    rule = publish.Rule(rewrite={"dir": publish.renamed_directory(F.col("dir"), ["/home/ann/a"], ["one"]), "params": publish.only_key(F.col("params"), "vocabulary")})
    out = publish.published({"t": t}, {"t": rule})["t"]
    assert [tuple(r) for r in out.orderBy("k").collect()] == [(1, "/one", '{"vocabulary":"v"}'), (2, None, "{}")]
    assert publish.any_row(publish.leaks(t, "t", ["ann"])) and not publish.any_row(publish.leaks(out, "t", ["ann"]))


def test_join_refuses_unknown_keys_and_summaries_merge(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(ValueError, match="2"):
        rel.complete_join(a, b, "k")
    assert [tuple(r) for r in rel.complete_join(a.where("k = 1"), b, "k").collect()] == [(1, "x")]
    parts = [spark.createDataFrame([(3, ["b", "a"])], "n int, bad array<string>"), spark.createDataFrame([(4, ["b"])], "n int, bad array<string>")]
    assert [tuple(r) for r in rel.summed(parts, ["n"], ["bad"]).collect()] == [(7, ["a", "b"])]


def test_alike_items_are_compared_once(spark):
    kinds = [[["A", "B"]], [["A", "B"], ["C"]], [["C"]], [["D"]], []]
    items = spark.createDataFrame([(i, kinds[i % 5]) for i in range(60)], "id long, paths array<array<string>>")
    out = rel.label_agreements(items.where("id % 4 = 0"), items, "id", "paths", 3)
    sets = [{"A", "A: B"}, {"A", "A: B", "C"}, {"C"}, {"D"}, set()]
    want = {(a, b, round(len(x & y) / len(x | y), 3)) for a in range(0, 60, 4) for b in range(60) if a != b for x, y in [(sets[a % 5], sets[b % 5])] if x & y}
    assert {tuple(r) for r in out.collect()} == want
    joined = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_path" not in joined  # members meet by class, not by every path that they share
