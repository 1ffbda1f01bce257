import random

import pytest
from pyspark.sql import functions as F

from tonelake.operators import aggregates as agg
from tonelake.operators import variants
from tonelake.plans import ranks, resumable, steps
from tonelake.sources.shared import new_path
from tonelake.streaming import events as stream


@pytest.fixture
def many_parts(spark):
    """Ordered tables in as many parts as there are shuffle partitions, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# ---- carried values and interpolation


def test_carried_over_parts(spark, many_parts):
    rng = random.Random(0)
    rows = [(g, i, rng.choice([None, None, None, i])) for g in (None, "a", "b", "c") for i in range(rng.choice([3, 90, 200]))] + [("d", i, None) for i in range(50)]
    out = ranks.carried(spark.createDataFrame(rows, "g string, i int, v int").repartition(3), "g", [F.col("i")], "v", "last").collect()
    want, last = {}, {}
    for g, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        last[g] = v if v is not None else last.get(g)
        want[g, i] = last[g]
    assert {(r.g, r.i): r["last"] for r in out} == want and len(out) == len(rows)


def test_interpolated(spark, many_parts):
    knots = [("a", 0.0, 10.0), ("a", 1.0, 20.0), ("a", 1.0, 30.0), ("a", 3.0, 50.0), ("b", 2.0, 5.0), (None, 0.0, 1.0), (None, 2.0, 2.0), ("a", None, 9.0), ("a", 2.0, None)]
    points = [("a", -1.0), ("a", 0.0), ("a", 0.5), ("a", 1.0), ("a", 2.0), ("a", 9.0), ("a", None), ("b", 0.0), ("b", 2.0), ("b", 7.0), ("c", 1.0), (None, 1.0), ("a", 0.5)]
    p, k = spark.createDataFrame(points, "g string, x double"), spark.createDataFrame(knots, "g string, x double, y double")
    got = sorted(((r.g, r.x, r.y) for r in ranks.interpolated(p, k, "g", "x", "y", "y").collect()), key=str)
    values = [10.0, 10.0, 15.0, 30.0, 40.0, 50.0, None, 5.0, 5.0, 5.0, None, 1.5, 15.0]
    assert got == sorted(((g, x, y) for (g, x), y in zip(points, values)), key=str)
    assert ranks.interpolated(p.limit(0), k, "g", "x", "y", "y").collect() == []


def test_time_map_inverts_a_curve(spark, many_parts):
    rows = [("a", float(t), n) for t, n in enumerate([1, 3, 4, 2])] + [("b", 10.0 * t, n) for t, n in enumerate([5, 0, 5])]
    shares = agg.quantile_map(spark.createDataFrame(rows, "g string, at double, n int"), "g", "n", "at")
    out = agg.time_map(shares.where("g = 'a'").select("at", "share", F.lit("b").alias("source")), shares, "g", "source", "at", "share").orderBy("at").collect()
    assert [r.source_time for r in out] == pytest.approx([0.0, 0.0, 16.0, 20.0])


# ---- budgets


def spent(rows, capacity, refill):
    out, held = {}, {}
    for k, at, i, cost in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] or "", r[1], r[2])):
        tokens, since = held.get(k, (capacity, at))
        held[k] = min(capacity, tokens + (at - since) * refill) - (cost or 0.0), at
        out[i] = held[k][0]
    return out


def visits():
    rng, rows = random.Random(4), []
    for k in ("a", "b", None, "hot"):
        at = 1_700_000_000.0
        for _ in range(400 if k == "hot" else 60):
            at += rng.choice([0, 0, 1, 5, 200])
            rows.append((k, at, len(rows), rng.choice([0.0, 1.0, 2.5, 30.0, None])))
    return [*rows, ("a", None, 10**6, 1.0)]


def test_budgets_debt_and_refill(spark, many_parts):
    rows = visits()
    out = ranks.budgets(spark.createDataFrame(rows, "k string, at double, i long, cost double").repartition(5), "k", "at", "cost", "i", 10.0, 0.25).collect()
    want = spent(rows, 10.0, 0.25)
    assert {r.i: r.tokens for r in out} == pytest.approx(want, abs=1e-5) and min(want.values()) < 0 < max(want.values())
    one = ranks.budgets(spark.createDataFrame([("a", 0.0, 0, 30.0), ("a", 40.0, 1, 0.0), ("a", 80.0, 2, 0.0), ("a", 99.0, 3, 0.0)], "k string, at double, i long, cost double"), "k", "at", "cost", "i", 10.0, 0.25)
    assert [(r.tokens, r.wait) for r in one.withColumn("wait", ranks.seconds_until(F.col("tokens"), 10.0, 0.25)).orderBy("i").collect()] == [(-20.0, 120.0), (-10.0, 80.0), (0.0, 40.0), (4.75, 21.0)]


def test_budget_stream_has_the_rows_of_the_batch(spark):
    rows = sorted((r for r in visits() if r[1] is not None), key=lambda r: r[1])
    folder, third = new_path(spark, "visits"), len(rows) // 3
    for n in range(3):  # files in the order of time
        part = spark.createDataFrame(rows[n * third : (n + 1) * third if n < 2 else None], "k string, at double, i long, cost double")
        part.withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    live = stream.budget_stream(stream.read_stream(spark, folder, schema, 1), "k", "at", "cost", "i", 10.0, 0.25)
    out = stream.drain(live, new_path(spark, "tokens"), new_path(spark, "checkpoint")).collect()
    assert {r.i: r.tokens for r in out} == pytest.approx(spent(rows, 10.0, 0.25), abs=1e-5) and len(out) == len(rows)


# ---- steps


def graph(spark, names, edges):
    return spark.createDataFrame([(n,) for n in names], "step string"), spark.createDataFrame(edges, "step string, needs string")


def test_steps(spark):
    s, e = graph(spark, ["cut", "dig", "eat", "fry", "go"], [("fry", "cut"), ("cut", "dig"), ("eat", "fry"), ("eat", "dig"), ("eat", "fry")])
    assert {r.step: r.layer for r in steps.layers(s, e).collect()} == {"dig": 0, "go": 0, "cut": 1, "fry": 2, "eat": 3}
    assert {r.step: r["rounds"] for r in steps.requirements(s, e, s.where("step in ('fry', 'go')")).collect()} == {"fry": 0, "go": 0, "cut": 1, "dig": 2}
    assert {r.step: r["rounds"] for r in steps.descendants(s, e, s.where("step = 'dig'")).collect()} == {"cut": 1, "eat": 1, "fry": 2}
    assert steps.descendants(s, e, s.where("step = 'go'")).collect() == []
    assert {r.layer for r in steps.layers(s, e.limit(0)).collect()} == {0} and steps.layers(s.limit(0), e.limit(0)).collect() == []


def test_malformed_steps_are_refused_by_name(spark):
    circle = graph(spark, ["a", "b", "c", "d", "e"], [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("a", "e")])
    with pytest.raises(steps.MalformedSteps, match="circle: a, b, c, d$"):
        steps.layers(*circle)
    with pytest.raises(steps.MalformedSteps, match="unknown steps: x, y"):
        steps.layers(*graph(spark, ["a"], [("a", "x"), ("a", "y")]))
    with pytest.raises(steps.MalformedSteps, match="more than once: a"):
        steps.layers(*graph(spark, ["a", "a", "b"], [("a", "b")]))
    s, e = graph(spark, ["a", "b"], [("a", "b")])
    with pytest.raises(steps.MalformedSteps, match="unknown targets: z"):
        steps.requirements(s, e, s.select(F.lit("z").alias("step")))
    with pytest.raises(steps.MalformedSteps, match="circle: a$"):
        steps.layers(*graph(spark, ["a"], [("a", "a")]))


# ---- builds in parts


def test_build_goes_on_and_starts_afresh(spark):
    path, written = new_path(spark, "build"), []

    def part(n, stop=None):
        if n == stop:
            raise InterruptedError
        written.append(n)
        return spark.range(n * 10, n * 10 + 10)

    with pytest.raises(InterruptedError):
        resumable.build(spark, path, "one", 4, lambda n: part(n, 2))
    assert {(r.part, r.run) for r in resumable.manifest(spark, path).collect()} == {(0, 1), (1, 1)}
    assert resumable.build(spark, path, "one", 4, part).count() == 40 and written == [0, 1, 2, 3]
    assert resumable.build(spark, path, "one", 4, part).count() == 40 and written == [0, 1, 2, 3]
    assert {(r.part, r.rows, r.run) for r in resumable.manifest(spark, path).collect()} == {(0, 10, 1), (1, 10, 1), (2, 10, 2), (3, 10, 2)}
    assert resumable.build(spark, path, "two", 2, part).count() == 20 and written == [0, 1, 2, 3, 0, 1]
    assert {(r.identity, r.run) for r in resumable.manifest(spark, path).collect()} == {("two", 1)}


# ---- levels


def test_gain_scores(spark):
    quiet = [0.001 * ((-1) ** i) * (i % 7) for i in range(300)]
    waves = {1: quiet, 2: [x / 2 for x in quiet], 3: [x * 20 for x in quiet], 4: quiet[:280], 5: quiet[:200], 6: [0.0] * 300, 7: [-x for x in quiet], 8: [x + 0.01 * (i % 2) for i, x in enumerate(quiet)]}
    rows = spark.createDataFrame([(k, i, x) for k, w in waves.items() for i, x in enumerate(w)], "id long, i long, x double")
    sizes = rows.groupBy("id").agg(F.count("*").alias("n")).withColumn("depth", F.when(F.col("id") == 8, 8).otherwise(16))
    pairs = spark.createDataFrame([(1, b) for b in range(2, 9)] + [(6, 1)], "a long, b long")
    out = {(r.a, r.b): (r.gain, r.confidence) for r in variants.gain_scores(pairs, rows, sizes).collect()}
    assert set(out) == {(1, 2), (1, 4), (1, 7), (1, 8)}  # beyond ten times, 100 frames shorter and silence: none
    assert out[1, 2] == pytest.approx((0.5, 1.0)) and out[1, 4] == pytest.approx((1.0, 1.0)) and out[1, 7] == pytest.approx((-1.0, 1.0))
    assert 0.5 < out[1, 8][1] < 0.9


def test_frames_without_a_window_over_a_key(spark, many_parts):
    rows = spark.createDataFrame([("a", i, None if i == 3 else i / 10) for i in range(40)] + [("b", 1, 0.001)], "k string, o int, v double")
    out = variants.frames(rows, "k", "o", "v")
    assert sorted((r.k, r.i, r.x) for r in out.collect()) == [("a", n, o / 10) for n, o in enumerate(o for o in range(40) if o != 3)] + [("b", 0, 0.001)]
    assert {r.k: r.frames for r in variants.trimmed_lengths(out, "k").collect()} == {"a": 39, "b": 0}
    sizes = [r["n"] for r in variants.thumbnails(out.where("k = 'a'").withColumn("x", F.col("i").cast("double")), "k", 32).select((F.col("highest") - F.col("lowest") + 1).alias("n")).collect()]
    assert sorted(sizes) == [1.0] * 25 + [2.0] * 7
