import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake import queries_sources
from tonelake.functions import signal
from tonelake.operators import waveforms


def by_key(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.k, {})[r.i] = r.x
    for v in out.values():
        assert sorted(v) == list(range(len(v)))
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


@pytest.fixture(scope="module")
def waves():
    rng = np.random.default_rng(5)
    return {"one": [0.25], "two": [1.0, -1.0], "odd": rng.uniform(-1, 1, 7).tolist(), "long": rng.uniform(-1, 1, 801).tolist(), "flat": [0.5] * 30, "zero": [0.0] * 4}


@pytest.fixture(scope="module")
def rows(spark, waves):
    return spark.createDataFrame([(k, i, x, "z") for k, w in waves.items() for i, x in enumerate(w)], "k string, i long, x double, v string").select("k", "i", "x").repartition(5).cache()


@pytest.mark.parametrize("points", [1, 2, 3, 16, 801, 1000])
def test_points(rows, waves, points):
    got = by_key(waveforms.at_points(rows, "k", points))
    assert set(got) == set(waves)
    for k, w in waves.items():
        assert got[k] == pytest.approx(signal.resampled(w, points).tolist(), abs=1e-9)


@pytest.mark.parametrize("semitones", [12.0, -12.0, 7.0, -0.5, 100.0])
def test_tuned(rows, waves, semitones):
    got = by_key(waveforms.tuned(rows, "k", semitones))
    for k, w in waves.items():
        assert got[k] == pytest.approx(signal.retuned(w, semitones).tolist(), abs=1e-9)


def test_points_by_a_column(rows, waves):
    got = by_key(waveforms.at_points(rows, "k", F.col("_n") * 2))
    assert {k: len(v) for k, v in got.items()} == {k: 2 * len(w) for k, w in waves.items()}


def test_centred_and_in_bits(rows, waves):
    got, coarse = by_key(waveforms.centred(rows, "k")), by_key(waveforms.in_bits(rows, "k", 8))
    for k, w in waves.items():
        assert got[k] == pytest.approx(signal.folded(w).tolist(), abs=1e-12)
        assert coarse[k] == signal.quantised(w, 8).tolist()


def test_fingerprints(spark, rows, waves):
    got = {r.k: (r.shape, r.rate) for r in waveforms.fingerprints(rows, "k").collect()}
    assert set(got) == set(waves)
    for k, w in waves.items():
        assert got[k][0] == pytest.approx(signal.shape_fingerprint(np.array(w)).tolist(), abs=1e-7)
        assert got[k][1] == pytest.approx(signal.rate_fingerprint(np.array(w)).tolist(), abs=1e-7)
    assert set(got["zero"][0]) == {0.0}
    quiet = {r.k: r.shape for r in waveforms.fingerprints(rows.withColumn("x", F.col("x") / 50), "k").collect()}
    assert quiet["long"] == pytest.approx(got["long"][0])
    assert waveforms.fingerprints(rows.limit(0), "k").count() == 0


def test_null_key_and_no_rows(spark, rows):
    nameless = spark.createDataFrame([(None, 0, 1.0), (None, 1, 3.0)], "k string, i long, x double")
    assert by_key(waveforms.at_points(nameless, "k", 3)) == {None: [1.0, 2.0, 3.0]}
    assert by_key(waveforms.centred(nameless, "k")) == {None: [-1.0, 1.0]}
    none = rows.limit(0)
    for out in (waveforms.at_points(none, "k", 3), waveforms.tuned(none, "k", 12.0), waveforms.centred(none, "k"), waveforms.in_bits(none, "k", 8)):
        assert out.columns == ["k", "i", "x"] and out.count() == 0


def test_plans_hold_no_python_and_no_whole_waveform(spark, sf_dir):
    for name in ("wave_without_constant", "wave_at_points", "wave_an_octave_up", "wave_in_eight_bits"):
        plan = getattr(queries_sources, name)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        for word in ("Python", "Arrow", "collect_list", "SinglePartition", "NestedLoop", "Cartesian"):
            assert word not in plan, (name, word)


def test_spectra_of_one_size_are_taken_at_once(monkeypatch):
    import pandas as pd

    rng, calls, rfft = np.random.default_rng(4), [], np.fft.rfft
    sizes = [16] * 50 + [17] * 30 + [40] * 20
    waves = [rng.normal(size=n - i % 3) for i, n in enumerate(sizes)]
    monkeypatch.setattr(np.fft, "rfft", lambda *a, **k: (calls.append(1), rfft(*a, **k))[1])
    got = waveforms._bands(pd.Series(waves), pd.Series(sizes))
    assert len(calls) == 3
    for w, n, v in zip(waves, sizes, got):
        power = np.abs(rfft(w, n)) ** 2
        want = [np.sqrt(power[a:b].sum()) for edges in waveforms._edges(len(power)) for a, b in zip(edges, edges[1:])]
        assert np.allclose(v, want, atol=1e-9)


def test_copies_of_waves_are_scored_once(spark, sf_dir, tmp_path, monkeypatch):
    import duckdb

    from tests.oracle import check
    from tonelake import queries_vectors as qv

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    copies = F.explode(F.array(*[F.struct((F.col("user_id") + F.lit(n) * i).alias("user_id"), (F.col("event_id") + F.lit(10**6) * i).alias("event_id")) for i, n in ((0, 100), (1, 100), (2, 100))]))
    kinds = {c: events.schema[c].dataType for c in ("user_id", "event_id")}
    three = events.withColumn("_c", copies).select(*[F.col(f"_c.{c}").cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in events.columns])
    three.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    asked, scores = [], qv.variants.gain_scores
    monkeypatch.setattr(qv.variants, "gain_scores", lambda pairs, *a: asked.append(pairs.count()) or scores(pairs, *a))
    check(spark, con, str(tmp_path), qv.gain_pairs, qv.LIKE_COPIES)
    waves = events.where("value is not null").select("user_id").distinct().count()
    assert asked[0] < 2 * waves * 6  # a wave and its soft copy, three times each, have 15 pairs
