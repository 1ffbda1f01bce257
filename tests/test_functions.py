import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.functions import hashing, labels, pitch, signal, vectors
from tonelake.operators import variants


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "label, paths",
    [
        ("river", [["RIVER"]]),
        ("Tree: Oak: Old, moss", [["TREE", "OAK", "OLD"], ["MOSS"]]),
        ("\tstone , :sand: ,, stone", [["STONE"], ["SAND"]]),
        ("fern:: leaf, Fern: Leaf, fern", [["FERN", "LEAF"], ["FERN"]]),
        (" : , ,", []),
        (None, []),
    ],
)
def test_written_paths(spark, label, paths):
    assert one(spark, labels.written_paths(F.lit(label).cast("string"))) == paths


@pytest.mark.parametrize(
    "a, b, want",
    [("river", "RIVER", 1), ("tree: oak: old", "tree: oak: young", 1 / 2), ("tree, moss", "tree: oak", 1 / 3), ("stone: flat, fern", "fern, stone: flat", 1), ("stone", "sand", 0), ("", "sand", 0), ("", "", 0)],
)
def test_agreement(spark, a, b, want):
    got = one(spark, labels.agreement(labels.written_paths(F.lit(a)), labels.written_paths(F.lit(b))))
    assert got == pytest.approx(want)


def test_label_forms(spark):
    paths = labels.written_paths(F.lit("hi-hat: closed, lo-fi"))
    assert one(spark, labels.canonical_label(F.lit(" hi-hat:closed,lo-fi, LO-FI"))) == "HI-HAT: CLOSED, LO-FI"
    assert one(spark, labels.canonical_label(F.lit(" , :"))) is None
    with pytest.raises(Exception, match="no tag"):
        one(spark, labels.canonical_label(F.lit(","), strict=True))
    assert one(spark, labels.closure(paths)) == [["HI-HAT"], ["HI-HAT", "CLOSED"], ["LO-FI"]]
    assert one(spark, labels.top_level(paths)) == ["HI-HAT", "LO-FI"]
    assert one(spark, labels.truncated(paths, 1)) == [["HI-HAT"], ["LO-FI"]]
    assert one(spark, labels.asserts(paths, F.array(F.lit("HI-HAT")))) is True
    assert one(spark, labels.with_tag(paths, F.array(F.lit("HI-HAT"), F.lit("OPEN")))) == [["HI-HAT", "CLOSED"], ["LO-FI"], ["HI-HAT", "OPEN"]]
    assert one(spark, labels.with_tag(labels.written_paths(F.lit("HI-HAT")), F.array(F.lit("HI-HAT"), F.lit("OPEN")))) == [["HI-HAT", "OPEN"]]
    assert one(spark, labels.prompt(F.array(F.lit("HI-HAT"), F.lit("CLOSED")), "the sound of {}")) == "the sound of closed hi-hat"


def test_names_and_paths(spark):
    assert one(spark, labels.sanitize_name(F.lit("\t Kick  Drum #1 (Läut)! "))) == "kick drum 1 lut"
    assert one(spark, labels.stem(F.lit("a/b/kick.v2.wav"))) == "kick.v2"
    assert one(spark, labels.stem(F.lit("a/.hidden"))) == ".hidden"
    for url, ok in (("https://a.b/c", True), ("ftp://a.b", False), ("http://", False), ("http://a b", False), (None, False)):
        assert one(spark, labels.page_url(F.lit(url).cast("string"))) is ok
    for text, pattern, ok in (("Loops/Kick.WAV", "loops/*.wav", True), ("a.b", "a?b", True), ("axb", "a.b", False), ("x1", "x[0-9]", True), ("xa", "x[!0-9]", True)):
        assert one(spark, labels.glob(F.lit(text), pattern)) is ok
    for path, ok in (("a/b.wav", True), ("/a", False), ("a/../b", False), ("a//b", False), ("./a", False)):
        assert one(spark, labels.inside_root(F.lit(path))) is ok


def test_pitch(spark):
    assert one(spark, pitch.effective_rate(F.lit(8363.0), F.lit(60))) == 8363
    assert one(spark, pitch.effective_rate(F.lit(8363.0), F.lit(72))) == 16726
    assert one(spark, pitch.effective_rate(F.lit(2.5), F.lit(60))) == 2 and one(spark, pitch.effective_rate(F.lit(3.5), F.lit(60))) == 4
    assert one(spark, pitch.effective_rate(F.lit(0.4), F.lit(60))) is None
    assert one(spark, pitch.semitones(F.lit(880.0))) == 12
    assert one(spark, pitch.erb_frequency(pitch.erb_number(F.lit(1000.0)))) == pytest.approx(1000)
    assert one(spark, pitch.geometric_mix(F.lit(1.0), F.lit(100.0), F.lit(0.5))) == pytest.approx(10)


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.euclidean(a, b)) == 5 and one(spark, vectors.cosine(a, b)) is None
    assert one(spark, vectors.unit(a)) == [0.6, 0.8] and one(spark, vectors.unit(b)) == [0, 0]
    assert one(spark, vectors.pooled(F.array(*[F.lit(float(i)) for i in range(5)]), 2)) == [1.0, 3.0]
    with pytest.raises(Exception, match="length"):
        one(spark, vectors.euclidean(a, F.array(F.lit(1.0))))


def test_hashes(spark):
    payload = b"\x01\x02"
    got = one(spark, hashing.content_hash(F.lit(16), F.lit(1), F.lit(1), F.lit(payload)))
    assert got == hashlib.sha256(b"sample:16:1:1\0" + payload).hexdigest()
    got = one(spark, hashing.class_hash(F.array(F.lit("b"), F.lit("a"), F.lit("b"))))
    assert got == hashlib.sha256(b"equivalence-class\0a\0b").hexdigest()
    key = int.from_bytes(hashlib.sha256(b"lock").digest()[:8], "big", signed=True)
    assert one(spark, hashing.advisory_key(F.lit("lock"))) == key


def test_digests_and_revisions(spark):
    rows = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "k int, v string")
    line = hashing.row_line(F.col("k"), F.col("v"))
    want = hashlib.sha256(b'["1","a"]\n["2","b"]\n["3",null]\n').hexdigest()
    assert hashing.ordered_digest(rows, "k", line, parts=1).first().digest == want
    a = hashing.ordered_digest(rows, "k", line).first().digest
    assert hashing.ordered_digest(rows.orderBy("k").repartition(3), "k", line).first().digest == a
    one_, two = hashing.revision(rows, "k", "v").first(), hashing.revision(rows.where("k < 3"), "k", "v").first()
    assert one_ == hashing.revision(rows.repartition(4), "k", "v").first() and one_ != two


def tone(n, depth=16, gain=1.0, rate=44100):
    x = np.arange(n) / rate
    return signal.quantised(gain * (0.5 * np.sin(440 * np.pi * x) + 0.3 * np.sin(880 * np.pi * x) + 0.2 * np.sin(1760 * np.pi * x)), depth)


def test_planted_pairs_are_found(spark):
    rng = np.random.default_rng(3)
    waves = [(1, tone(2500), 16), (2, tone(2500, 8), 8), (3, rng.uniform(-1, 1, 2500), 8), (7, tone(1600), 16), (8, tone(1600, 8, 0.25), 8)]
    rows = spark.createDataFrame([(i, n, float(x)) for i, w, _ in waves for n, x in enumerate(w)], "id int, i int, x double")
    sizes = spark.createDataFrame([(i, len(w), d) for i, w, d in waves], "id int, n int, depth int")
    pairs = spark.createDataFrame([(i, j) for i, v, _ in waves for j, w, _ in waves if i < j and len(v) == len(w)], "a int, b int")
    kind = signal.relation(F.col("gain"), F.col("confidence"), F.col("a") != F.col("b"))
    got = {(r.a, r.b): r.kind for r in variants.gain_scores(pairs, rows, sizes).select("a", "b", kind.alias("kind")).where("kind is not null").collect()}
    assert got == {(1, 2): "bit_depth_variant", (7, 8): "amplification_variant"}


def test_resampled_pair_and_fingerprints():
    x, y = tone(4410), signal.resampled(tone(4410), 2205)
    assert signal.lagged_score(x, y)[0] > 0.99
    rng = np.random.default_rng(0)
    assert abs(signal.lagged_score(x, rng.uniform(-1, 1, 2205))[0]) < 0.3
    assert signal.shape_fingerprint(x) @ signal.shape_fingerprint(0.2 * x) == pytest.approx(1)
    assert signal.rate_fingerprint(x) @ signal.rate_fingerprint(y) > 0.95
    assert np.linalg.norm(signal.shape_fingerprint(np.zeros(0))) == 0


def test_waveform_parts():
    assert signal.trimmed_length(np.array([0.5, 0, 0.1, 0.001, 0])) == 3 and signal.trimmed_length(np.zeros(4)) == 0
    assert signal.trimmed_length(np.array([0.5, 0, 0, 0.2, 0, 0]), 2) == 2
    lo, hi = signal.buckets(np.arange(10), 4)
    assert lo.tolist() == [0, 3, 6, 8] and hi.tolist() == [2, 5, 7, 9]
    assert signal.folded(np.array([1.0, 0.0, 3.0, 2.0]), 2).tolist() == [-1.0, 1.0]
    assert signal.resampled(np.array([0.0, 1.0]), 3).tolist() == [0, 0.5, 1]
    assert len(signal.retuned(np.ones(100), 12)) == 50
    assert np.frombuffer(signal.float_bytes([1.5, -2]), "<f4").tolist() == [1.5, -2.0]
    t = np.arange(8000) / 8000
    slow = np.sin(2 * np.pi * 2 * t) + np.sin(2 * np.pi * 200 * t)
    kept = signal.highpassed(slow, 8000)
    assert np.corrcoef(kept, np.sin(2 * np.pi * 200 * t))[0, 1] > 0.99
    hertz, trust = signal.pitch(np.sin(2 * np.pi * 220 * t) + 0.5 * np.sin(2 * np.pi * 440 * t), 8000)
    assert abs(12 * math.log2(hertz / 220)) < 0.5 and trust > 0.4
    rng = np.random.default_rng(1)
    assert signal.sound_type(np.sin(2 * np.pi * 220 * t), 8000) == "tonal"
    assert signal.sound_type(rng.normal(0, 0.3, 8000), 8000) == "noise"
    assert signal.sound_type(rng.normal(0, 0.3, 8000) * np.exp(-t * 40), 8000) == "percussive"
    still, wobble = signal.modulation(np.sin(2 * np.pi * 500 * t), 8000), signal.modulation(np.sin(2 * np.pi * 500 * t) * (1 + np.sin(2 * np.pi * 5 * t)), 8000)
    assert wobble[0] > still[0]
    grid = signal.log_grid(np.sin(2 * np.pi * 440 * t), 8000)
    assert abs(int(grid.mean(axis=1).argmax()) - round(12 * math.log2(440 / 32.7))) <= 1 and grid.max() == 0
    assert signal.shifted_bands(grid, 2)[2:].tolist() == grid[:-2].tolist()
