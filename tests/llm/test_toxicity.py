import zlib

import numpy as np
from pyspark.sql import functions as F

from tonelake.llm import toxicity


def test_features_match_a_plain_loop():
    texts = ["", "Ab cD\neÉ", "x", "idiot idiot 😀"]
    row, bucket = toxicity.features(texts)
    gap = " " * max(toxicity.SIZES)
    whole = "".join(gap + t.lower().replace("\n", " ") + gap for t in texts)
    starts = [sum(len(t) + 2 * len(gap) for t in texts[:i]) for i in range(len(texts) + 1)]
    want = set()
    for n in toxicity.SIZES:
        for k in range(len(whole) - n + 1):
            h = 0
            for c in whole[k : k + n]:
                h = (h * toxicity._FACTOR + ord(c)) % 2**64
            want.add((max(i for i in range(len(texts)) if starts[i] <= k), h * toxicity._MIX % 2**64 >> (64 - toxicity.BUCKET_BITS)))
    assert set(zip(row.tolist(), bucket.tolist())) == want and len(row) == len(want)


def test_long_texts_in_pieces(monkeypatch):
    texts = ["", "word and word " * 30, "É" * 55, "short"]
    whole = [x.tolist() for x in toxicity.features(texts)]
    monkeypatch.setattr(toxicity, "CHUNK_CHARS", 37)
    assert [x.tolist() for x in toxicity.features(texts)] == whole


def test_held_out_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert len(got) > 500
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / max(1, (got.toxic == 1).sum()) > 0.7, "recall"
    assert hit / max(1, (got.predicted == 1).sum()) > 0.95, "precision"


def test_edge_rows(spark):
    long = "mild words here " * 20_000
    rows = [(1, None), (2, ""), (3, "you idiot"), (3, "you idiot"), (None, "fine"), (4, long), (5, long + " idiot")]
    rows += [(100 + i, ("the idiot said " if i % 2 else "the friend said ") + str(i)) for i in range(60)]
    docs = spark.createDataFrame([(d, t, 9.0) for d, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(60)] + [(None, 1), (101, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    by = {r.doc_id: r.score for r in got}
    assert by[3] > 0.5 > by[2] and by[5] > by[4]
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_one_sided_and_empty_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    assert {r.predicted for r in toxicity.toxicity(docs, labels).collect()} == {1}
    assert {r.predicted for r in toxicity.toxicity(docs, labels.withColumn("toxic", F.lit(0))).collect()} == {0}
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}
