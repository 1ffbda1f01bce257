import collections
import hashlib
import random

import numpy as np
import pytest

from tonelake.llm import suffixdedup
from tonelake.llm.suffixdedup import dedup_substrings


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, data):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        rest = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def got(df, **kw):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in dedup_substrings(df, **kw).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 0, b"x") for d, t in rows], "doc_id long, text string, h int, kept binary")


def planted(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(rng.randrange(5, 40)) for _ in range(6)]
    rows = []
    for d in range(n):
        t = text(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            a, b = sorted((rng.randrange(len(s) + 1), rng.randrange(len(s) + 1)))
            t = t[: len(t) // 2] + s[a:b] + t[len(t) // 2 :]
        rows.append((d, t))
    return rows + [(900, "ab" * 300), (901, "a" * 500), (902, None), (903, ""), (None, rows[1][1]), (904, rows[2][1] + "x"), (905, "y" + rows[2][1]), (5, rows[5][1])]


@pytest.mark.parametrize("crowd", [4000, 2])
def test_planted(spark, crowd):
    rows = planted(crowd)
    for length, anchor in ((40, 12), (25, 24)):
        assert got(frame(spark, rows), length=length, anchor=anchor, bucket_stretches=crowd) == brute(rows, length)


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs) == brute(rows, 200)
    assert got(docs.limit(0)) == []


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 400, dtype=np.uint8)
    sums = suffixdedup.prefix_sums(data)
    pos = rng.permutation(350)
    group = np.sort(rng.integers(0, 5, 350))
    order = suffixdedup.merge_sort(data, sums, pos, group, 30)
    for g in range(5):
        mine = [data[p : p + 30].tobytes() for p in pos[order][group == g]]
        assert mine == sorted(mine)
        assert sorted(pos[order][group == g]) == sorted(pos[group == g])


def test_collisions_are_verified(monkeypatch):
    monkeypatch.setattr(suffixdedup, "_powers", lambda base, n: np.zeros(n, np.uint64))
    a, b = b"x" * 30, b"y" * 30
    found = suffixdedup.repeated_starts([a, b, a], np.array([3, 3, 3]), np.array([1, 1, 1]), 30)
    assert [f.tolist() for f in found] == [[0], [], [0]]
