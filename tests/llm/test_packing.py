import base64
import random

import numpy as np
import tiktoken

from tonelake.llm import packing

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute_fit(sizes, length):
    rows = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(length - sum(sizes[j] for j in r), -k) for k, r in enumerate(rows) if sum(sizes[j] for j in r) + sizes[i] <= length]
        if fits:
            rows[-min(fits)[1]].append(i)
        else:
            rows.append([i])
    return rows


def test_best_fit_is_best_fit():
    rng = random.Random(4)
    for length in (1, 7, 64, 100):
        for _ in range(20):
            sizes = [rng.randrange(1, length + 1) for _ in range(rng.randrange(0, 60))]
            got = packing.best_fit(sizes, length)
            want = brute_fit(sizes, length)
            assert sorted(i for r in got for i in r) == list(range(len(sizes)))
            assert all(sum(sizes[i] for i in r) <= length for r in got)
            # rows of equal room are interchangeable: the filling is what best fit fixes
            assert sorted(sum(sizes[i] for i in r) for r in got) == sorted(sum(sizes[i] for i in r) for r in want)


def unpacked(rows, length):
    parts = {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), np.uint16)
        assert len(ids) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= length
        assert (ids[r.n_tokens :] == packing.END).all() and r.resets == r.cu_seqlens[:-1]
        where = packing.position_ids(r.cu_seqlens, length)
        for s, a, b in zip(r.segments, r.cu_seqlens, r.cu_seqlens[1:]):
            assert s["size"] == b - a and where[a] == 0 and where[b - 1] == b - a - 1
            parts.setdefault(s["doc_id"], []).append((s["part"], ids[a:b].tolist()))
    return {d: sum((p for _, p in sorted(ps, key=lambda x: x[0])), []) for d, ps in parts.items()}


def test_lossless(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    e = library()
    want = {r.doc_id: e.encode_ordinary(r.text) + [packing.END] for r in docs.collect()}
    for length, group in ((256, 20_000), (2048, 2_000_000)):
        rows = packing.pack(docs, RANKS, length=length, group_tokens=group).collect()
        assert unpacked(rows, length) == want
        assert len({(r.task, r.row) for r in rows}) == len(rows)
    assert sum(r.n_tokens for r in rows) > 0.95 * 2048 * (len(rows) - 4)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> é\n\n  x"), (4, "many words " * 40_000), (None, "no id"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame([(d, t, [1], 2) for d, t in rows], "doc_id long, text string, ids array<int>, row int")
    got = packing.pack(docs, RANKS, length=512).collect()
    e = library()
    want = {d: e.encode_ordinary(t or "") + [packing.END] for d, t in rows}
    flat = unpacked(got, 512)
    assert {d: flat[d] for d in (1, 2, 3, 4, None)} == {d: want[d] for d in (1, 2, 3, 4, None)}
    assert flat[5] == want[5] * 2
    assert packing.pack(docs.limit(0), RANKS).count() == 0


def test_ids_beyond_two_bytes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    rows = packing.pack(docs, RANKS, length=16, end_id=70_000, pad_id=1 << 20).collect()
    ids = [np.frombuffer(bytes(r.ids), np.uint32) for r in rows]
    assert all(len(i) == 16 and i[r.n_tokens - 1] == 70_000 and (i[r.n_tokens :] == 1 << 20).all() for i, r in zip(ids, rows))
