import re

import numpy as np
import xxhash

from tonelake.llm import simhash


def brute_print(text, n=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, n=3, k=2):
    fp = [brute_print(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= k:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fp[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_edge_rows(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (1, "One two"), (2, "one TWO"), (4, "É é\x0bx y z w"), (None, "lonely text here now"), (7, "a b c d e f g " * 3000), (7, "a b c d e f g " * 3000)]
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, fp long, cell string")
    got = rows_of(simhash.near_duplicates(df, shingle=3))
    assert got == brute(rows)
    assert simhash.near_duplicates(df.limit(0), shingle=3).count() == 0


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(simhash.near_duplicates(docs, shingle=3)) == brute(rows)


def test_links_join_exactly_the_near_ones(spark):
    rng = np.random.default_rng(0)
    fps = set()
    for base in rng.integers(-(2**63), 2**63 - 1, 8):
        for _ in range(40):
            x = int(base)
            for b in rng.integers(0, 63, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = brute_classes(fps)
    for cell_rows in (512, 3):
        got = {}
        pairs = simhash.links(df, 2, cell_rows).collect()
        assert all(bin((r.src ^ r.dst) & (2**64 - 1)).count("1") <= 2 for r in pairs)
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in pairs:
            root[find(r.src)] = find(r.dst)
        got = {frozenset(y for y in fps if find(y) == find(x)) for x in fps}
        assert got == want


def brute_classes(fps):
    left, out = set(fps), set()
    while left:
        group, front = set(), [left.pop()]
        while front:
            x = front.pop()
            group.add(x)
            near = {y for y in left if bin((x ^ y) & (2**64 - 1)).count("1") <= 2}
            left -= near
            front += near
        out.add(frozenset(group))
    return out
