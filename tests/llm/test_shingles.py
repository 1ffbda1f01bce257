import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_simhash import brute_print
from tonelake.llm import shingles, simhash
from tonelake.llm.common import keyed


def brute_set(text, n=5):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(rows, similarity=0.8):
    """The ids that stay (ids are different), and the pairs of different sets that are similar."""
    sets = [brute_set(t) for _, t in rows]
    root, pairs, holders = list(range(len(rows))), set(), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for g in s or [None]:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s or [None] for j in holders[g] if j < i}:
            if s == sets[j] or len(s & sets[j]) / len(s | sets[j]) >= similarity:
                root[find(i)] = find(j)
                pairs |= {(i, j)} if s != sets[j] else set()
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values()), pairs


def kept(df):
    return sorted(r.doc_id for r in df.collect())


def test_edited_copies_go(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = []
    for base in range(12):
        words = [word() for _ in range(rng.choice([9, 60, 200]))]
        for edits in (0, 0, 1, 2, 4, 7):
            copy = list(words)
            for at in rng.sample(range(len(copy)), min(edits, len(copy))):
                copy[at] = word()
            rows.append((len(rows), " ".join(copy)))
    # A chain: neighbours are similar, the ends are not. A similarity of 0.8 as such: 16 of 20 shingles.
    words = [word() for _ in range(40)]
    rows += [(len(rows) + i, " ".join(words[2 * i : 2 * i + 30])) for i in range(5)]
    words = [word() for _ in range(22)]
    rows += [(900, " ".join(words)), (901, " ".join([*words, word(), word()])), (902, " ".join(words[:20]))]
    rows += [(1000, None), (1001, ""), (1002, "One two"), (1003, "one  TWO"), (1004, "one two three")]
    want, pairs = brute(rows)
    assert len(pairs) > 20 and len(want) < len(rows) - 30
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, sid string")
    assert kept(shingles.one_of_each(docs)) == want
    assert shingles.one_of_each(docs).columns == docs.columns
    assert shingles.one_of_each(docs.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = "some words that stand here to make more shingles than one"
    rows = [(None, text), (5, text), (5, text), (None, "alone " * 9), (None, "alone " * 9), (7, "none of it"), (7, "none of it"), (7, "none of it"), (7, "another text")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int")
    got = sorted(((r.doc_id, r.text) for r in shingles.one_of_each(docs).collect()), key=str)
    assert got == sorted([(5, text), (None, "alone " * 9), (7, "none of it"), (7, "another text")], key=str)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    want, pairs = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert kept(corpus_pipeline.keep_one_of_near_duplicates(spark, docs, f"/root/testdata/{folder}")) == want
    assert folder == "sf0.001" or len(pairs) >= 5


def test_simhash_gives_links_and_the_join_the_others(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = []
    for base in range(6):
        words = [word() for _ in range(1500)]
        for at in (None, 1, 2, 3, 4):  # one word more at the end changes a shingle or so, and seldom over two bits
            rows.append((len(rows), " ".join(words + [word() for _ in range(at or 0)])))
        rows.append((len(rows), " ".join(words[60:])))
    want, pairs = brute(rows)
    assert len(want) == 6
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = shingles.prefixes(keyed(docs, "doc_id", "text").withColumn("text", F.col("text").cast("binary")))
    ids = {r.sid: (r.doc_id, r.fp & (2**64 - 1)) for r in prints.collect()}
    assert all(fp == brute_print(rows[d][1], 5) for d, fp in ids.values())  # these shingles do not repeat
    near = {frozenset((a, b)) for a, x in ids.values() for b, y in ids.values() if a < b and bin(x ^ y).count("1") <= 2}
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    got = shingles._by_simhash(prints.select("sid", "fp")).collect()
    for r in got:
        assert frozenset((ids[r.src][0], ids[r.dst][0])) in near
        root[find(ids[r.src][0])] = find(ids[r.dst][0])
    assert near and all(find(a) == find(b) for a, b in map(tuple, near))
    assert any(find(a) != find(b) for a, b in pairs)  # left to the join
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **b: asked.append(a) or links(*a, **b))
    assert kept(corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "")) == want and asked


def test_what_an_explode_makes_is_not_broadcast(spark, monkeypatch):
    """Spark takes exploded keys to be as small as the sets: at 0.5 GB it broadcast 7.3 million of them."""
    plans, store = {}, shingles.materialize
    monkeypatch.setattr(shingles, "materialize", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and store(df, name))
    docs = spark.createDataFrame([(i, f"some words that stand here {'again and' if i % 2 else 'once more'} to make {i} shingles or so") for i in range(40)], "doc_id long, text string")
    assert kept(shingles.one_of_each(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])[0]
    assert "Generate" in plans["met"] and "Broadcast" not in plans["met"]
    cells = simhash.links(spark.range(40).withColumnRenamed("id", "fp"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in cells and "Broadcast" not in cells
