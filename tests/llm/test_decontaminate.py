import random

import regex

from tonelake.llm.decontaminate import UNITS, UNSPACED, contaminated

ITEM = "A shop in Leeds sells 12 boxes of pears at 3 dollars each and Tom buys 5 of the 12 boxes how much does Tom pay"


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, w string, pos int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return {(r.doc_id, r.item_id): (round(r.coverage, 3), r.n_slots, r.n_changed) for r in contaminated(d, b, **kw).collect()}


def test_copies_and_reparameterised(spark):
    pad = "some other words stand before the question in this text and "
    other = ITEM.replace("Leeds", "York").replace("Tom", "Ann").replace("12", "20").replace("3 dollars", "4 euros").replace("buys 5", "buys 9")
    clash = ITEM.replace("of the 12", "of the 15")
    docs = [(1, pad + ITEM), (2, pad + other + " and more"), (3, clash), (4, ITEM.replace(" ", "\n")), (5, pad * 50), (6, None), (7, ""), (None, ITEM), (8, ITEM), (8, ITEM), (9, "word " * 50_000 + ITEM), (10, ITEM.replace(" ", "*** "))]
    got = found(spark, docs, [(70, ITEM), (71, None), (72, "too little"), (None, "six tokens stand in this item")])
    assert {k for k in got} == {(d, 70) for d in (1, 2, 4, None, 8, 9, 10)}
    assert got[1, 70][0] == 1 and got[1, 70][2] == 0
    assert got[2, 70][2] == got[2, 70][1] > 3
    got = found(spark, [(1, "here six tokens stand in this item now"), (2, "six tokens stand in that item")], [(None, "six tokens stand in this item")])
    assert set(got) == {(1, None)}


def tokens(text):
    """(template, value) of each token; templates have \"#\" for numbers, \"%\" for units and \"@\" for names."""
    scripts = UNSPACED.replace("Is", "")
    t = regex.sub(f"({scripts})", r" \1 ", text)
    raw = [x.group() for x in regex.finditer(r"\S+", t) if regex.search(r"[\p{L}\d]", x.group())]
    t = regex.sub(r"[^\p{L}\d\s.,:;/!?'’#%@-]+", "", t.replace("#", "").replace("%", "").replace("@", ""))
    t = regex.sub(r"\d+(?:[.,:/]\d+)*", "#", t)
    t = regex.sub(rf"#(\s?)(?i:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?!\p{{L}})", r"#\1%", t)
    t = regex.sub(r"(?<=[^.!?\s]\s{1,3})\p{Lu}[\p{L}'’-]*", "@", t)
    t = regex.sub(r"[^\p{L}#%@\s]+", "", t.lower())
    out = [x for x in t.split() if x]
    assert len(out) == len(raw), text
    return list(zip(out, [regex.sub(r"[^\p{L}\d]+", "", x).lower() for x in raw]))


def brute(docs, items, coverage=0.6):
    out = {}
    for d, text in docs:
        have = tokens(text or "")
        for i, item in items:
            alone = tokens(item or "")
            first = tokens("a " + (item or ""))[1:]
            size = min(8, len(alone))
            if not size or (len(alone) < 3 and len(have) != len(alone)):
                continue
            lines = {}
            for b in range(len(alone) - size + 1):
                for variant in [alone, first] if b == 0 and regex.match(r"\s*\p{Lu}", item) else [alone]:
                    window = variant[b : b + size]
                    slot = [bool(regex.search("[#%@]", t)) for t, _ in window]
                    least = max(3, -(-size // 2))
                    anchored = variant is not alone and size - sum(slot) == least - 1  # the first word counts, if it is the same
                    exact = size - sum(slot) < least and not anchored
                    for p in range(len(have) - size + 1):
                        if [t for t, _ in have[p : p + size]] != [t for t, _ in window]:
                            continue
                        if anchored and have[p][1] != window[0][1]:
                            continue
                        skip = variant is not alone and not exact
                        pairs = {(window[k][1], have[p + k][1]) for k in range(size) if slot[k] and not (skip and k == 0)}
                        if not exact or all(x == y for x, y in pairs):
                            at, all_ = lines.setdefault(p - b, (set(), set()))
                            at.add(b)
                            all_ |= pairs
            single = lambda pairs: len({x for x, _ in pairs}) == len(pairs)
            at, pairs = set(), set()
            fine = [(-len(a), s) for s, (a, q) in lines.items() if single(q)]
            for more, new in [lines[s] for _, s in sorted(fine)]:
                if single(pairs | new):
                    at, pairs = at | more, pairs | new
            share = len(at) / (len(alone) - size + 1)
            if share >= coverage:
                out[d, i] = (round(share, 3), len(pairs), sum(x != y for x, y in pairs))
    return out


def test_short_items_and_items_of_slots(spark):
    items = [(1, "Anna Bob Carl Dora Emil Fred went home"), (2, "what is two"), (3, "What is 17 times 23?"), (4, "Solve 3x + 5 = 20 for x"), (5, "Who wrote Hamlet?"), (6, "1 2 3 4 5 6 7 8 9 10"), (7, "Yes"), (8, "一個男人有三隻貓和兩隻狗"), (9, "no way"), (10, "")]
    docs = [(1, "it says so. Anna Bob Carl Dora Emil Fred went home."), (2, "I ask what is two of them"), (3, "tell me What is 17 times 23? now"), (4, "so what is 18 times 99 then"), (5, "first solve 3x + 5 = 20 for x and then"), (6, "Somebody asked: Who wrote Hamlet? Nobody knew."), (7, "count 1 2 3 4 5 6 7 8 9 10 and on"), (8, "count 2 3 4 5 6 7 8 9 10 11 and on"), (9, "yes"), (10, "yes and no"), (11, "他說一個男人有三隻貓和兩隻狗。"), (12, "No way!"), (13, "Carl Dora Anna Emil went home"), (14, "see Anna Bob Carl Dora Emil Fred went home"), (15, "see Anna Bob Carl Dora Emil Hans went home")]
    docs += [(16, "so What is 41 times 12? now"), (17, "so Was is 41 times 12? now"), (18, "so What is 41 times 12 and 13"), (19, "he asked Who wrote Lolita? and left")]
    got = found(spark, docs, items)
    assert got == brute(docs, items)
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 3), (5, 4), (6, 5), (7, 6), (8, 6), (9, 7), (11, 8), (12, 9), (14, 1), (16, 3), (18, 3)}


def test_one_substitution_for_the_whole_item(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    item = " ".join([*words[:6], "10", *words[6:], "and", "10", *words[::-1]])
    half = item.index("and")
    docs = [(1, item[:half].replace("10", "77") + "gap stands here " + item[half:].replace("10", "88")), (2, item[:half].replace("10", "77") + "gap stands here " + item[half:].replace("10", "77"))]
    assert found(spark, docs, [(1, item)], coverage=0.5) == brute(docs, [(1, item)], 0.5)
    assert set(found(spark, docs, [(1, item)])) == {(2, 1)}


def test_against_brute_force_with_and_without_broadcast(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["red", "box", "and", "of", "Tom", "Ann", "7", "12", "3 kg", "Paris", "has", "the", "runs."])
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 7, 9, 14])))) for i in range(12)]
    docs = []
    for d in range(60):
        _, text = rng.choice(items)
        for old in ("Tom", "Ann", "7", "12", "Paris"):
            if rng.random() < 0.4:
                text = text.replace(old, rng.choice(["Bea", "41", "Rome"]), rng.choice([1, -1]))
        docs.append((d, " ".join([*(word() for _ in range(rng.randrange(6))), text, *(word() for _ in range(rng.randrange(6)))])))
    want = brute(docs, items)
    assert len(want) > 30 and any(c for _, _, c in want.values())
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, broadcast_windows=0) == want


def test_shares_and_empty(spark):
    words = [f"w{chr(97 + i)}x" for i in range(26)]
    item = " ".join(words)
    half = " ".join(words[:13]) + " zz " + " ".join(reversed(words[13:]))
    assert found(spark, [(1, half)], [(1, item)]) == {}
    assert set(found(spark, [(1, half)], [(1, item)], coverage=0.25)) == {(1, 1)}
    assert found(spark, [], [(1, item)]) == {} and found(spark, [(1, item)], []) == {}


def test_verbatim_passages_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    squash = lambda t: " ".join(t.split())
    bench = [(r.item_id, squash(r.text)) for r in items.collect()]
    first = {}
    for i, t in bench:
        first.setdefault(" ".join(t.split()[:8]), []).append((i, t))
    want = set()
    for r in docs.collect():
        t = squash(r.text)
        w = t.split()
        for k in range(len(w) - 7):
            for i, b in first.get(" ".join(w[k : k + 8]), []):
                if b in t:
                    want.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}
    assert len(want) > 100 and want <= got
    assert len(got - want) <= 5
