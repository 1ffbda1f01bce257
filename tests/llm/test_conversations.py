import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tonelake.llm import conversations as cv
from tonelake.llm import queries

WHITE = " \t\n\x0b\x0c\r"


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        how = zlib.crc32(key.encode()) % 20
        text = "" if how == 1 else "".join(c for c in text if c not in ".!?") if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by a search that always takes the least (cost, letters) first."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, state, made = heapq.heappop(queue)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, made
        if (at, state) in seen:
            continue
        seen.add((at, state))
        for i, role in (("u", "user"), ("a", "assistant")):
            if (state, i) in step:
                heapq.heappush(queue, (cost + 3, audit + "I", at, i, (*made, (role, ""))))
                if at < len(rows) and rows[at][2] != "b":
                    heapq.heappush(queue, (cost + 3 + 3 * (rows[at][2] == "t"), audit + "R", at + 1, i, (*made, (role, rows[at][1]))))
        if at < len(rows):
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, state, made))
            if rows[at][2] != "b" and (state, rows[at][0][:1]) in step:
                heapq.heappush(queue, (cost + 3 * (rows[at][2] == "t"), audit + "K", at + 1, rows[at][0][:1], (*made, rows[at][:2])))


def brute(rows):
    by, out = defaultdict(list), {}
    for r in hurt(rows):
        by[r[0]].append(r)
    for conv in {r[0] for r in rows}:
        own = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = {r[1] for r in own if r[1] is not None}
        gaps, seen, faults, marked = (max(turns) - min(turns) + 1 - len(turns)) if turns else 0, set(), [], []
        for _, _, role, text in own:
            end = text.rstrip(WHITE)[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            marked.append((role, text, {"blank": "b", "duplicate": "b", "truncated": "t", "": " "}[fault]))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, made = cheapest(marked)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha)
    return out


def got(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def repaired(df):
    edits, report = cv.repair(cv.damaged(df))
    return cv.summaries(df, report, cv.digests(edits))


def made_up(seed, convs=40, longest=9):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(convs)]:
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "aide"])
            text = rng.choice(["Yes.", "No!", "so", "", " \t", None, "What?\n", "it is  ", "Yes.", f"{rng.random()}."])
            rows += [(conv, rng.choice([turn, turn, turn * 3, None]), role, text)] * rng.choice([1, 1, 1, 1, 2])
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, op string")


def test_edge_rows_against_the_plain_search(spark):
    rows = made_up(1)
    assert got(repaired(frame(spark, rows))) == brute(rows)
    assert got(repaired(frame(spark, rows).limit(0))) == {}
    gone = next(i for i in range(10_000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    assert got(repaired(frame(spark, [(gone, 1, "user", "Hi.")]))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("bits", [1, 2])
def test_conversations_of_many_segments(spark, monkeypatch, bits):
    monkeypatch.setattr(cv, "BITS", bits)
    rows = made_up(2, 12, 30)
    assert got(repaired(frame(spark, rows))) == brute(rows)


def test_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_conversations(spark, sf_dir)) == brute(rows)


def test_edits_are_the_repaired_rows(spark):
    df = frame(spark, [(1, 1, "user", "Hi."), (1, 2, "user", "There?"), (1, 3, "assistant", "no end"), (1, 3, "assistant", "no end")])
    edits, report = cv.repair(df)
    assert [(r.edit, r.role, r.text) for r in edits.orderBy("pos", "at").collect()] == [("K", "user", "Hi."), ("I", "assistant", ""), ("K", "user", "There?"), ("K", "assistant", "no end"), ("D", "assistant", "no end")]
    assert report.first().asDict() == {"conv_id": 1, "gaps": 0, "blank": 0, "duplicate": 1, "truncated": 1, "illegal": 2, "cost": 10}


def test_bucket_queue_on_a_long_run():
    rows = ["ut", "u ", "ab", "s ", "a "] * 200
    dist = cv.distances(rows, cv.END)
    ops, state = cv.walk(rows, dist, cv.START, True)
    assert len(ops) == len(rows) + 1 and state in (cv.START, cv.ASSISTANT)
    half = cv.distances(rows[500:], cv.END)[0]
    assert cv.distances(rows[:500], tuple(half))[0] == dist[0]
