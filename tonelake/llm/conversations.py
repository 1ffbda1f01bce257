"""Repair of the structure of conversations: the cheapest edits that make the roles follow one another.

The initials of a well-formed conversation's roles read ``(s?(ua)+)?``. A conversation is a graph whose nodes are pairs of
rows read and state of that pattern; an edit is an arc with a small whole cost. Distances to the end come from a bucket
queue (Dial): one bucket for each distance, emptied in rising order. The audit is then read off by walking tight arcs
from the start, the smallest letter first.

Rows are dealt by ranges of (conversation, turn, role, text), so a conversation of any length is spread over tasks, and
each row's place in that order is stored with it. Segments of a conversation are cut at fixed places, 2**BITS rows at most.
Nearly all conversations are one segment. For the others each segment is a 4 by 4 matrix of costs between states; the
matrices are multiplied in the (min, +) semiring from the end, which gives the distances behind every segment, and the
segments are walked with those. Only matrices and places meet by conversation, one for each segment; texts do not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import same, small
from tonelake.sources.shared import materialize

#: Rows of a segment are at most 2 to this power.
BITS = 12
KEEP, INSERT, REROLE, DELETE, UNFINISHED = 0, 3, 3, 4, 3
FAR = 1 << 40
#: States: nothing yet, after s, after u, after a. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
END = (0, FAR, FAR, 0)
#: The state that an initial leads to, by state.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"


def arcs(row: str, state: int) -> Iterator[tuple[str, str, int, int]]:
    """``(letter, initial, cost, next state)`` of the edits that use up ``row``, the smallest letter first.

    A row is its initial and its fault: b (blank or duplicate), t (truncated) or a space.
    """
    yield "D", "", DELETE, state
    if row[1] != "b":
        more = UNFINISHED * (row[1] == "t")
        if state in STEPS.get(row[0], {}):
            yield "K", row[0], KEEP + more, STEPS[row[0]][state]
        for initial in ROLES:
            if state in STEPS[initial]:
                yield "R", initial, REROLE + more, STEPS[initial][state]


def distances(rows: list[str], end: tuple[int, ...]) -> list[list[int]]:
    """The least cost from every (rows read, state) to the end, where ``end`` has the costs that are left behind the rows."""
    n = len(rows)
    dist = [[FAR] * 4 for _ in range(n + 1)]
    inserts = [[s for i in ROLES for s, t in STEPS[i].items() if t == state] for state in range(4)]
    kinds = {r: [[(s, c) for s in range(4) for _, _, c, t in arcs(r, s) if t == state] for state in range(4)] for r in set(rows)}
    into = [kinds[r] for r in rows]  # by row and state: the arcs that lead here
    queue: list[list[tuple[int, int]]] = [[]]

    def reach(at: int, state: int, cost: int) -> None:
        if cost < dist[at][state]:
            dist[at][state] = cost
            while len(queue) <= cost:
                queue.append([])
            queue[cost].append((at, state))

    least = min(end)
    for state, cost in enumerate(end):
        if cost < FAR:
            reach(n, state, cost - least)
    cost = 0
    while cost < len(queue):
        for at, state in queue[cost]:  # arcs of no cost add to the bucket that is being emptied
            if dist[at][state] == cost:
                for before in inserts[state]:
                    reach(at, before, cost + INSERT)
                if at:
                    for before, c in into[at - 1][state]:
                        reach(at - 1, before, cost + c)
        queue[cost] = []
        cost += 1
    return [[d + least if d < FAR else FAR for d in row] for row in dist]


def walk(rows: list[str], dist: list[list[int]], state: int, last: bool) -> tuple[list[str], int]:
    """The ASCII-least tight walk: for each row the initials inserted before it (small) and its edit (K, D, or the new initial).

    The end of the last segment may insert, too: its entry comes after those of the rows. Also returns the final state.
    """
    ops, op, at = [], "", 0
    while at < len(rows) or last and dist[at][state]:
        found = None
        for letter, initial, cost, target in arcs(rows[at], state) if at < len(rows) else ():
            if dist[at][state] == cost + dist[at + 1][target]:
                found = letter, initial, target
                break
        if found is None or found[0] > "I":
            for initial, steps in STEPS.items():
                if initial in ROLES and state in steps and dist[at][state] == INSERT + dist[at][steps[state]]:
                    found = "I", initial, steps[state]
        letter, initial, state = found
        if letter == "I":
            op += initial
        else:
            ops.append(op + (initial.upper() if letter == "R" else letter))
            op, at = "", at + 1
    return [*ops, op] if last else ops, state


def _pairs(rows: list[str]) -> int:
    return sum(a[0] + b[0] not in LEGAL for a, b in zip(rows, rows[1:]))


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults put in by a hash of id and turn; null roles and texts become one space.

    Of twenty hash values, 0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 gives it to the user.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(word(id_col), F.lit(":"), word(turn_col)).cast("binary")) % 20
    text = F.when(how == 1, F.lit("")).when(how == 2, F.translate(word(text_col), ".!?", "")).otherwise(word(text_col))
    role = F.when(how == 4, F.lit("user")).otherwise(word(role_col))
    times = F.explode(F.array_repeat(F.lit(0), F.when(how == 3, F.lit(2)).otherwise(F.lit(1))))
    return rows.where(how != 0).select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), times.alias("_")).drop("_")


def placed(rows: DataFrame) -> DataFrame:
    """The rows, stored, with ``pos``: whole numbers in the order of (conv_id, turn, role, text), nulls first.

    Within a conversation and a part of the table numbers follow one another. ``fault`` is b, t or a space by the text
    alone, ``initial`` one of s, u, a or a dash.
    """
    end = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    initial = F.substring("role", 1, 1)
    keys = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    # Ranges go by the beginning of a text, since their bounds come from sampled keys.
    rows = rows.repartitionByRange(*keys[:3], F.substring("text", 1, 64)).sortWithinPartitions(*keys)
    rows = rows.withColumn("pos", F.monotonically_increasing_id())
    fault = F.when(end == "", "b").when(end.isin(".", "!", "?"), " ").otherwise("t")
    return materialize(rows.withColumn("fault", fault).withColumn("initial", F.when(initial.isin("s", "u", "a"), initial).otherwise("-")), "placed")


def _segments(rows: DataFrame) -> DataFrame:
    """``(conv_id, seg, first, rows, ...)``: what the path needs of each segment, stored. ``rows`` are initial and fault."""
    once = rows.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    light = rows.select("conv_id", "pos", "initial", "fault").join(once, "pos", "left")
    again = F.col("new").isNull() & (F.col("fault") != "b")
    code = F.concat("initial", F.when(again, "b").otherwise(F.col("fault")))
    light = light.withColumn("again", again).withColumn("code", code).withColumn("seg", F.shiftright("pos", BITS))
    counts = [F.sum((F.col("fault") == "b").cast("long")).alias("blank"), F.sum(F.col("again").cast("long")).alias("duplicate"), F.sum(((F.col("fault") == "t") & ~F.col("again")).cast("long")).alias("truncated")]
    segs = light.groupBy("conv_id", "seg").agg(F.min("pos").alias("first"), F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("rows"), *counts)
    return materialize(segs.withColumn("rows", F.col("rows.code")), "segments")


def _mapped(df: DataFrame, fields: str, run) -> DataFrame:
    """``run(row)`` gives the rows (lists of values) for each row of ``df``; conv_id and seg come first."""
    kind = df.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, seg long, {fields}"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [(i, values) for i, row in enumerate(part.to_pylist()) for values in run(row)]
                own = part.take(pa.array([i for i, _ in out], pa.int32()))
                columns = [pa.array([v[k] for _, v in out]) for k in range(len(fields.split(", ")))]
                if out:
                    yield pa.RecordBatch.from_arrays([own.column("conv_id"), own.column("seg"), *columns], names=[f.split()[0] for f in schema.split(", ")])

    return df.mapInArrow(each, schema)


def _whole(row: dict) -> list[list]:
    dist = distances(row["rows"], END)
    return [[row["first"], walk(row["rows"], dist, START, True)[0], dist[0][START], _pairs(row["rows"])]]


def _matrix(row: dict) -> list[list]:
    """Costs from each state before the segment to each state behind it, row by row."""
    ends = [distances(row["rows"], tuple(0 if s == end else FAR for s in range(4)))[0] for end in range(4)]
    return [[[ends[end][s] for s in range(4) for end in range(4)], row["rows"][0][0], row["rows"][-1][0], _pairs(row["rows"])]]


def _behind(pdf: pd.DataFrame) -> pd.DataFrame:
    """The costs left behind every segment of one conversation; its last row is the last segment."""
    pdf = pdf.sort_values("seg", ascending=False)
    end, out, after = list(END), [], ""
    for m, first, last, illegal in zip(pdf["matrix"], pdf["opens"], pdf["closes"], pdf["illegal"]):
        out.append((end, not after, illegal + (after != "" and last + after not in LEGAL)))
        end, after = [min(int(m[4 * s + t]) + end[t] for t in range(4)) for s in range(4)], first
    return pdf[["conv_id", "seg"]].assign(end=[e for e, _, _ in out], last=[x for _, x, _ in out], illegal=[n for _, _, n in out], left=end[START])


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which of the walks of every segment belongs to the conversation's: the one that starts where the last one ended."""
    ends = {(s, a): b for s, a, b in zip(pdf["seg"], pdf["entry"], pdf["exit"])}
    state, out = START, []
    for seg in sorted(set(pdf["seg"])):
        out.append((seg, state))
        state = ends[seg, state]
    return pd.DataFrame({"conv_id": [pdf["conv_id"].iloc[0]] * len(out), "seg": [s for s, _ in out], "entry": [e for _, e in out]})


def _long(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, seg, first, ops)`` and ``(conv_id, cost, illegal)`` of conversations of several segments."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    costs = _mapped(parts.select("conv_id", "seg", "rows"), "matrix array<long>, opens string, closes string, illegal long", _matrix)
    behind = materialize(costs.groupBy("conv_id").applyInPandas(_behind, f"conv_id {kind}, seg long, end array<long>, last boolean, illegal long, left long"), "behind")

    def four(row: dict) -> list[list]:
        dist = distances(row["rows"], tuple(row["end"]))
        return [[row["first"], s, *reversed(walk(row["rows"], dist, s, row["last"]))] for s in range(4) if dist[0][s] < FAR]

    both = parts.alias("a").join(behind.alias("b"), same("conv_id", "seg")).select("a.conv_id", "a.seg", "a.first", "a.rows", "b.end", "b.last")
    walks = materialize(_mapped(both, "first long, entry long, exit long, ops array<string>", four), "walks")
    chosen = walks.select("conv_id", "seg", "entry", "exit").groupBy("conv_id").applyInPandas(_entries, f"conv_id {kind}, seg long, entry long")
    ops = walks.alias("a").join(chosen.alias("b"), same("conv_id", "seg", "entry")).select("a.conv_id", "a.seg", "a.first", "a.ops")
    return ops, behind.groupBy("conv_id").agg(F.max("left").alias("cost"), F.sum("illegal").alias("illegal"))


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The cheapest edits of each conversation, one row each, and a report with one row for each conversation.

    Edits: ``(conv_id, pos, at, edit, role, text)``, by (pos, at) in the order of the conversation: D (delete, 4), I
    (insert a row without text, 3), K (keep, 0) or R (other role, 3) with the role and text that the row has afterwards.
    Blank rows and rows whose role and text the conversation had before are always deleted; a truncated row that stays
    costs 3 more. Of the cheapest edits those with the ASCII-least letters are taken.
    Report: ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost)``.

    Rows are taken by turn (nulls first), equal turns by role and then text. Null roles and texts count as one space; a
    null conv_id is a conversation of its own. An empty role has no initial that may stay. Repeated rows are duplicates.
    Texts are shuffled whole, never gathered by conversation; long conversations are cut into segments. An empty table
    gives empty results; other columns are not read.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), word(role_col).alias("role"), word(text_col).alias("text"))
    rows = placed(rows)
    segs = _segments(rows)
    spans = segs.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id")
    several = small(materialize(spans, "several"))
    lone = segs.alias("a").join(several.alias("b"), same("conv_id"), "left_anti")
    one = materialize(_mapped(lone.select("conv_id", "seg", "first", "rows"), "first long, ops array<string>, cost long, illegal long", _whole), "walked")
    ops, costs = _long(segs.alias("a").join(several.alias("b"), same("conv_id"), "left_semi"))
    ops = one.select("conv_id", "seg", "first", "ops").unionByName(ops)
    costs = one.select("conv_id", "cost", "illegal").unionByName(costs)
    return _edits(ops, rows), _report(rows, segs, costs)


def _edits(ops: DataFrame, rows: DataFrame) -> DataFrame:
    steps = ops.select("conv_id", "first", F.posexplode("ops").alias("i", "op")).select("conv_id", (F.col("first") + F.col("i")).alias("pos"), "op")
    told = steps.where("op <> ''").alias("a").join(rows.alias("b"), same("conv_id", "pos"), "left").select("a.*", "b.role", "b.text")
    letters = F.posexplode(F.split("op", "")).alias("at", "letter")
    told = told.select("conv_id", "pos", letters, "role", "text").where("letter <> ''")
    put, new = F.col("letter").isin(*ROLES), F.col("letter").isin(*[r.upper() for r in ROLES])
    edit = F.when(put, "I").when(new, "R").otherwise(F.col("letter"))
    role = F.when(put | new, F.when(F.lower("letter") == "u", ROLES["u"]).otherwise(ROLES["a"])).otherwise(F.col("role"))
    return told.select("conv_id", "pos", "at", edit.alias("edit"), role.alias("role"), F.when(put, "").otherwise(F.col("text")).alias("text"))


def _report(rows: DataFrame, segs: DataFrame, costs: DataFrame) -> DataFrame:
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("_")).groupBy("conv_id")
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    faults = segs.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    out = turns.agg(gaps.alias("gaps"))
    for other in (faults, costs):
        out = out.alias("a").join(other.alias("b"), same("conv_id")).select("a.*", *[f"b.{c}" for c in other.columns if c != "conv_id"])
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def digests(edits: DataFrame) -> DataFrame:
    """``(conv_id, audit, repaired_sha256)``: the letters of the edits, and the hash of the repaired rows as ``role:text`` lines.

    The rows of a conversation stream through one task in their order, since a hash has to read them so; nothing but the
    letters is held.
    """
    kind = edits.schema["conv_id"].dataType.simpleString()
    rows = edits.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "at").select("conv_id", "edit", "role", "text")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, audit, found, empty, schema = [], [], hashlib.sha256(), True, None  # held: the conversation's id, which may be null
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            done = []
            for conv, edit, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if held != [conv]:
                    if held:
                        done.append((held[0], "".join(audit), found.hexdigest()))
                    held, audit, found, empty = [conv], [], hashlib.sha256(), True
                audit.append(edit)
                if edit != "D":
                    found.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
            yield _batch(done, schema)
        if held:
            yield _batch([(held[0], "".join(audit), found.hexdigest())], schema)

    return rows.mapInArrow(fold, f"conv_id {kind}, audit string, repaired_sha256 string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def summaries(conversations: DataFrame, report: DataFrame, told: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Report and digests of every conversation of the table, also of those that have no row left."""
    ids = conversations.select(F.col(id_col).alias("conv_id")).distinct()
    out = ids
    for other in (report, told):
        out = out.alias("a").join(other.alias("b"), same("conv_id"), "left").select("a.*", *[f"b.{c}" for c in other.columns if c != "conv_id"])
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in report.columns[1:]]
    empty: Column = F.sha2(F.lit(""), 256)
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
