import random

from pyspark.sql import functions as F

from tonelake.llm.linededup import dedup_lines


def brute(rows, rids, min_chars):
    """rows: (doc_id, text). Every run of lines with enough characters, of any length, that has an earlier copy goes."""
    docs = sorted({(-1 if d is None else 0, d or 0, rids[d, t or ""], t or "") for d, t in rows})
    seen, gone = set(), {}
    for _, d, rid, t in docs:
        lines = t.split("\n")
        for p in range(len(lines)):
            for m in range(1, len(lines) - p + 1):
                run = tuple(lines[p : p + m])
                if sum(map(len, run)) + m < min_chars:
                    continue
                if run in seen:
                    gone.setdefault((d, rid), set()).update(range(p, p + m))
                seen.add(run)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        cut = gone.get((d or 0, rids[d, t or ""]), set())
        out.append((d, len(lines), len(cut), "\n".join(x for i, x in enumerate(lines) if i not in cut)))
    return sorted(out, key=str)


def check(spark, rows, min_chars):
    df = spark.createDataFrame([(d, t, 1, "y") for d, t in rows], "doc_id long, text string, line int, m string")
    rids = {(r.doc_id, r.t): r.h for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("h")).collect()}
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in dedup_lines(df, min_chars=min_chars).collect()), key=str)
    assert got == brute(rows, rids, min_chars)


def test_small_cases(spark):
    a = "a line that is long enough to count all on its own, surely"
    rows = [(1, f"{a}\nx"), (2, f"y\n{a}"), (2, f"y\n{a}"), (3, None), (4, ""), (None, a), (5, f"{a}\n{a}"), (6, "short\nshort"), (7, "\n" * 80), (8, "\n" * 80), (9, "w\n" * 90), (10, "v" + "w\n" * 90)]
    check(spark, rows, 50)


def test_a_later_copy_goes_to_its_last_line(spark):
    a, b, c = ("abc " * 25).strip(), ("def " * 25).strip(), "Short end."
    rows = [(1, f"{a}\n{b}\n{c}"), (2, f"{a}\n{b}\n{c}"), (3, f"x\n{b}\n{c}\ny"), (4, f"{c}\n{a}"), (5, f"{c}"), (6, f"{a}\n{c}"), (7, f"i\nj\n{a}"), (8, f"k\nj\n{a}\n{c}")]
    rows += [(9, f"{a}\n{b}\n{c}")] * 6
    check(spark, rows, 50)


def test_runs_of_short_lines(spark):
    rng = random.Random(1)
    rows = []
    for d in range(40):
        lines = [rng.choice(["", "ab", "abc def", "ghi jkl mno", "p"]) for _ in range(rng.randrange(1, 25))]
        rows.append((d, "\n".join(lines)))
    check(spark, rows, 30)
    check(spark, rows, 7)


def test_long_documents(spark):
    """More lines than any run that is asked for, and six rounds."""
    rng = random.Random(3)
    base = [rng.choice(["", "a", "b", "cc"]) for _ in range(150)]
    rows = [(1, "\n".join(base)), (2, "\n".join(base[40:])), (3, "\n".join(["q", *base[5:90], "r", *base[60:]]))]
    check(spark, rows, 50)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()], 50)
    assert dedup_lines(docs.limit(0)).count() == 0
