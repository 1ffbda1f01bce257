"""Line dedup: maximal repeated runs of lines, found by distributed prefix doubling over line-ID sequences.

A document is the sequence of its lines; every line start is a suffix. The rank of a suffix at depth k names the
interval of the suffix array whose members share a prefix of k lines or more: the name is the interval's first position
in (document, line) order, so a rank also tells whether the run of k lines has an earlier copy. (The order *between*
intervals decides nothing here and is not computed.) Doubling is one join and one aggregate: rank 2k at a position is
named by the pair of ranks k at the position and k lines on. Suffixes alone in their interval are settled and dropped.
Any other depth m between k and 2k is an interval, too: its name is the pair of ranks k at the run's first k and its
last k lines.

A line goes if it stands in a run that has an earlier copy and holds ``min_chars`` characters. The maximal repeated
runs are not walked line by line: a maximal run is the union of those of its parts that hold ``min_chars`` characters
and fewer than ``min_chars`` after their first line (take, for a line near the end of the run, the last start from
which the run still has enough characters). Such parts have ``min_chars`` lines at most, since every line counts one
character or more, so six doublings are exact for runs of any length. Only starts with such a part longer than a line
take part beyond depth one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import keyed, same
from tonelake.plans.joins import join_back, shuffled, unless_few
from tonelake.sources.shared import discard, materialize

MIN_CHARS = 50
_AT = ("doc_id", "rid", "line")
_KEEP = [*_AT, "lo", "hi", "deep"]


def _position(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in _AT])


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row per line: its 96-bit hash and the runs from it that are asked for.

    ``lo`` to ``hi``: their numbers of lines (0: none, the document ends too early); ``deep``: the depth up to which
    the position is needed, as a start or inside the run of a line before it; ``inner``: whether any run longer than a
    line holds it.
    """
    at_least, n = F.lit(min_chars), F.size("lines")
    rows = docs.select("doc_id", "rid", F.split("text", "\n").alias("lines"))
    rows = rows.withColumn("chars", F.transform("lines", lambda x: F.length(x) + 1))
    zero = F.lit(0)

    def runs(c: Column, i: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            total, j = s["total"] + x, s["j"] + 1
            lo = F.when((s["lo"] == 0) & (total >= at_least), j).otherwise(s["lo"])
            return F.struct(total.alias("total"), j.alias("j"), lo.alias("lo"), F.when(total - c < at_least, j).otherwise(s["hi"]).alias("hi"))

        start = F.struct(zero.alias("total"), zero.alias("j"), zero.alias("lo"), zero.alias("hi"))
        return F.aggregate(F.slice("chars", i + 1, min_chars + 1), start, step, lambda s: F.struct(s["lo"], F.when(s["lo"] > 0, F.greatest(s["lo"], s["hi"])).otherwise(zero).alias("hi"), F.least(s["hi"] + F.when(c < at_least, 1).otherwise(0), n - i).alias("deep")))

    # A long line before another long line, the usual case, asks for itself alone.
    one = F.struct(F.lit(1).alias("lo"), F.lit(1).alias("hi"), F.lit(1).alias("deep"))
    long_pair = lambda c, i: (c >= at_least) & F.coalesce(F.get("chars", i + 1) >= at_least, F.lit(True))
    rows = rows.select("doc_id", "rid", "lines", F.transform("chars", lambda c, i: F.when(long_pair(c, i), one).otherwise(runs(c, i))).alias("runs"))
    inner = F.transform("runs", lambda r, i: (r["deep"] > 1) | ((i > 0) & F.coalesce(F.get("runs", i - 1)["deep"] > 1, F.lit(False))))
    parts = rows.select("doc_id", "rid", F.posexplode(F.arrays_zip("lines", "runs", inner.alias("inner"))).alias("line", "x"))
    return parts.select(*_AT, F.xxhash64("x.lines").alias("h"), F.hash("x.lines").alias("g"), "x.runs.*", "x.inner")


def _ranked(rows: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """``rows`` of repeated intervals, named by ``by``, with ``first``, the position of the interval's first member."""
    classes = rows.groupBy(*by).agg(F.min(_position()).alias("first"), F.count("*").alias("size")).where("size > 1").drop("size")
    return join_back(rows, classes, by).select(*keep, "first")


def _later() -> Column:
    return ~F.col("first").eqNullSafe(_position())


def repeated_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, rid, line, m)``: runs of ``m`` lines that start at ``line`` and have an earlier copy; their union is that
    of the maximal repeated runs. ``docs``: see keyed()."""
    lines = materialize(_lines(docs, min_chars), "lines")
    ranks = materialize(_ranked(unless_few(lines), ["h", "g"], [*_KEEP, "inner"]), "ranks")
    discard(lines)
    later = [ranks.where((F.col("lo") == 1) & _later()).select(*_AT, F.lit(1).alias("m"))]
    k, old = 1, [ranks]
    # A document listed twice is one document: from here on each position is there once.
    now = ranks.where("inner").drop("inner").dropDuplicates([*_AT])
    while ranks.where(F.col("deep") >= 2 * k).limit(1).count():
        pairs = unless_few(now, ranks.count()).where(F.col("deep") >= 2 * k).alias("a").join(now.alias("b"), same("doc_id", "rid") & (F.col("a.line") + k == F.col("b.line")))
        pairs = pairs.select(*[F.col(f"a.{c}").alias(c) for c in _KEEP], F.col("a.first").alias("head"), F.col("b.first").alias("tail"))
        now = ranks = materialize(_ranked(pairs, ["head", "tail"], _KEEP), "ranks")
        old.append(ranks)
        k *= 2
        asked = (F.col("lo") > 0) & (F.col("lo") < 2 * k) & (F.col("hi") >= k)
        later.append(ranks.where(asked & (F.col("lo") <= k) & _later()).select(*_AT, F.lit(k).alias("m")))
        longer = ranks.where(asked & (F.col("hi") > k)).withColumn("m", F.explode(F.sequence(F.greatest(F.col("lo"), F.lit(k + 1)), F.least(F.col("hi"), F.lit(2 * k - 1)))))
        ends = shuffled(longer).alias("a").join(ranks.alias("b"), same("doc_id", "rid") & (F.col("a.line") + F.col("a.m") - k == F.col("b.line")))
        runs = ends.select(*[F.col(f"a.{c}").alias(c) for c in (*_AT, "m")], F.col("a.first").alias("head"), F.col("b.first").alias("tail"))
        later.append(_ranked(runs, ["m", "head", "tail"], [*_AT, "m"]).where(_later()).drop("first"))
    found = later[0]
    for more in later[1:]:
        found = found.unionByName(more)
    found = materialize(found, "runs")
    for t in old:
        discard(t)
    return found


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, carry: bool = False) -> DataFrame:
    """``(doc_id, n_lines, n_removed, text)``, one row per input row, without the later copies of repeated line runs.

    Lines end at a newline; a run counts from ``min_chars`` characters on, line ends included, and is cut whole, to the
    last line that its earlier copy shares. The first copy in the order of (doc_id, hash of the row, line) stays;
    within a document, too. Null texts count as empty; null ids come first in that order. Rows that repeat both id and
    text are one document and get the same result, so they are no copies of each other. Shorter repeated lines stay.
    Very long texts are split into rows of lines where they are read. An empty table gives an empty result; other
    columns of ``docs`` are not read, unless ``carry`` asks for the whole row as the struct ``row``.
    """
    rows = keyed(docs, id_col, text_col, carry)
    row = ["row"] * carry
    runs = repeated_runs(rows.drop("row"), min_chars)
    gone = runs.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("line", "m")).alias("runs"))
    if carry:  # the row holds the text already
        rows = rows.drop("text")
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit("")) if carry else F.col("text")
    both = rows.alias("a").join(gone.alias("b"), same("doc_id", "rid"), "left").select("a.doc_id", *[f"a.{c}" for c in row or ["text"]], "b.runs")
    out = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["line"], r["line"] + r["m"] - 1))))
    both = both.withColumn("lines", F.split(text, "\n")).withColumn("out", out)
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("out"))
    rest = F.when(F.col("runs").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    return both.select("doc_id", F.size("lines").alias("n_lines"), F.coalesce(F.size("out"), F.lit(0)).alias("n_removed"), rest.alias("text"), *row)
