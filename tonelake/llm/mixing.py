"""Mixing sources to target weights: which documents, and how often, so that sources get their shares of all words.

Whole copies come first: a source whose target is 2.4 times its size takes every document twice. The rest of its budget
is filled by a threshold on a hash of the document. Words are summed by source and hash bucket; a running sum over the
buckets (PLACES of them at most for a source) shows in which one the budget ends. Only the rows of that bucket are summed
again by the next bits of the hash, until the bucket holds a single hash. Documents below the threshold are in, no row
is sorted.

The document at the threshold does not fit any more. What is left is filled the same way from documents above that are
small enough, and so on: thresholds rise and size limits fall, which takes every document that still fits in the order
of the hashes. At last the smallest document left out is taken if that brings a source nearer to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tonelake.llm.common import same, small
from tonelake.plans.ranks import running_sums
from tonelake.sources.shared import materialize

#: Bits of the hash that a level of the histograms looks at; the hash has BITS of them.
LEVEL, BITS = 15, 60
PLACES = 1 << LEVEL
#: No document is taken more often.
MOST = 3


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "0") -> DataFrame:
    """``(doc_id, source, size, h)``: words of the text, and a hash of id and text from 0 to 2**BITS - 1."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))
    named = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"), F.conv(F.substring(named, 1, BITS // 4), 16, 10).cast("long").alias("h"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``(sid, source, source_size, target)`` from ``(source, source_size)``, stored.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes by weight. A target stops
    at MOST times its source's size, and what is over is shared again by weight until none is above. That is the least of the cap and level * weight,
    with one level for all: in the order of cap / weight it is the first at which the next cap is not below it.
    """
    order = [F.col("source").isNull(), F.col("source")]
    rows = running_sums(sizes.withColumn("one", F.lit(1).cast("long")), order, {"sid": "one"}).drop("one")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    rows = materialize(rows.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST), "sources")
    whole = rows.agg(F.sum("source_size").alias("whole"), F.sum("weight").alias("weights")).first()
    if not whole.whole:
        return rows.select("sid", "source", "source_size", F.lit(0.0).alias("target"))
    share = F.col("cap") / F.col("weight")
    filled = running_sums(rows, [share, F.col("sid")], {"caps": "cap", "used": "weight"})
    level = (F.lit(whole.whole) - F.col("caps") + F.col("cap")).cast("double") / (F.lit(whole.weights) - F.col("used") + F.col("weight")).cast("double")
    found = filled.withColumn("level", level).where(share >= F.col("level")).agg(F.min(F.struct(share.alias("share"), "sid", "level"))).first()[0]
    level = F.lit(found.level if found else float("inf"))
    return rows.select("sid", "source", "source_size", F.least(level * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def _bucket(level: int) -> Column:
    """The bits of the hash that a level looks at."""
    return F.shiftright("h", BITS - LEVEL * (level + 1)).bitwiseAND(F.lit(PLACES - 1)).cast("int")


def _ends(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(sid, cut, left)``: all rows of ``(sid, size, h)`` with h below ``cut`` fit into the source's ``left``, and the next does not.

    ``cut`` is null where all rows fit; what is then left over is in ``left``.
    """
    found, levels = [], BITS // LEVEL
    open_rows = rows
    for level in range(levels):
        sums = open_rows.groupBy("sid", _bucket(level).alias("b")).agg(F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"))
        # At most PLACES rows for each source.
        upto = F.sum("words").over(W.partitionBy("sid").orderBy("b").rowsBetween(W.unboundedPreceding, 0))
        sums = sums.withColumn("upto", upto).join(small(budgets), "sid")
        over = F.min(F.when(F.col("upto") > F.col("left"), F.struct("b", "low", "high", (F.col("left") - F.col("upto") + F.col("words")).alias("rest"))))
        ends = materialize(sums.groupBy("sid").agg(over.alias("end"), (F.max("left") - F.max("upto")).alias("over")), "ends")
        done = F.col("end").isNull() | (F.col("end.low") == F.col("end.high"))
        found.append(ends.where(done).select("sid", F.col("end.low").alias("cut"), F.coalesce("end.rest", "over").alias("left")))
        budgets = ends.where(~done).select("sid", "end.b", F.col("end.rest").alias("left"))
        if level + 1 == levels or budgets.isEmpty():
            break
        a, b = open_rows.withColumn("b", _bucket(level)).alias("a"), small(budgets).alias("b")
        open_rows = materialize(a.join(b, (F.col("a.sid") == F.col("b.sid")) & (F.col("a.b") == F.col("b.b")), "left_semi").select("sid", "size", "h"), "boundary")
        budgets = budgets.drop("b")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "0") -> DataFrame:
    """``(doc_id, size, source, source_size, target, copies, taken)`` for every document; ``taken`` is copies times size.

    Targets are those of :func:`targets`. ``copies`` (0 to MOST) is the same for all documents of a source, or one more
    for those that the hash picks; documents are taken whole. A source's taken words differ from its rounded target by
    less than the smallest document left out, and never more than bringing that document in would. Which documents are picked
    depends on ``seed``, ids and texts alone, not on how rows are dealt, so reruns agree.

    Null texts and texts without words have size 0 and take nothing. A null source is a source of its own, the empty
    one too. Rows equal in id, text and source share a hash and are picked together; the smaller document wins ties, then
    the smaller hash. Sizes are those of whole
    texts, however long. An empty table gives no rows; other columns are not read.
    """
    light = materialize(sized(docs, id_col, text_col, source_col, seed), "sizes")
    shares = materialize(targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "targets")
    names = small(shares)
    rows = light.where("size > 0").alias("a").join(names.alias("b"), same("source")).select("b.sid", "a.size", "a.h")
    budget = F.round("target").cast("long")
    base = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    gaps = shares.select("sid", (budget - base * F.col("source_size")).alias("left")).where("left > 0")
    cuts = rows.select("sid", F.col("size").alias("fits"), F.col("h").alias("below")).limit(0)
    gaps = materialize(gaps.withColumn("from", F.lit(-1).cast("long")), "gaps")
    while not gaps.isEmpty():
        free = rows.alias("a").join(small(gaps).alias("b"), F.col("a.sid") == F.col("b.sid")).where("a.size <= b.left and a.h > b.from").select("a.sid", "a.size", "a.h")
        ends = _ends(free, gaps.select("sid", "left"))
        ends = materialize(ends.alias("a").join(gaps.alias("b"), F.col("a.sid") == F.col("b.sid")).select("a.sid", F.col("b.left").alias("fits"), F.col("a.cut").alias("below"), F.col("a.left").alias("left")), "cuts")
        cuts = cuts.unionByName(ends.select("sid", "fits", "below"))
        gaps = materialize(ends.where("below is not null and left > 0").select("sid", "left", F.col("below").alias("from")), "gaps")
    return _decided(light, shares, rows, cuts, budget, base)


def _decided(light: DataFrame, shares: DataFrame, rows: DataFrame, cuts: DataFrame, budget: Column, base: Column) -> DataFrame:
    """The documents below the thresholds, and the last one of each source."""
    cuts = cuts.groupBy("sid").agg(F.collect_list(F.struct("fits", "below")).alias("cuts"))
    plans = materialize(shares.withColumn("base", base).withColumn("rest", budget - F.col("base") * F.col("source_size")).join(cuts, "sid", "left"), "plans")

    def under(size: str) -> Column:
        return F.coalesce(F.exists("cuts", lambda c: (F.col(size) <= c["fits"]) & (c["below"].isNull() | (F.col("h") < c["below"]))), F.lit(False))

    held = rows.join(small(plans.select("sid", "cuts", "rest")), "sid").withColumn("in", under("size"))
    gaps = held.groupBy("sid").agg((F.max("rest") - F.coalesce(F.sum(F.when(F.col("in"), F.col("size"))), F.lit(0))).alias("gap"))
    gaps = materialize(gaps.where("gap > 0"), "gaps")
    near = held.where(~F.col("in")).join(small(gaps), "sid").where("size < 2 * gap").groupBy("sid", "h").agg(F.sum("size").alias("size"), F.max("gap").alias("gap"))
    last = near.where("size < 2 * gap").groupBy("sid").agg(F.min(F.struct("size", "h")).alias("spare")).select("sid", F.col("spare.h").alias("last"))
    plans = materialize(plans.join(last, "sid", "left"), "decided")
    full = light.alias("a").join(small(plans).alias("b"), same("source")).select("a.*", "b.source_size", "b.target", "b.base", "b.cuts", "b.last")
    more = F.coalesce((F.col("size") > 0) & (under("size") | (F.col("h") == F.col("last"))), F.lit(False))
    full = full.withColumn("copies", F.col("base") + more.cast("long"))
    return full.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
