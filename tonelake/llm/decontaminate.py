"""Benchmark decontamination by template windows, with built-in functions only.

Texts are canonicalised token by token: numbers, units after a number and capitalised words inside a sentence become
typed placeholders, punctuation and case go; characters of scripts without spaces are tokens of their own. Windows of
eight tokens (of the whole item, if it is shorter) are hashed by doubling (pairs of tokens, of pairs, of fours) and
joined with the windows of the benchmark items. A question asked again with other numbers or names has the same
template windows; the values in its slots then have to follow one substitution, slot by slot, for the whole item.
Windows that are mostly slots name nothing by their template: they count only where the document has the same values.
Items whose windows are covered well enough by consistent alignments contaminate the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import BROADCAST_ROWS, keyed, same
from tonelake.plans.joins import shuffled
from tonelake.sources.shared import materialize

WINDOW = 8
#: Items of fewer tokens are found only where they are the whole document.
SHORTEST = 3
#: Benchmark windows up to this many are broadcast (about 300 bytes each, 75 MB); more are joined by a shuffle.
BROADCAST_WINDOWS = 250_000
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz pound pounds gram grams ton tons "
    "ml cl l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years cent cents dollar dollars euro euros usd eur gbp percent degree degrees hz khz mhz kb mb gb tb w kw v kwh mph kmh"
).split()
#: Scripts without spaces between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
NUMBER, UNIT, NAME = "\u0001", "\u0002", "\u0003"


def canonical(text: Column) -> Column:
    """The text with slots replaced by placeholders; white space, and so the tokens' places, stays as it is."""
    t = F.regexp_replace(text, rf"[^\p{{L}}\d\s.,:;/!?'’{NUMBER}{UNIT}{NAME}-]+", "")
    t = F.regexp_replace(t, r"\d+(?:[.,:/]\d+)*", NUMBER)
    t = F.regexp_replace(t, rf"{NUMBER}(\s?)(?i:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?!\p{{L}})", f"{NUMBER}$1{UNIT}")
    t = F.regexp_replace(t, r"\p{Lu}(?<=[^.!?\s]\s{1,3}\p{Lu})[\p{L}'’-]*", NAME)
    return F.regexp_replace(F.lower(t), rf"[^\p{{L}}{NUMBER}{UNIT}{NAME}\s]+", "")


def spaced(text: Column) -> Column:
    """The text with spaces around every character of a script that has none."""
    return F.when(text.rlike(UNSPACED), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(canonical(text), r"\s+"), lambda x: x != "")


def _raw_tokens(text: Column) -> Column:
    """The tokens of the text itself, one for each canonical token."""
    return F.filter(F.split(text, r"\s+"), lambda x: x.rlike(rf"[\p{{L}}\d{NUMBER}{UNIT}{NAME}]"))


def _joined(hashes: Column, step: int) -> Column:
    """Hashes of each element with the one ``step`` on; the last ``step`` of them reach over the end and mean nothing."""
    return F.zip_with(hashes, F.slice(hashes, step + 1, F.greatest(F.size(hashes) - step, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _with_runs(rows: DataFrame) -> DataFrame:
    """``rows`` with the hashes of all runs of one, two and four of the tokens ``t``. Each doubling is a column of its own: it is used three times."""
    rows = rows.withColumn("h", F.transform("t", lambda x: F.xxhash64(x)))
    rows = rows.withColumn("h2", _joined(F.col("h"), 1))
    return rows.withColumn("h4", _joined(F.col("h2"), 2))


def _windows(size: Column, length: int) -> Column:
    """Hashes of all windows of ``length`` (1 to 8) of ``size`` tokens, in order."""
    half = 4 if length > 4 else 2 if length > 2 else 1
    return F.slice(_joined(F.col({1: "h", 2: "h2", 4: "h4"}[half]), length - half), 1, _places(size, length))


def _places(size: Column, length: int) -> Column:
    return F.greatest(size - (length - 1), F.lit(0))


_SLOT = f"[{NUMBER}{UNIT}{NAME}]"


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, irid, length, n_windows, bpos, w, canon, bench, exact, anchored)`` of every window of the items.

    ``canon`` and ``bench``: the tokens as templates and as they stand; ``exact``: too few literals, so that the values
    have to be the same; ``anchored``: enough literals with the first word, which therefore has to be the same.
    """
    rows = keyed(items, id_col, text_col).distinct().withColumn("text", spaced(F.col("text"))).withColumn("raw", _raw_tokens(F.col("text")))
    alone = rows.withColumn("t", _tokens(F.col("text"))).withColumn("inside", F.lit(False))
    # Inside a sentence of a document an item's first word, if it has a capital, reads as a name.
    inside = rows.where(F.col("text").rlike(r"^\s*\p{Lu}")).withColumn("t", _tokens(F.concat(F.lit("a "), F.col("text")))).withColumn("t", F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))))
    rows = alone.unionByName(inside.withColumn("inside", F.lit(True)))
    rows = _with_runs(rows.where(F.size("t") > 0).withColumn("length", F.least(F.size("t"), F.lit(WINDOW))))
    hashes = F.lit(None).cast("array<bigint>")
    for n in range(1, WINDOW + 1):
        hashes = F.when(F.col("length") == n, _windows(F.size("t"), n)).otherwise(hashes)
    at = rows.select("doc_id", "rid", "length", "t", "raw", "inside", F.posexplode(hashes).alias("bpos", "w")).where("bpos = 0 OR NOT inside")
    at = at.select(
        F.col("doc_id").alias("item_id"), F.col("rid").alias("irid"), "length", "bpos", "w",
        F.slice("t", F.col("bpos") + 1, F.col("length")).alias("canon"), F.slice("raw", F.col("bpos") + 1, F.col("length")).alias("bench"), "inside",
    )
    literals = F.size(F.filter("canon", lambda x: ~x.rlike(_SLOT)))
    least = F.greatest(F.lit(3), F.ceil(F.col("length") / 2).cast("int"))
    at = at.withColumn("anchored", F.col("inside") & (literals == least - 1)).withColumn("exact", (literals < least) & ~F.col("anchored"))
    # That word is no slot: it is hashed as a name, but has no value to follow, unless all values have to be the same.
    at = at.withColumn("canon", F.when(F.col("inside") & ~F.col("exact"), F.concat(F.array(F.lit("")), F.slice("canon", 2, WINDOW))).otherwise(F.col("canon"))).drop("inside")
    counts = at.groupBy("item_id", "irid").agg(F.countDistinct("bpos").alias("n_windows"))
    return shuffled(at).alias("a").join(counts.alias("b"), F.col("a.item_id").eqNullSafe(F.col("b.item_id")) & (F.col("a.irid") == F.col("b.irid"))).select("a.*", "n_windows")


def _plain(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, r"[^\p{L}\d]+", ""))


def _consistent(pairs: Column) -> Column:
    """Whether every value of the item stands for one value of the document. ``pairs`` are different from each other."""
    return F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["bench"])))


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = 0.6, id_col: str = "doc_id", text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``(doc_id, rid, item_id, coverage, n_slots, n_changed)``: a row for each document and item found in it.

    ``coverage`` is the share of all the item's windows that one consistent substitution of its values finds in the
    document; ``n_slots`` counts the item's distinct slot values there, ``n_changed`` those with another value in the
    document, 0 for a verbatim copy. Values compare without case. An alignment (all windows at one distance) in which
    a value stands for two values is dropped; of alignments that contradict each other those with more windows, then
    the earlier ones, are taken. Windows of less than half, or of fewer than three, literal tokens count only with the
    item's own values. An item's first word with a capital may be a name or not: inside a sentence it is one of the literals
    where these are one too few without it, and else free. Items of one or two tokens are found where the document holds nothing else; items without any
    token are not searched. Null texts count as empty, null ids are kept, repeated rows are found once, and documents
    without any item give no row. Very long texts are one row of tokens. An empty table on either side gives an empty
    result. Other columns are not read.
    """
    windows = materialize(item_windows(items), "benchmark-windows")
    lengths = {r.length: r.n for r in windows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # eight at most
    if not lengths:
        kind = docs.schema[id_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, rid long, item_id {items.schema['item_id'].dataType.simpleString()}, coverage double, n_slots int, n_changed int")
    few = F.broadcast if sum(lengths.values()) <= broadcast_windows else shuffled
    rows = keyed(docs, id_col, text_col)
    # Only hashes and places are exploded; windows of all lengths stand one after the other.
    hashed = _with_runs(rows.select("doc_id", "rid", _tokens(spaced(F.col("text"))).alias("t"))).withColumn("size", F.size("t"))
    at = hashed.select("doc_id", "rid", "size", F.posexplode(F.concat(*[_windows(F.col("size"), n) for n in sorted(lengths)])).alias("place", "w"))
    at = at.join(few(windows.select("w", "length").distinct()), "w")
    start, pos = F.lit(0), F.lit(None).cast("int")
    for n in sorted(lengths):
        end = start + _places(F.col("size"), n)
        whole = F.lit(True) if n >= SHORTEST else F.col("size") == n
        pos = F.when((F.col("length") == n) & (F.col("place") >= start) & (F.col("place") < end) & whole, F.col("place") - start).otherwise(pos)
        start = end
    at = at.select("doc_id", "rid", F.struct("w", "length", pos.alias("pos")).alias("hit")).where("hit.pos is not null")
    # Few documents have hits: the table is broadcast while they are counted few enough.
    at = materialize(at.groupBy("doc_id", "rid").agg(F.collect_set("hit").alias("hits")), "hits")
    n_hits = at.agg(F.coalesce(F.sum(F.size("hits")), F.lit(0))).first()[0]
    at = F.broadcast(at) if n_hits <= BROADCAST_ROWS else shuffled(at)
    # The values in the slots come from the texts of the documents with hits, split once for each document.
    both = rows.alias("a").join(at.alias("b"), same("doc_id", "rid")).select("a.doc_id", "a.rid", "b.hits", _raw_tokens(spaced(F.col("a.text"))).alias("raw"))
    values = F.transform("hits", lambda h: F.struct(h["w"].alias("w"), h["length"].alias("length"), h["pos"].alias("pos"), F.slice("raw", h["pos"] + 1, h["length"]).alias("raw")))
    both = both.select("doc_id", "rid", F.explode(values).alias("hit")).select("doc_id", "rid", "hit.*").join(few(windows), ["w", "length"])
    pairs = F.zip_with(F.arrays_zip(F.col("canon"), F.col("bench")), F.col("raw"), lambda b, d: F.when(b["canon"].rlike(_SLOT), F.struct(_plain(b["bench"]).alias("bench"), _plain(d).alias("doc"))))
    hits = both.select("doc_id", "rid", "item_id", "irid", "n_windows", "bpos", "exact", (~F.col("anchored") | (_plain(F.col("bench")[0]) == _plain(F.col("raw")[0]))).alias("anchors"), (F.col("pos") - F.col("bpos")).alias("shift"), F.filter(pairs, lambda p: p.isNotNull()).alias("pairs"))
    hits = hits.where(F.col("anchors")).where(~F.col("exact") | F.forall("pairs", lambda p: p["bench"] == p["doc"]))
    who = ["doc_id", "rid", "item_id", "irid", "n_windows"]
    lines = hits.groupBy(*who, "shift").agg(F.collect_set("bpos").alias("at"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")).where(_consistent(F.col("pairs")))
    lines = lines.groupBy(*who).agg(F.sort_array(F.collect_list(F.struct((-F.size("at")).alias("order"), "shift", "at", "pairs"))).alias("lines"))

    def join(known: Column, line: Column) -> Column:
        together = F.array_union(known["pairs"], line["pairs"])
        return F.when(_consistent(together), F.struct(F.array_union(known["at"], line["at"]).alias("at"), together.alias("pairs"))).otherwise(known)

    none = F.struct(F.array().cast("array<int>").alias("at"), F.array().cast("array<struct<bench:string,doc:string>>").alias("pairs"))
    found = lines.select(*who, F.aggregate("lines", none, join).alias("all")).select(*who, "all.*")
    changed = F.filter("pairs", lambda p: p["bench"] != p["doc"])
    found = found.select("doc_id", "rid", "item_id", (F.size("at") / F.col("n_windows")).alias("coverage"), F.size("pairs").alias("n_slots"), F.size(changed).alias("n_changed"))
    return found.where(F.col("coverage") >= coverage)
