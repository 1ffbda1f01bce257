"""Near-duplicates by the similarity of shingle sets: every pair with a Jaccard similarity of ``similarity`` or more.

SimHash goes first: each set has a fingerprint, fingerprints meet in the cells of their segment counts (``simhash.links``),
and sets whose fingerprints differ by two bits at most are held against each other exactly. That finds copies and the
closest edits. A pair with a similarity of 0.8 differs in about ten of 64 bits, where unrelated texts meet too, so what
SimHash leaves apart is completed from the sets themselves. In any order that all sets share, two sets that similar have
an element in common among their first ``n - ceil(similarity * n) + 1`` (prefix filter), so a join over these keys misses no
pair. The order only decides how many keys are shared: shingles that a sample finds often come last. Candidates of both kinds
are verified on their prefixes and then on the whole sets, which are made again from their texts; only the prefixes, a
fifth, are stored for all.

Equal sets are one. Pairs of a large group are not listed: sets of one fingerprint are held against one of them; then, for keys where
different components still meet, all members against one of them, twice; and at last only pairs of different components. The second time
it is the member in which the key stands earliest: seldom shingles come first, so this is the text of a group that has the fewest
of its own, the one that others were edited from.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.llm import simhash
from tonelake.llm.common import keyed, parts, released, same, small
from tonelake.plans.graph import connected_components
from tonelake.plans.joins import join_back, shuffled, unless_few
from tonelake.sources.shared import discard, materialize

#: At most so many shingles, found in four or more documents of a sixteenth, come last in the order.
OFTEN = 20_000
#: A large group is held against so many of its members, by key.
STARS = 8
#: So often each key whose members are still apart gets a star of its own (the member that it stands earliest in), before
#: the pairs that are left are listed.
ROUNDS = 1


def _sets_of(texts: list[bytes], shingle: int, seed: int) -> list[np.ndarray]:
    """For each text the hashes of its shingles, sorted, each once."""
    return [np.unique(simhash.shingle_hashes(t, shingle, seed)).view(np.int64) for t in texts]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))


def _often(rows: DataFrame, shingle: int, seed: int) -> np.ndarray:
    """Shingles that a sixteenth of the documents shows to be common, OFTEN at most. They only decide the order of a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([_lists(_sets_of(batch.column(0).to_pylist(), shingle, seed)).flatten()], names=["key"])

    keys = rows.where(F.pmod("rid", F.lit(16)) == 0).select("text").mapInArrow(released(run), "key long")
    often = keys.groupBy("key").agg(F.count("*").alias("n")).where("n >= 4").orderBy(F.desc("n"), "key").limit(OFTEN).collect()
    return np.sort(np.array([r.key for r in often], np.int64))


def prefixes(rows: DataFrame, similarity: float = 0.8, shingle: int = 5, seed: int = 42) -> DataFrame:
    """``(doc_id, rid, sid, fp, n, prefix)`` for every row of keyed() with binary ``text``.

    ``sid`` is the hash of the set of shingle hashes, ``fp`` its SimHash, ``n`` its size, ``prefix`` its first elements in
    the common order.
    """
    last = _often(rows, shingle, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets, first = _sets_of(batch.column(2).to_pylist(), shingle, seed), []
            for s in sets:
                late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(len(s), bool)
                n = len(s) - ceil(similarity * len(s) - 1e-9) + 1 if len(s) else 0
                first.append(np.concatenate([s[~late], s[late]])[:n])
            sids = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64)
            fps = np.array([simhash.voted(s) for s in sets], np.uint64).view(np.int64)
            sizes = np.array([*map(len, sets)], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sids), pa.array(fps), pa.array(sizes), _lists(first)], names=["doc_id", "rid", "sid", "fp", "n", "prefix"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"doc_id {kind}, rid long, sid long, fp long, n int, prefix array<long>")


def _whole_sets(rows: DataFrame, named: DataFrame, shingle: int, seed: int) -> DataFrame:
    """``(sid, s)``: the sets of the documents in ``named`` (doc_id, rid, sid), from their texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(_sets_of(batch.column(1).to_pylist(), shingle, seed))], names=["sid", "s"])

    texts = rows.alias("a").join(small(named).alias("b"), same("doc_id", "rid")).select("b.sid", "a.text")
    # Repeated rows have one name: one of them is enough.
    return texts.mapInArrow(released(run), "sid long, s array<long>").groupBy("sid").agg(F.first("s").alias("s"))


def _possible(similarity: float) -> Column:
    """Whether the sets ``a`` and ``b``, with a first common key at places ``i``, can have enough in common."""
    a_n, b_n = F.col("a.n"), F.col("b.n")
    most = F.least(a_n - F.col("a.i"), b_n - F.col("b.i"))
    return most + 1e-6 >= (a_n + b_n) * (similarity / (1 + similarity))


def _prefix_size(n: Column, similarity: float) -> Column:
    return n - F.ceil(n * similarity - 1e-9).cast("int") + 1


def _ends(pairs: DataFrame) -> DataFrame:
    """``(sid)``: the different sets of the pairs; each side is made distinct before the two meet."""
    return pairs.select(F.col("src").alias("sid")).distinct().unionByName(pairs.select(F.col("dst").alias("sid")).distinct()).distinct()


def _joined(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (src, dst) with the ``columns`` of both sets as structs ``a`` and ``b``."""
    for end, name in (("src", "a"), ("dst", "b")):
        pairs = pairs.join(sets.select(F.col("sid").alias(end), F.struct(*columns).alias(name)), end)
    return pairs


def _enough(shared: Column, a_n: Column, b_n: Column, similarity: float) -> Column:
    """Whether the prefixes of two sets have enough in common. What the sets share beyond the prefix that ends first lies
    in the rest of that set, so the prefixes have to share what is needed less the larger rest."""
    rest = F.greatest(*[n - _prefix_size(n, similarity) for n in (a_n, b_n)])
    return shared + 1e-6 >= (a_n + b_n) * (similarity / (1 + similarity)) - rest


def _near(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(src, dst)`` whose prefixes have enough in common."""
    pairs = materialize(pairs, "pairs")
    ends = materialize(_ends(pairs), "ends")
    both = _joined(unless_few(pairs), sets.join(small(ends), "sid", "left_semi"), "n", "prefix")
    enough = _enough(F.size(F.array_intersect("a.prefix", "b.prefix")), F.col("a.n"), F.col("b.n"), similarity)
    near = materialize(both.where(enough).select("src", "dst"), "near")
    discard(pairs)
    discard(ends)
    return near


def _verified(near: DataFrame, sets: DataFrame, rows: DataFrame, similarity: float, shingle: int, seed: int) -> DataFrame:
    """The pairs ``(src, dst)`` of sets that are similar enough as a whole. ``near`` is a stored table."""
    named = materialize(sets.select("sid", "least.doc_id", "least.rid").join(_ends(near), "sid"), "named")
    whole = materialize(_whole_sets(rows, named, shingle, seed), "whole")
    both = _joined(unless_few(near), whole, "s")
    common = F.size(F.array_intersect("a.s", "b.s"))
    found = materialize(both.where(common / (F.size("a.s") + F.size("b.s") - common) >= similarity).select("src", "dst"), "links")
    for t in (near, named, whole):
        discard(t)
    return found


def _apart(met: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``met`` with their component as ``part``, for keys where different components meet; stored."""
    classes = connected_components(found)
    apart = met.join(classes, met.sid == classes.node, "left").select("key", "sid", "n", "i", F.coalesce("component", "sid").alias("part"))
    mixed = apart.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("key")
    return materialize(join_back(apart, mixed, ["key"]).select("key", "sid", "n", "i", "part"), "apart")


def _by_simhash(sets: DataFrame, distance: int = 2) -> DataFrame:
    """Candidates ``(src, dst)`` by SimHash: sets of one fingerprint with the first of them, and the first ones of fingerprints
    that simhash.links() joins. As many as there are sets and links, however large a group is."""
    chosen = materialize(sets.groupBy("fp").agg(F.min("sid").alias("first")), "chosen")
    equal = join_back(sets.select("fp", "sid"), chosen, ["fp"]).select(F.col("first").alias("src"), F.col("sid").alias("dst")).where("src <> dst")
    near = simhash.links(chosen.select("fp"), distance)
    for end in ("src", "dst"):
        near = near.join(chosen.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_sid")), end)
    return equal.unionByName(near.select(F.col("src_sid").alias("src"), F.col("dst_sid").alias("dst")))


def links(sets: DataFrame, rows: DataFrame, similarity: float = 0.8, shingle: int = 5, seed: int = 42) -> DataFrame:
    """``(src, dst)``: links that join exactly those sets reachable over similar pairs.

    ``sets``: ``(sid, least, fp, n, prefix)``, one row for each different set; ``rows``: the documents that ``least`` names.
    """
    keys = sets.select("sid", "n", F.posexplode("prefix").alias("i", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    met = materialize(join_back(shuffled(keys), shared, ["key"]).select("key", "sid", "n", "i"), "met")
    found = _verified(_near(_by_simhash(sets), sets, similarity), sets, rows, similarity, shingle, seed)
    apart = _apart(met, found)
    discard(met)
    # First the member with the least hash of eight, so that the same pairs come up at many keys; then the one in which the key stands earliest.
    hashed = F.xxhash64(F.pmod("key", F.lit(STARS)), "sid")
    for first in (hashed, *[F.struct("i", F.xxhash64(F.lit(salt), "key", "sid")) for salt in range(ROUNDS)]):
        chosen = apart.groupBy("key").agg(F.min(F.struct(first.alias("first"), "sid", "n", "i", "part")).alias("star"))
        stars = join_back(unless_few(apart), chosen, ["key"]).select(F.struct("sid", "n", "i", "part").alias("a"), F.col("star").alias("b")).where("a.part <> b.part").where(_possible(similarity))
        stars = stars.select(F.least("a.sid", "b.sid").alias("src"), F.greatest("a.sid", "b.sid").alias("dst")).distinct()
        found = found.unionByName(_verified(_near(stars, sets, similarity), sets, rows, similarity, shingle, seed))
        fewer = _apart(apart.drop("part"), found)
        discard(apart)
        apart = fewer
    # What is possible at a key that two sets share is possible at the first one, too, so late places make no rows here.
    rest = unless_few(apart).alias("a").join(apart.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.sid") < F.col("b.sid")) & (F.col("a.part") != F.col("b.part")) & _possible(similarity))
    rest = rest.select(F.col("a.sid").alias("src"), F.col("b.sid").alias("dst")).distinct()
    found = found.unionByName(_verified(_near(rest, sets, similarity), sets, rows, similarity, shingle, seed))
    discard(apart)
    return found


def one_of_each(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42) -> DataFrame:
    """One row of each group of near-duplicates, whole: the first by doc_id and then by ``rid`` (hash of id and text).

    A group is what is reachable over pairs of rows whose sets of ``shingle``-word shingles have a Jaccard similarity
    of ``similarity`` (above 0) or more; SimHash finds the closest of them, the prefix join the others.
    Texts without words, null ones among them, are one group; a null doc_id stays only if its group has no other id. Repeated rows are one. Very long texts are one set each, as large as the text.
    An empty table gives an empty result; further columns are kept as they are.
    """
    rows = keyed(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    prints = materialize(prefixes(rows, similarity, shingle, seed), "prefixes")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("least")
    sets = materialize(prints.groupBy("sid").agg(least, F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "sets")
    roots = connected_components(links(sets, rows, similarity, shingle, seed))
    rooted = sets.join(roots, sets.sid == roots.node, "left").select("least", F.coalesce("component", "sid").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("first")).select("first.doc_id", "first.rid")
    names = prints.groupBy("doc_id", "rid").agg(F.count("*").alias("n"))
    # Mostly few rows go and none repeats, so the texts need no shuffle.
    gone = materialize(names.alias("a").join(first.alias("b"), same("doc_id", "rid"), "left_anti").select("doc_id", "rid"), "gone")
    twice = materialize(names.where("n > 1").select("doc_id", "rid"), "repeated")
    kept = keyed(docs, id_col, text_col, carry=True).drop("text").alias("a").join(small(gone).alias("b"), same("doc_id", "rid"), "left_anti")
    discard(prints)
    discard(sets)
    if twice.isEmpty():
        return kept.select("row.*")
    twice = unless_few(twice)
    once = kept.alias("a").join(twice.alias("b"), same("doc_id", "rid"), "left_anti").select("row")
    again = kept.alias("a").join(twice.alias("b"), same("doc_id", "rid"), "left_semi").groupBy("doc_id", "rid").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(again).select("row.*")
