"""SimHash near-duplicates found by a segment-popcount embedding.

A 64-bit fingerprint becomes the vector of bit counts of its segments. Changing one bit moves one coordinate by one,
so the Manhattan distance of two vectors never exceeds the Hamming distance of the fingerprints. The range join
"Manhattan distance of 2 at most" runs on the integer grid: two lattice points that close always share a lattice
point within distance 1 of both, so each fingerprint is dealt to its own cell and the cells next to it, and pairs
meet in a common cell. Distances are then verified bit by bit.

Only distinct fingerprints are joined. Cells with many of them are taken to the finest grid, segments of one bit,
where a cell holds 65 fingerprints at most; so no task and no row ever holds an unbounded group, and pairs are never
listed: a cell returns a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import keyed, released
from tonelake.plans.graph import connected_components
from tonelake.plans.joins import join_back, shuffled
from tonelake.sources.shared import materialize

SEGMENT_BITS = 4
#: A cell with more distinct fingerprints than this goes to the one-bit grid.
CELL_ROWS = 512


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """Hashes of the ``shingle``-word shingles of UTF-8 bytes, in their order; fewer words are one shingle, no words none."""
    words = text.lower().split()  # for bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)


def voted(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as an unsigned number; no hashes: 0."""
    n = len(hashes)
    votes = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """SimHash of the ``shingle``-word shingles of UTF-8 bytes, as an unsigned number; no words: 0."""
    return voted(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42) -> DataFrame:
    """``(doc_id, rid, fp)`` for every row: ``fp`` as a signed long, ``rid`` a hash of id and text (see keyed())."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "rid", "fp"])

    rows = keyed(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"doc_id {kind}, rid long, fp long")


def grid_cells(fps: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """``(cell, fp)``: the cell of the fingerprint's segment counts and the cells one step away."""
    side = segment_bits + 1
    count = [F.bit_count(F.shiftrightunsigned("fp", s * segment_bits).bitwiseAND(F.lit((1 << segment_bits) - 1))).cast("long") for s in range(64 // segment_bits)]
    own = sum((c * F.lit(side**s) for s, c in enumerate(count)), F.lit(0).cast("long"))
    at = fps.select("fp", own.alias("own"), F.array(*count).alias("n"))
    steps = F.array(
        F.col("own"),
        *[F.when(F.col("n")[s] > 0, F.col("own") - side**s) for s in range(len(count))],
        *[F.when(F.col("n")[s] < segment_bits, F.col("own") + side**s) for s in range(len(count))],
    )
    return at.select("fp", F.explode(steps).alias("cell")).where("cell is not null")


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the distinct fingerprints of one cell, each within ``distance`` bits."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    links, seen = [], np.zeros(len(fps), bool)
    for start in range(len(fps)):
        if seen[start]:
            continue
        seen[start], front = True, [start]
        while front:
            i = front.pop()
            new = np.flatnonzero(near[i] & ~seen)
            seen[new] = True
            links += [(int(fps[i]), int(fps[j])) for j in new]
            front += new.tolist()
    return links


def links(fps: DataFrame, distance: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(src, dst)``: links between distinct fingerprints that join exactly those reachable within ``distance`` (2 at most)."""
    if not 0 <= distance <= 2:
        raise ValueError("a shared neighbouring cell is certain for distances up to 2 only")
    cells = grid_cells(fps)
    counts = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    met = join_back(shuffled(cells), counts, ["cell"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, pairs = batch.column(0), []
            values, at = column.flatten().to_numpy(zero_copy_only=False), 0
            for size in column.value_lengths().to_pylist():
                pairs += _forest(values[at : at + size], distance)
                at += size
            src, dst = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    ordinary = met.where(F.col("n") <= cell_rows).groupBy("cell").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(released(run), "src long, dst long")
    # Segments of one bit: the cells of a fingerprint are itself and its 64 one-bit changes.
    crowded = met.where(F.col("n") > cell_rows).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), b) for b in range(64)])
    fine = crowded.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("cell"))
    hub = fine.groupBy("cell").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps").mapInArrow(released(run), "src long, dst long")
    return ordinary.unionByName(hub).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, shingle: int = 5, seed: int = 42, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(doc_id, fingerprint, component_id, kept)``, one row per input row.

    ``kept`` is the ``rid`` (hash of id and text) of the component's first row, by doc_id and then by ``rid``.
    ``component_id`` is the smallest doc_id reachable over links of ``distance`` differing bits at most. Null and
    empty texts have fingerprint zero and are linked like any other; a null doc_id keeps its row and counts only if
    its component has no other id. Repeated rows stay repeated. A very long text holds the hashes of all its shingles
    while it is read. An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    least = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("least"))
    roots = connected_components(links(prints.select("fp").distinct(), distance, cell_rows))
    rooted = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("first"))
    classes = join_back(rooted, names, ["root"]).select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.rid").alias("kept"))
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "kept")
