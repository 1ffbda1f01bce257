"""Exact substring dedup: every byte inside a long string that also starts elsewhere is removed.

A string of ``length`` bytes starts at every position (a suffix, cut off at ``length``). Sorting all suffixes of a
corpus in one place is out of the question, so they are first dealt into buckets in which equal ones must meet: the
bucket of a suffix is its anchor, the substring of ANCHOR bytes with the smallest hash among those it holds. Suffixes
that start side by side mostly share their anchor, so a document is a short list of stretches (anchor, first start,
number of starts), about one for 50 bytes, and only hashes of stretches are shuffled:

1. stretches whose anchor occurs once have no equal and go;
2. stretches equal as a whole to another one are repeated from end to end;
3. the rest, the ends of repeated passages, are sorted: the tasks get the bytes of one stretch of each kind and sort
   the suffixes of a bucket by a bottom-up mergesort. A comparison finds the common extension of two suffixes by binary
   search over prefix polynomial hashes (eight steps for 200 bytes) and looks at the next byte. Neighbours with a
   common extension of ``length`` are equal; their bytes are compared before they count.

All hashes are polynomial prefix hashes modulo 2**64: one pass of multiplications and a running sum over the bytes.
Anchors shared by very many different stretches are taken apart by the whole suffix instead, one row each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import keyed, same
from tonelake.plans.joins import join_back
from tonelake.sources.shared import materialize

ANCHOR = 88
#: A bucket with more different stretches than this is dealt out by whole suffixes.
BUCKET_STRETCHES = 2000
CHUNK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2**64)


@lru_cache(4)
def _power_table(base: int, size: int) -> np.ndarray:
    table = np.full(size, base, np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


def _powers(base: int, n: int) -> np.ndarray:
    return _power_table(base, 1 << max(12, (n - 1).bit_length()))[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """``s[i]``: sum of byte k times base to the k over the first i bytes, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=out[1:])
    return out


def substring_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The polynomial hash of the bytes from start to stop, the same wherever they stand."""
    return (sums[stop] - sums[start]) * _powers(_BACK, len(sums))[start]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > CHUNK_BYTES:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def stretches(texts: list[bytes], length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """For each stretch: text number, first start, number of starts, offset of the anchor, hashes of anchor and stretch."""
    bounds = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums = prefix_sums(data)
    at = np.arange(len(data) - anchor + 1)
    grams = _mix(substring_hash(sums, at, at + anchor))
    # The smallest upper half wins, the leftmost of equals; the lower half carries the place.
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width, step = length - anchor + 1, 1
    while 2 * step <= width:
        least = np.minimum(least[: len(least) - step], least[step:])
        step *= 2
    least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    winner = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # for each start of a suffix, text borders not heeded
    text = np.searchsorted(bounds, np.arange(len(winner)), "right") - 1
    inside = np.arange(len(winner)) + length <= bounds[text + 1]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    w, t = winner[starts], text[starts]
    first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (t[1:] != t[:-1])))
    count = np.diff(np.append(first, len(starts)))
    begin, won, own = starts[first], w[first], t[first]
    whole = _mix(substring_hash(sums, begin, begin + count + length - 1) + count.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return own, begin - bounds[own], count, won - begin, grams[won].view(np.int64), whole.view(np.int64)


def common_extension(sums: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Length of the common beginning, ``length`` at most, of the suffixes at a and b, by binary search over hashes."""
    power = _powers(_BASE, len(sums))
    known, pa_, pb = np.zeros(len(a), np.int64), power[a], power[b]
    sa, sb = sums[a], sums[b]
    step = 1 << (length.bit_length() - 1)
    while step:
        more = known + step
        fits = more <= length
        ext = np.where(fits, more, 0)
        known = np.where(fits & ((sums[a + ext] - sa) * pb == (sums[b + ext] - sb) * pa_), more, known)
        step >>= 1
    return known


def _less(data: np.ndarray, sums: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    ext = common_extension(sums, a, b, length)
    end = np.minimum(ext, length - 1)
    return (ext < length) & (data[a + end] < data[b + end])


def merge_sort(data: np.ndarray, sums: np.ndarray, pos: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Order of the suffixes at ``pos`` inside each run of equal ``group`` (already together): a bottom-up mergesort.

    Every round merges neighbouring runs in all groups at once: the place of an element in the merged run is its place
    in its own run plus the number of elements of the sister run before it, found by binary search.
    """
    n = len(pos)
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(head, n))
    first, last = np.repeat(head, size), np.repeat(head + size, size)
    order, width = np.arange(n), 1
    while len(size) and width < size.max():
        moving = np.flatnonzero(last - first > width)
        rel = moving - first[moving]
        run = rel // width
        start = first[moving] + run * width
        left = run % 2 == 0
        other = np.where(left, start + width, start - width)
        stop = np.minimum(np.where(left, other + width, start), last[moving])
        low, high = np.minimum(other, stop), stop
        mine = pos[order[moving]]
        base = low.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            theirs, own = pos[order[mid]], mine[open_]
            # Elements of the left run go first among equals.
            is_left = left[open_]
            before = np.where(is_left, _less(data, sums, theirs, own, length), ~_less(data, sums, own, theirs, length))
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        place = np.where(left, start, other) + (moving - start) + (low - base)
        new = order.copy()
        new[place] = order[moving]
        order, width = new, 2 * width
    return order


def repeated_starts(contexts: list[bytes], lead: np.ndarray, bucket: np.ndarray, length: int) -> list[np.ndarray]:
    """Offsets, for each context, of the suffixes that another context of its bucket has at the same distance from the anchor.

    ``lead``: distance of the anchor from the context's first byte. Contexts of a bucket stand together.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    base = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(contexts)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    pos = base[owner] + offset
    sums = prefix_sums(data)
    # A suffix whose hash is alone has no equal and need not be sorted.
    _, kind, many = np.unique(substring_hash(sums, pos, pos + length), return_inverse=True, return_counts=True)
    keep = np.flatnonzero(many[kind] > 1)
    owner, offset, pos = owner[keep], offset[keep], pos[keep]
    far = lead[owner] - offset
    _, number = np.unique(bucket, return_inverse=True)
    by = np.lexsort((far, number[owner]))
    owner, offset, pos, far = owner[by], offset[by], pos[by], far[by]
    group = np.cumsum(np.append(0, (far[1:] != far[:-1]) | (number[owner][1:] != number[owner][:-1])))[: len(pos)]
    order = merge_sort(data, sums, pos, group, length)
    a, b = order[:-1], order[1:]
    close = np.flatnonzero(group[a] == group[b])
    a, b = a[close], b[close]
    equal = common_extension(sums, pos[a], pos[b], length) == length
    a, b = a[equal], b[equal]
    # Equal hashes are believed only where the bytes agree.
    true = np.zeros(len(a), bool)
    for at in range(0, len(a), 20_000):
        part = slice(at, at + 20_000)
        span = np.arange(length)
        true[part] = (data[pos[a[part]][:, None] + span] == data[pos[b[part]][:, None] + span]).all(axis=1)
    hit = np.zeros(len(pos), bool)
    hit[a[true]] = hit[b[true]] = True
    if not true.all():  # a collision: neighbours may hide an equal further on, so these groups are compared by bytes
        for g in np.unique(group[a[~true]]):
            members, seen = np.flatnonzero(group == g), {}
            for m in members:
                seen.setdefault(data[pos[m] : pos[m] + length].tobytes(), []).append(m)
            for same_ in seen.values():
                hit[same_] = len(same_) > 1
    found = np.flatnonzero(hit)
    sort = np.lexsort((offset[found], owner[found]))
    owner, offset = owner[found][sort], offset[found][sort]
    return np.split(offset, np.searchsorted(owner, np.arange(1, len(contexts))))


def _spans(first: int, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Covered bytes, from and to, of runs of starts."""
    if len(offsets):
        cut = np.flatnonzero(np.diff(offsets) > 1)
        for a, b in zip(np.append(0, cut + 1), np.append(cut, len(offsets) - 1)):
            yield first + int(offsets[a]), first + int(offsets[b]) + length


def _stretch_rows(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in _chunks(texts):
                own, first, count, lead, h, c = stretches(texts[a:b], length, anchor)
                take = pa.array(own + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(first.astype(np.int32)), pa.array((count << 16 | lead).astype(np.int32)), pa.array(h), pa.array(c)],
                    names=["doc_id", "rid", "first", "shape", "h", "c"],
                )

    rows = docs.select("doc_id", "rid", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, rid long, first int, shape int, h long, c long")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted stretches: ``(h, doc_id, rid, first, shape, bytes)``."""
    lists = wanted.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("h", "first", "shape")).alias("wanted"))
    both = docs.alias("a").join(lists.alias("b"), same("doc_id", "rid")).select("a.doc_id", "a.rid", "a.text", F.explode("b.wanted").alias("w"))
    size = F.shiftright("w.shape", 16) + (length - 1)
    return both.select("w.h", "doc_id", "rid", "w.first", "w.shape", F.substring(F.col("text"), F.col("w.first") + 1, size).alias("bytes"))


def repeated_spans(docs: DataFrame, length: int = 200, anchor: int = ANCHOR, bucket_stretches: int = BUCKET_STRETCHES) -> DataFrame:
    """``(doc_id, rid, spans)``: for documents of keyed() with binary ``text``, the byte ranges covered by repeated strings."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    span_type = f"doc_id {kind}, rid long, start int, stop int"
    rows = _stretch_rows(docs, length, anchor)
    repeated = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    alive = materialize(join_back(rows, repeated, ["h"], "left_semi"), "stretches")
    kinds = alive.groupBy("h", "c").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "rid", "first", "shape")).alias("one"))
    whole = kinds.where("copies > 1").select("h", "c")
    full = join_back(alive, whole, ["h", "c"], "left_semi").select("doc_id", "rid", F.col("first").alias("start"), (F.col("first") + F.shiftright("shape", 16) - 1 + length).alias("stop"))
    buckets = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    mixed = join_back(kinds, buckets, ["h"]).select("h", "kinds", "copies", "one.*")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size > CHUNK_BYTES and row[0] != held[-1][0]:
                    yield from spans(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield from spans(held)

    def spans(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, ids, rids, firsts, shapes, texts = zip(*held)
        found = repeated_starts(list(texts), np.array(shapes) & 0xFFFF, np.array(h), length)
        out = [(ids[i], rids[i], a, b) for i, offsets in enumerate(found) for a, b in _spans(firsts[i], offsets, length)]
        columns = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], names=["doc_id", "rid", "start", "stop"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(docs.schema["doc_id"].dataType)
    ordinary = _contexts(docs, mixed.where(F.col("kinds") <= bucket_stretches), length)
    ends = ordinary.repartition("h").sortWithinPartitions("h").mapInArrow(sort, span_type)

    # Crowded buckets: one row for every suffix, which meets its equals by its own hash.
    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                out = [(d, r, f + i, hashlib.blake2b(text[i : i + length], digest_size=16).digest()) for _, d, r, f, _, text in zip(*[c.to_pylist() for c in part.columns]) for i in range(len(text) - length + 1)]
                ids, rids, starts, digests = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(rids, pa.int64()), pa.array(starts, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "rid", "start", "w"])

    crowded = _contexts(docs, mixed.where(F.col("kinds") > bucket_stretches), length).mapInArrow(suffixes, f"doc_id {kind}, rid long, start int, w binary")
    twice = crowded.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    single = join_back(crowded, twice, ["w"], "left_semi").select("doc_id", "rid", "start", (F.col("start") + length).alias("stop"))
    return full.unionByName(ends).unionByName(single).groupBy("doc_id", "rid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, anchor: int = ANCHOR, bucket_stretches: int = BUCKET_STRETCHES) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``, one row per input row; ``kept`` holds the remaining bytes.

    Texts are UTF-8 bytes (null: empty); strings of ``length`` bytes never cross documents; a string that starts twice
    anywhere, overlaps and the same document included, is removed at every place. Rows that repeat are two documents
    with the same text, so all their long strings repeat. Null ids are kept; other columns are not read. A very long text is
    hashed as a whole, at about ten longs a byte. An empty table gives an empty result.
    """
    rows = keyed(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = repeated_spans(rows, length, anchor, bucket_stretches)
    both = rows.alias("a").join(found.alias("b"), same("doc_id", "rid"), "left").select("a.doc_id", "a.text", "b.spans.start", "b.spans.stop")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, starts, stops in zip(*[c.to_pylist() for c in batch.columns]):
                kept, at, n = [], 0, 0
                edge = -1
                for a, b in sorted(zip(starts or (), stops or ())):
                    if a > edge:
                        n += 1
                        kept.append(text[at:a])
                    edge = max(edge, b)
                    at = edge
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append((doc_id, len(text), len(text) - len(rest), n, rest))
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(columns[k], pa.int64()) for k in (1, 2, 3)], pa.array(columns[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
