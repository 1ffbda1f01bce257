"""Token ids packed into fixed-length rows by best-fit decreasing.

Documents are tokenised and packed where they are read, without a shuffle. A task gathers the pieces of about
``group_tokens`` tokens, sorts them by falling length and puts each into the open row with the least room that still
holds it. Rooms are kept in a segment tree over capacities, so the search takes a walk of log2(row length) nodes.
Documents longer than a row are split without loss: full rows first, the rest packed like any other piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256


class Capacities:
    """Open rows by their room: a segment tree that counts the rows in each range of capacities."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << max(1, most.bit_length())
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and number of the fullest row that has room for ``need``; it is taken out."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers: best fit by falling size (ties in order), every size at most ``length``."""
    rows: list[list[int]] = []
    rooms = Capacities(length)
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[piece]
        found = rooms.take(size)
        room, row = found or (length, len(rows))
        if found is None:
            rows.append([])
        rows[row].append(piece)
        if room > size:
            rooms.add(room - size, row)
    return rows


@lru_cache(2)
def _encoding(ranks: bytes) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})


def position_ids(cu_seqlens: list[int], length: int) -> np.ndarray:
    """Positions of a packed row, from zero again at each reset; the padding counts from zero, too."""
    edges = np.array([*cu_seqlens, length])
    return np.arange(length) - np.repeat(edges[:-1], np.diff(edges))


def pack(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = END, pad_id: int = END, group_tokens: int = 2_000_000) -> DataFrame:
    """``(task, row, ids, n_tokens, cu_seqlens, resets, segments)``: packed rows of ``length`` ids.

    ``ids``: little-endian uint16 (uint32 if an id needs it), padded with ``pad_id``; ``cu_seqlens``: borders of the segments, from 0 to
    ``n_tokens``; ``resets``: where positions start again from zero; ``segments``: doc_id, part and size of each piece
    in order. Every document ends with ``end_id``, so null and empty texts are one token; a document's parts, in order,
    join to its ids. Null ids and repeated rows are kept; an empty table gives no rows; other columns are not read.
    Rows depend on how the input is split into tasks; a task that runs again packs the same rows.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    largest = max(end_id, pad_id, *(int(line.split()[1]) for line in ranks.value.splitlines() if line))
    width = np.uint16 if largest < 1 << 16 else np.uint32
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, task, made = _encoding(ranks.value), TaskContext.get().partitionId(), 0
        ids, parts, pieces, held = [], [], [], 0

        def packed() -> pa.RecordBatch:
            bins = best_fit([len(p) for p in pieces], length)
            matrix = np.full((len(bins), length), pad_id, width)
            used, cu, segments = [], [], []
            for r, members in enumerate(bins):
                borders = np.cumsum([0, *[len(pieces[m]) for m in members]])
                for m, at in zip(members, borders):
                    matrix[r, at : at + len(pieces[m])] = pieces[m]
                used.append(int(borders[-1]))
                cu.append(borders.tolist())
                segments.append([(ids[m], parts[m], len(pieces[m])) for m in members])
            id_type = batch.schema.field(0).type
            shape = pa.list_(pa.struct([("doc_id", id_type), ("part", pa.int32()), ("size", pa.int32())]))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([task] * len(bins), pa.int32()), pa.array(range(made, made + len(bins)), pa.int64()), pa.array([m.tobytes() for m in matrix], pa.binary()), pa.array(used, pa.int32()),
                    pa.array(cu, pa.list_(pa.int32())), pa.array([c[:-1] for c in cu], pa.list_(pa.int32())), pa.array([[dict(zip(("doc_id", "part", "size"), s)) for s in row] for row in segments], shape),
                ],
                names=["task", "row", "ids", "n_tokens", "cu_seqlens", "resets", "segments"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = encoding.encode_to_numpy(text.as_py(), disallowed_special=())
                tokens = np.append(tokens, end_id).astype(width)
                for part, at in enumerate(range(0, len(tokens), length)):
                    ids.append(doc_id)
                    parts.append(part)
                    pieces.append(tokens[at : at + length])
                held += len(tokens)
                if held >= group_tokens:
                    out = packed()
                    made += out.num_rows
                    yield out
                    ids, parts, pieces, held = [], [], [], 0
        if pieces:
            yield packed()

    return rows.mapInArrow(run, f"task int, row long, ids binary, n_tokens int, cu_seqlens array<int>, resets array<int>, segments array<struct<doc_id:{kind},part:int,size:int>>")
