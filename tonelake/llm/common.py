"""What the text operators share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.plans.joins import shuffled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stored tables of ids and hashes are broadcast up to this many rows, about 20 MB.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a stored table of ids and hashes, to be broadcast if its rows are counted few enough; else its join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else shuffled(df)


def give_back() -> None:
    """Return freed memory to the system: the buffers that Arrow's allocator keeps, and those that the C library's keeps (Linux)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function over batches, so that a task gives back what its allocators keep when it ends.

    Workers live on after a task, and what they keep stands beside the next stage in the executor's memory.
    """

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def parts(batches: Iterator, rows: int = 256) -> Iterator:
    """The same rows in small batches or arrays: Python strings and hashes take more room than the Arrow texts they come from."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """``(doc_id, rid, text)``: null texts become empty; ``rid`` is a hash of id and text. ``carry``: ``row`` has the whole row.

    The pair (doc_id, rid) names a document. It depends on the row alone, so it stays the same when a lost task runs
    again; rows that repeat id and text share it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("rid"), text.alias("text"), *[F.struct("*").alias("row")] * carry)


def same(*names: str) -> Column:
    """Null-safe equality of ``a.name`` and ``b.name`` for each name."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))
    return out
