"""Arrays of one fixed shape as files of fixed-length records, read by byte ranges.

A folder holds ``records`` (files of records) and ``description`` (one JSON line: what a record is, and how many there
are). A record is the key as eight bytes, the values as four-byte floats, both with the low byte first, and a newline.
Since every record has the same length, a reader can start at any multiple of it, so a file of any size is read by as
many tasks as its blocks, and whether the files are whole is seen from their lengths before any row is made.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_BYTES = 8
VALUE_BYTES = 4
END = "\n"


def record_bytes(shape: Sequence[int]) -> int:
    return KEY_BYTES + VALUE_BYTES * math.prod(shape) + len(END)


def write_records(df: DataFrame, path: str, key: str, values: str, shape: Sequence[int]) -> None:
    """Write ``key`` (long) and ``values`` (an array of floats, flattened by rows where ``shape`` has several axes).

    Rows without key, without values, with a null among them or with another number of them than the shape has are refused
    before anything is written. ``path`` must be free. An empty table gives a description of 0 records.
    """
    size = math.prod(shape)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(values).cast("array<float>").alias("values"))
    fits = F.col("key").isNotNull() & (F.size("values") == size) & F.forall("values", lambda x: x.isNotNull())
    n, bad = rows.agg(F.count("*"), F.count_if(~F.coalesce(fits, F.lit(False)))).first()
    if bad:
        raise ValueError(f"{bad} of {n} rows have no key or do not hold {size} values")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            data = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(len(keys), size)
            lines = [k.tobytes() + v.tobytes() for k, v in zip(keys, data)]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], names=["value"])

    # A string column takes the bytes as they are, and the text writer puts them down unchanged.
    rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", END).text(f"{path}/records")
    line = json.dumps({"records": n, "shape": list(shape), "key": "int64", "values": "float32"})
    df.sparkSession.range(1, numPartitions=1).select(F.lit(line).alias("value")).write.text(f"{path}/description")


def described(spark: SparkSession, path: str, shape: Sequence[int]) -> int:
    """How many records ``path`` holds; refused where the description or the files disagree with one another or ``shape``.

    Reads the description and the lengths of the files, none of their bytes.
    """
    lines = [r.value for r in spark.read.text(f"{path}/description").limit(2).collect()]
    if len(lines) != 1:
        raise ValueError(f"{path} has no description of its records")
    told = json.loads(lines[0])
    if told["shape"] != list(shape):
        raise ValueError(f"the records of {path} have the shape {told['shape']}, not {list(shape)}")
    one = record_bytes(shape)
    files = spark.read.format("binaryFile").load(f"{path}/records").select("length")
    total, torn = files.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count_if(F.col("length") % one != 0)).first()
    if torn or total != told["records"] * one:
        raise ValueError(f"the records of {path} are incomplete: {total} bytes instead of {told['records']} times {one}; write them again")
    return told["records"]


def read_records(spark: SparkSession, path: str, shape: Sequence[int]) -> DataFrame:
    """``(key, values)`` as :func:`write_records` wrote them, in no order; see :func:`described` for what is refused."""
    size, one = math.prod(shape), record_bytes(shape)
    if not described(spark, path, shape):
        return spark.createDataFrame([], "key long, values array<float>")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, one)
            keys = np.ascontiguousarray(data[:, :KEY_BYTES]).view("<i8").ravel()
            values = np.ascontiguousarray(data[:, KEY_BYTES : KEY_BYTES + VALUE_BYTES * size]).view("<f4").ravel()
            starts = pa.array(np.arange(len(data) + 1) * size, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(starts, pa.array(values, pa.float32()))], names=["key", "values"])

    # Spark's reader of fixed-length records is the one that cuts binary files by byte ranges.
    rows = spark.sparkContext.binaryRecords(f"{path}/records", one).map(lambda r: (r,)).toDF("record binary")
    return rows.mapInArrow(unpack, "key long, values array<float>")
