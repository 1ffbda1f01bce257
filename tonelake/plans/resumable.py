"""Builds in parts that a stopped run takes up again.

A build has an identity, a text that names everything it depends on (input digests, settings). Parts are written one
after the other under a folder of that identity. A part counts once its files are committed and its line in the manifest
is, so the manifest never runs ahead of the rows. A later run of the same identity writes the parts that are missing;
another identity starts afresh and removes what the old one left.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([T.StructField("identity", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("rows", T.LongType()), T.StructField("run", T.IntegerType())])


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def put_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written aside and renamed."""
    aside, fs = _folder(spark, f"{path}.partial")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(aside, _folder(spark, path)[0]):
        raise OSError(f"{path} could not be put in place")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(identity, part, rows, run)``: the parts that stand finished, and which run of their build wrote them."""
    at, fs = _folder(spark, f"{path}/manifest")
    return spark.read.schema(MANIFEST).json(f"{path}/manifest/*.json") if fs.exists(at) and len(fs.listStatus(at)) else spark.createDataFrame([], MANIFEST)


def build(spark: SparkSession, path: str, identity: str, parts: int, part: Callable[[int], DataFrame]) -> DataFrame:
    """The rows of ``part(0)`` to ``part(parts - 1)``, each written once, reread.

    An error in one part ends the run and leaves the finished ones; the next call with the same identity goes on behind them.
    """
    lines = manifest(spark, path)
    if not lines.where(~F.col("identity").eqNullSafe(F.lit(identity))).isEmpty():
        at, fs = _folder(spark, path)
        fs.delete(at, True)
    done = {r.part: r.run for r in manifest(spark, path).collect()}  # one small row for each part
    run = max(done.values(), default=0) + 1
    for n in range(parts):
        if n not in done:
            at = f"{path}/rows/{n:06d}"
            part(n).write.mode("overwrite").parquet(at)
            rows = spark.read.parquet(at).count()
            put_file(spark, f"{path}/manifest/{n:06d}.json", json.dumps({"identity": identity, "part": n, "rows": rows, "run": run}))
    return spark.read.parquet(*[f"{path}/rows/{n:06d}" for n in range(parts)])
