"""Passes that recompute only what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions.hashing import revision

MEMO = "kind string, digest string, completed_at timestamp"


def input_digest(df: DataFrame, *columns: str) -> str:
    """A mark of a table's rows in any order; it moves with every change of a row."""
    n, mark = revision(df, *columns).first()
    return f"{n}:{mark}"


def _memo(spark: SparkSession, path: str) -> DataFrame:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], MEMO)
    return spark.read.schema(MEMO).parquet(path)


def run_if_changed(spark: SparkSession, memo_path: str, kind: str, digest: Callable[[], str], work: Callable[[], None]) -> bool:
    """Run ``work`` unless the last completed pass of this kind saw the same input; say whether it ran.

    The pass is recorded only if the input is the same afterwards; a pass that fails or whose input moved leaves no
    record, and an older record is forgotten first. The memo is an append-only table, the last entry counts.
    """
    entries = _memo(spark, memo_path).where(F.col("kind") == kind)
    last = entries.agg(F.max_by("digest", "completed_at")).first()[0]
    before = digest()
    if last == before:
        return False
    note = lambda value: spark.createDataFrame([(kind, value)], "kind string, digest string").withColumn("completed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(memo_path)
    if last is not None:
        note(None)
    work()
    if digest() == before:
        note(before)
    return True


def pending(items: DataFrame, done: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """Items without a done marker, or whose marker carries another version."""
    if version is None:
        return items.join(done.select(key), key, "left_anti")
    marks = done.select(key, F.col(version).alias("_v"))
    return items.join(marks, key, "left").where(~F.col(version).eqNullSafe(F.col("_v"))).drop("_v")


def batches(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that may see a batch twice: each batch owns its directory, so a repeat replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def versioned_path(root: str, kind: str, digest: str) -> str:
    """Where a derived result of these inputs lives: the same inputs lead to the same place."""
    import hashlib

    return f"{root}/{kind}/{hashlib.sha256(digest.encode()).hexdigest()[:16]}"
