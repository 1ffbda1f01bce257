"""Tables on Parquet: insert, upsert, delete, prune and pointers, each as a rewrite that replaces a directory."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: the new ones whose key is not there yet, each key once (the first by all columns)."""
    fresh = new.join(existing.select(*keys), keys, "left_anti")
    rest = [c for c in new.columns if c not in keys]
    return fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*").select(*new.columns) if rest else fresh.distinct()


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """``existing`` with the rows of ``new``, which win; the columns ``keep`` of rows that were there stay."""
    keep = keep or []
    if not keep:
        return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)
    others = [c for c in existing.columns if c not in keys]
    a = existing.select(*keys, F.struct(*others).alias("a"))
    b = new.select(*keys, F.struct(*[F.col(c) if c in new.columns else F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in others]).alias("b"))
    both = a.join(b, keys, "full")
    pick = lambda c: F.when(F.col("b").isNull() | (F.col("a").isNotNull() & F.lit(c in keep)), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    return both.select(*keys, *[pick(c).alias(c) for c in others]).select(*existing.columns)


def repeated_keys(new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a batch names more than once; such a batch should be refused."""
    return new.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def replace_table(df: DataFrame, path: str) -> None:
    """Put the rows of ``df`` in the place of a table that the plan may read itself.

    The new table is written beside the old one and then takes its name, so a plan that fails leaves the old table as it was.
    Between the two renames the old table is called ``path.old``; :func:`recover` puts it back if the driver is lost there.
    """
    spark = df.sparkSession
    recover(spark, path)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    fs, (at, old, new) = _paths(spark, path, f"{path}.old", staged)
    try:
        df.write.parquet(staged)
    except Exception:
        fs.delete(new, True)
        raise
    if fs.exists(at) and not fs.rename(at, old) or not fs.rename(new, at):
        recover(spark, path)
        raise OSError(f"{path} could not be replaced")
    fs.delete(old, True)
    spark.catalog.refreshByPath(path)


def recover(spark: SparkSession, path: str) -> bool:
    """Put back what a replacement that was cut off had set aside; say whether there was anything."""
    fs, (at, old) = _paths(spark, path, f"{path}.old")
    if not fs.exists(old):
        return False
    if fs.exists(at):  # the new table is in place, only the old one was not cleared
        return fs.delete(old, True)
    return fs.rename(old, at)


def _paths(spark: SparkSession, *names: str) -> tuple:
    paths = [spark._jvm.org.apache.hadoop.fs.Path(n) for n in names]
    return paths[0].getFileSystem(spark._jsc.hadoopConfiguration()), paths


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def create_if_absent(spark: SparkSession, path: str, schema: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        spark.createDataFrame([], schema).write.parquet(path)


def truncate(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def set_pointer(spark: SparkSession, path: str, column: str, value: str) -> None:
    """A one-row table that names the promoted version."""
    spark.createDataFrame([(0, value)], f"slot int, {column} string").coalesce(1).write.mode("overwrite").parquet(path)


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """All tables that have the key column, without the rows of the keys that go."""
    return {n: t.join(gone.select(key), key, "left_anti") if key in t.columns else t for n, t in tables.items()}


def unnamed_objects(objects: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Stored objects that the catalogue does not name."""
    return objects.join(catalog.select(key), key, "left_anti")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; an empty table is refused."""
    if df.limit(1).isEmpty():
        raise ValueError("no rows to write")
    df.write.mode("overwrite").option("header", True).csv(path)
