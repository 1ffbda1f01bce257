"""File discovery and readers for links, annotations and vocabularies."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonelake.functions import labels

MODULES = ("xm", "it", "mod", "s3m")
SOUNDS = ("wav", "aif", "aiff", "flac")


def discover(spark: SparkSession, root: str | list[str], suffixes: tuple[str, ...], exclude: tuple[str, ...] = (), content: bool = False) -> DataFrame:
    """``(path, relative_path, length, modificationTime[, content])`` of the files under the roots, recursively.

    A file that several roots reach (one lies in another, or is named twice) is listed once, relative to the first of
    them. Suffixes compare case-folded; names that start with a dot and files that match an exclusion, or lie in a folder
    that does, are left out, and so are empty files. Listing reads no contents.
    """
    bases = []
    for r in [root] if isinstance(root, str) else root:
        base = spark._jvm.org.apache.hadoop.fs.Path(r)
        base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
        bases += [base] * (base not in bases)
    tops = [b for b in bases if not any(b.startswith(o + "/") for o in bases)]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(tops)
    own = reduce(lambda rest, b: F.when(F.startswith("path", F.lit(b + "/")), F.substring("path", len(b) + 2, 1 << 30)).otherwise(rest), reversed(bases), F.lit(None))
    rows = files.withColumn("relative_path", own)
    rows = rows.where(F.lower("relative_path").rlike(rf"\.({'|'.join(suffixes)})$") & ~F.col("relative_path").rlike(r"(^|/)\.[^/]*$"))
    for pattern in exclude:
        steps = F.split("relative_path", "/")
        folders = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
        rows = rows.where(~F.exists(folders, lambda p: labels.glob(p, pattern)) & ~F.exists(steps, lambda s: labels.glob(s, pattern)))
    return rows.select("path", "relative_path", "length", "modificationTime", *["content"] * content)


def hashed(files: DataFrame) -> DataFrame:
    """``hash``: SHA-256 of each file's bytes (``discover(..., content=True)``)."""
    return files.withColumn("hash", F.sha2("content", 256)).drop("content")


def unchanged(catalog: DataFrame, present: DataFrame, key: str = "relative_path") -> DataFrame:
    """Catalogued files that are still there with the same size and time."""
    on = (F.col(f"c.{key}") == F.col(f"p.{key}")) & (F.col("c.length") == F.col("p.length")) & (F.col("c.modificationTime") == F.col("p.modificationTime"))
    return catalog.alias("c").join(present.alias("p"), on, "left_semi")


def readable(occurrences: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Keys that a module holds or an unchanged file has."""
    return occurrences.select(key).unionByName(files.select(key)).distinct()


def gone(catalog: DataFrame, present: DataFrame, key: str, most: float = 0.5) -> DataFrame:
    """Catalogued files that are no longer present. Refuses where that looks like a failed scan: nothing is present, or
    more than the share ``most`` of the catalogue is missing."""
    n, there = catalog.count(), present.limit(1).count()
    missing = catalog.join(present.select(key), key, "left_anti")
    if n and not there:
        raise ValueError("the scan found nothing; no file is taken for deleted")
    if n and missing.count() > most * n:
        raise ValueError("more files are missing than a change explains; no file is taken for deleted")
    return missing


LINK_COLUMNS = ("location", "link")


class Refused(ValueError):
    """A file that is not read at all."""


def _header(spark: SparkSession, path: str) -> list[str]:
    """The column names in the first line of the CSV files, which have to agree; a byte order mark does not count."""
    at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), "value")
    first = lines.groupBy("file").agg(F.min_by("value", "at").alias("line")).select(F.regexp_replace("line", "^\ufeff", "").alias("line")).distinct()
    found = [r.line for r in first.limit(2).collect()]
    if len(found) != 1:
        raise Refused(f"{path} has no header" if not found else f"the files of {path} have different headers")
    return next(csv.reader(found))


def read_links(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(links, problems)`` from a CSV with the columns location and link: good rows, and every bad one with a reason.

    The columns may stand in any order and among others; a file whose header lacks one is refused as a whole.
    """
    header = _header(spark, path)
    missing = [c for c in LINK_COLUMNS if c not in header]
    if missing:
        raise Refused(f"{path} has no column {' and no column '.join(missing)}")
    names = [c if c in LINK_COLUMNS and header.index(c) == i else f"_{i}" for i, c in enumerate(header)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_bad"]])
    # pruned columns would hide a row of the wrong length
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    rows = reader.option("columnPruning", False).csv(path)
    rows = rows.select(F.coalesce(labels.strip(F.col("location")), F.lit("")).alias("location"), labels.strip(F.col("link")).alias("link"), "_bad")
    twice = rows.groupBy("location").agg(F.count("*").alias("n")).where("n > 1").select("location", F.lit(True).alias("_twice"))
    rows = rows.join(twice, "location", "left")
    reason = F.when(F.col("_bad").isNotNull(), f"not {len(names)} columns" if len(names) != 2 else "not two columns").when(F.col("location") == "", "no location").when(~F.coalesce(labels.page_url(F.col("link")), F.lit(False)), "no web address").when(F.col("_twice"), "location twice")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").select("location", "link"), rows.where("reason is not null").select("location", "link", "reason")


def read_annotations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Annotations from JSON lines. A line that does not fit the schema, names a key twice or one that the schema does not
    know fails the read with the line's beginning; blank lines are none."""
    kind = T.StructType.fromDDL(schema)
    lines = spark.read.option("lineSep", "\n").text(path).where(F.trim("value") != "")
    keys = F.json_object_keys("value")
    names = F.array(*[F.lit(f.name) for f in kind.fields])
    bad = F.when(keys.isNull(), "is no JSON object").when(F.size(keys) > F.size(F.array_distinct(keys)), "names a key twice").when(F.size(F.array_except(keys, names)) > 0, "names an unknown key")
    checked = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("a line "), bad, F.lit(": "), F.substring("value", 1, 100)))).otherwise(F.col("value"))
    return lines.select(F.from_json(checked.cast("string"), kind, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def write_annotations(df: DataFrame, path: str, order: list[str]) -> None:
    df.orderBy(*order).write.mode("overwrite").json(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(place, entry)``: lines without comments and blanks, each entry once, in first-seen order (a driver-sized file)."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("place", "line"))
    entry = labels.strip(F.regexp_replace("line", "#.*$", ""))
    return lines.select("place", entry.alias("entry")).where("entry <> ''").groupBy("entry").agg(F.min("place").alias("place")).select("place", "entry")


def all_text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
