"""Queries over files that are written first from the given tables, headers, stored objects, layouts and run logs; see queries.py for the analogies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.functions import vectors
from tonelake.operators import evaluation as ev
from tonelake.operators import layout, notes
from tonelake.plans import runlog
from tonelake.queries import query, t
from tonelake.sources import audio, files, headers, records
from tonelake.sources.shared import materialize, new_path

# ---- files and objects ----------------------------------------------------------------------------------------------


@query("SELECT 'source=' || source AS folder, count(*) > 0 AS there, count(*) AS rows FROM documents WHERE source IS NOT NULL GROUP BY 1")
def discovered_files(spark, d):
    """Documents written as text files by source, found again under two roots that overlap, each file once."""
    root, rows = new_path(spark, "collection"), t(spark, d, "documents").where("source is not null")
    rows.select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("line")).repartition("source").write.partitionBy("source").text(root)
    some = spark.read.text(root).select("source").distinct().orderBy("source").limit(1).first()
    found = files.discover(spark, [root, *[f"{root}/source={r}" for r in some or ()]], ("txt",), content=True)
    lines = found.select(F.split("relative_path", "/")[0].alias("folder"), (F.size(F.split(F.decode("content", "UTF-8"), "\n")) - 1).alias("n"))
    return lines.groupBy("folder").agg((F.count("*") > 0).alias("there"), F.sum("n").alias("rows"))


@query("SELECT sha256(p_name) AS hash, min(p_partkey) AS first, count(*) AS holders, min(p_name) AS content FROM part WHERE p_size > 10 GROUP BY 1")
def stored_objects(spark, d):
    """Contents stored by their hash, each once, in two batches, and read again by the hashes that are held."""
    path = new_path(spark, "objects")
    parts = t(spark, d, "part").select("p_partkey", "p_size", F.sha2("p_name", 256).alias("hash"), F.col("p_name").cast("binary").alias("content"))
    audio.store(parts.where("p_size % 2 = 0").select("hash", "content"), spark.createDataFrame([], "hash string, content binary")).write.parquet(path)
    audio.store(parts.select("hash", "content"), spark.read.parquet(path)).write.mode("append").parquet(path)
    held = parts.where("p_size > 10")
    objects = audio.named(spark.read.parquet(path), held).select("hash", F.col("content").cast("string").alias("content"))
    return held.groupBy("hash").agg(F.min("p_partkey").alias("first"), F.count("*").alias("holders")).join(objects, "hash")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 25")
def reachable_slots(spark, d):
    return notes.reachable(t(spark, d, "lineitem"), "l_quantity", 25).select("l_orderkey", "l_linenumber", "l_quantity")


def _bytes(value, size: int, little: bool = False):
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]) if little else digits)


def _raw(text: str):
    return F.lit(text.encode("latin-1"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'wav' WHEN 1 THEN 'aiff' WHEN 2 THEN 'flac' END AS kind, CASE WHEN p_partkey % 4 < 3 THEN 1 + p_size % 2 END::INT AS channels,
    CASE WHEN p_partkey % 4 < 3 THEN 8000 + p_size * 100 END::DOUBLE AS rate, CASE WHEN p_partkey % 4 < 3 THEN 16 END::INT AS bits, CASE WHEN p_partkey % 4 < 3 THEN p_partkey * 1000 + p_size END::BIGINT AS frames,
    CASE WHEN p_partkey % 4 = 3 THEN 'no known kind of file' END AS problem FROM part"""
)
def sound_headers(spark, d):
    """Headers of three kinds of sound files, written from the parts and read again; sizes beyond four bytes are written as RF64 and, for
    AIFF, in a chunk of our own."""
    n, channels, rate, frames = F.col("p_partkey"), 1 + F.col("p_size") % 2, 8000 + F.col("p_size") * 100, F.col("p_partkey") * 1000 + F.col("p_size")
    form = F.concat(_raw("fmt "), _bytes(F.lit(16), 4, True), _bytes(F.lit(1), 2, True), _bytes(channels, 2, True), _bytes(rate, 4, True), _bytes(rate * channels * 2, 4, True), _bytes(channels * 2, 2, True), _bytes(F.lit(16), 2, True))
    most, size = F.lit(2**32 - 1), frames * channels * 2
    long = F.concat(_raw("RF64\xff\xff\xff\xffWAVEds64"), _bytes(F.lit(28), 4, True), _bytes(size + 100, 8, True), _bytes(size, 8, True), _bytes(frames, 8, True), _raw("\0\0\0\0LIST"))
    head = F.when(size < most, _raw("RIFF\0\0\0\0WAVELIST")).otherwise(long)
    wav = F.concat(head, _bytes(F.lit(3), 4, True), _raw("ab\0\0"), form, _raw("data"), _bytes(F.least(size, most), 4, True))
    power = F.floor(F.log2(rate)).cast("long")
    comm = F.concat(_bytes(channels, 2), _bytes(F.least(frames, most), 4), _bytes(F.lit(16), 2), _bytes(power + 16383, 2), _bytes(rate * F.expr("shiftleft(1L, 31)") / F.pow(F.lit(2), power), 4), _bytes(F.lit(0), 4))
    aiff = F.concat(_raw("FORM\0\0\0\0AIFFNAME"), _bytes(F.lit(2), 4), _raw("abCOMM"), _bytes(F.lit(18), 4), comm)
    aiff = F.when(frames < most, aiff).otherwise(F.concat(aiff, _raw("APPL"), _bytes(F.lit(12), 4), _raw(headers.LONG_AIFF), _bytes(frames, 8)))
    packed = rate.cast("long") * F.expr("shiftleft(1L, 44)") + (channels.cast("long") - 1) * F.expr("shiftleft(1L, 41)") + F.expr("15 * shiftleft(1L, 36)") + frames
    flac = F.concat(_raw("fLaC\x80\0\0\x22"), _raw("\0" * 10), _bytes(packed, 8), _raw("\0" * 16))
    content = F.when(n % 4 == 0, wav).when(n % 4 == 1, aiff).when(n % 4 == 2, flac).otherwise(_raw("no sound"))
    # A small table with much work for each row: it is dealt to all cores.
    parts = t(spark, d, "part").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    rows = headers.sounds(materialize(parts.select(n.cast("string").alias("path"), content.alias("content")), "sounds"))
    return rows.select(F.col("path").cast("long").alias("p_partkey"), "kind", "channels", "rate", "bits", "frames", "problem")


@query(
    """SELECT s_suppkey, 'mod' AS kind, s_name AS title, len(range(1 + s_suppkey % 5))::INT AS n_orders, i::INT AS slot, 'sample ' || i AS name, 2 * ((s_suppkey * i) % 5000) AS length, ((s_suppkey + i) % 65)::INT AS volume
    FROM supplier, unnest(range(1, 32)) AS u(i) WHERE (s_suppkey * i) % 5000 > 0"""
)
def module_samples(spark, d):
    """Modules written from the suppliers, 31 samples each, read again as a row for each sample that has any length."""
    n = F.col("s_suppkey")
    zeros = lambda text, size: F.concat(text.cast("binary"), F.unhex(F.repeat(F.lit("00"), F.lit(size) - F.octet_length(text))))
    slots = [F.concat(zeros(F.lit(f"sample {i}"), 22), _bytes((n * i) % 5000, 2), _raw("\0"), _bytes((n + i) % 65, 1), _raw("\0\0\0\1")) for i in range(1, 32)]
    content = F.concat(zeros(F.col("s_name"), 20), *slots, _bytes(1 + n % 5, 1), _raw("\x7f" + "\0" * 128 + "M.K."))
    rows = headers.modules(materialize(t(spark, d, "supplier").select(n.cast("string").alias("path"), content.alias("content")), "modules"))
    rows = rows.select(F.col("path").cast("long").alias("s_suppkey"), "kind", "title", F.size("orders").alias("n_orders"), F.explode("samples").alias("s"))
    return rows.where("s.length > 0").select("s_suppkey", "kind", "title", "n_orders", "s.slot", "s.name", "s.length", "s.volume")


@query("SELECT vec_id, embedding[1] AS first, embedding[64] AS last, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def fixed_records(spark, d):
    """Vectors written as records of one length, as grids of eight by eight, and read again by byte ranges."""
    path = new_path(spark, "records")
    records.write_records(t(spark, d, "embeddings"), path, "vec_id", "embedding", (8, 8))
    rows = records.read_records(spark, path, (8, 8))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return rows.select(F.col("key").alias("vec_id"), F.col("values")[0].alias("first"), F.col("values")[63].alias("last"), F.round(total, 6).alias("total"))


# ---- layouts from distances -----------------------------------------------------------------------------------------


def _distances(spark, d, dimensions: int):
    """(landmark, item, distance): the landmarks that a layout takes of every twentieth vector, to all of them."""
    e = t(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, dimensions).alias("v"))
    names = layout.landmarks_of(e.where("vec_id % 20 = 0 and v is not null"), "vec_id")
    return layout.distances_to(e, "vec_id", "v", names)


@query("SELECT a.vec_id AS landmark, b.vec_id AS item, round(sqrt(pow(a.embedding[1]::DOUBLE - b.embedding[1]::DOUBLE, 2) + pow(a.embedding[2]::DOUBLE - b.embedding[2]::DOUBLE, 2)), 5) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0")
def layout_of_a_plane(spark, d):
    """Distances on a plane, placed from the distances alone, give the distances back."""
    at = materialize(layout.landmark_layout(_distances(spark, d, 2)), "layout")
    a, b = at.where("item % 20 = 0").select(F.col("item").alias("landmark"), F.col("x").alias("px"), F.col("y").alias("py")), at.select("item", "x", "y")
    across, up = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    return ev.against(a, b).select("landmark", "item", F.round(F.sqrt(across * across + up * up), 5).alias("distance"))


@query(None)
def layout_preservation(spark, d):
    """How well a plane keeps the distances of the whole vectors: tests hold it against NumPy on points of their own."""
    at = materialize(layout.landmark_layout(_distances(spark, d, 64)), "layout")
    items = t(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.slice("embedding", 1, 64).alias("v"))
    out = layout.preservation_of_vectors(items, at, F.col("item") % 20 == 0)
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


# ---- the log of a run -----------------------------------------------------------------------------------------------


@query(
    """WITH a AS (SELECT * FROM lineitem WHERE l_quantity > 20), b AS (SELECT l_partkey, sum(l_quantity) AS l_quantity FROM a GROUP BY 1), c AS (SELECT * FROM b WHERE l_quantity > 100)
    SELECT 0 AS number, 'large lines' AS stage, count(*) AS rows, sum(l_quantity)::DOUBLE AS quantity FROM a UNION ALL SELECT 1, 'by part', count(*), sum(l_quantity)::DOUBLE FROM b UNION ALL SELECT 2, 'much used', count(*), sum(l_quantity)::DOUBLE FROM c"""
)
def run_log(spark, d):
    """The lines that three stages over the order lines leave behind."""
    stages = [
        ("large lines", lambda df: df.where("l_quantity > 20")),
        ("by part", lambda df: df.groupBy("l_partkey").agg(F.sum("l_quantity").alias("l_quantity"))),
        ("much used", lambda df: df.where("l_quantity > 100")),
    ]
    path = new_path(spark, "log")
    runlog.run(t(spark, d, "lineitem"), stages, path, "lines", {"quantity": F.sum("l_quantity")})
    return runlog.lines(spark, path).select("number", "stage", "rows", F.col("marks")["quantity"].alias("quantity"))
