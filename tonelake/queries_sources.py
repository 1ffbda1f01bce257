"""Queries over files, table rewrites, passes and the functions that need no other table; see queries.py for the analogies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.functions import labels
from tonelake.operators import publish, waveforms
from tonelake.operators import relational as rel
from tonelake.plans import incremental
from tonelake.queries import query, t
from tonelake.queries_vectors import WAVES, wave_frames
from tonelake.sources import files
from tonelake.sources import tables as tab
from tonelake.sources.shared import new_path

# ---- readers and writers --------------------------------------------------------------------------------------------


@query("SELECT * FROM nation")
def csv_round_trip(spark, d):
    nation, path = t(spark, d, "nation"), new_path(spark, "csv")
    tab.write_csv(nation, path)
    return spark.read.schema(nation.schema).option("header", True).csv(path)


@query("SELECT doc_id, quality, toxic FROM labels")
def annotations_round_trip(spark, d):
    rows, path = t(spark, d, "labels").select("doc_id", "quality", "toxic"), new_path(spark, "annotations")
    files.write_annotations(rows, path, ["doc_id"])
    return files.read_annotations(spark, path, ", ".join(f"{c} {k}" for c, k in rows.dtypes))


LOCATION = "CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 11 < 2 THEN concat('p', page_id - page_id % 11) ELSE concat('p', page_id) END"
LINK = "CASE WHEN page_id % 5 = 0 THEN 'no address' ELSE url END"
LINKS = f"WITH r AS (SELECT {LOCATION} AS location, {LINK} AS link FROM pages), n AS (SELECT *, count(*) OVER (PARTITION BY location) AS n FROM r), p AS (SELECT location, link, CASE WHEN location = '' THEN 'no location' WHEN link = 'no address' THEN 'no web address' WHEN n > 1 THEN 'location twice' END AS reason FROM n)"


def _links(spark, d):
    path = new_path(spark, "links")
    t(spark, d, "pages").select(F.expr(LOCATION).alias("location"), F.expr(LINK).alias("link")).write.option("header", True).csv(path)
    return files.read_links(spark, path)


@query(f"{LINKS} SELECT location, link FROM p WHERE reason IS NULL")
def links_read(spark, d):
    return _links(spark, d)[0]


@query(f"{LINKS} SELECT location, link, reason FROM p WHERE reason IS NOT NULL")
def link_problems(spark, d):
    return _links(spark, d)[1]


@query("SELECT p_name AS entry, min(p_partkey)::INT AS place FROM part GROUP BY 1")
def vocabulary_file(spark, d):
    path, note = new_path(spark, "vocabulary"), F.when(F.col("p_partkey") % 10 == 0, " # a note").otherwise("  ")
    t(spark, d, "part").orderBy("p_partkey").select(F.concat("p_name", note)).coalesce(1).write.text(path)
    return files.read_vocabulary(spark, path)


# ---- what is there, what is gone ------------------------------------------------------------------------------------


@query("SELECT doc_id::VARCHAR AS relative_path FROM documents WHERE doc_id % 5 <> 0")
def unchanged_files(spark, d):
    catalog = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("relative_path"), F.col("n_chars").alias("length"), (F.col("doc_id") % 7).alias("modificationTime"))
    present = catalog.withColumn("length", F.col("length") + F.when(F.col("relative_path").cast("long") % 5 == 0, 1).otherwise(0))
    return files.unchanged(catalog, present).select("relative_path")


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 48 UNION SELECT p_partkey FROM part WHERE p_size > 40")
def readable_keys(spark, d):
    held = t(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("k"))
    return files.readable(held, t(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("k")), "k")


@query("SELECT p_partkey, p_name FROM part WHERE p_size >= 40")
def gone_items(spark, d):
    parts = t(spark, d, "part")
    return files.gone(parts.select("p_partkey", "p_name"), parts.where("p_size < 40"), "p_partkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unnamed_objects(spark, d):
    return tab.unnamed_objects(t(spark, d, "part").select("p_partkey"), t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size > 25 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def members_in_both(spark, d):
    used = t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return t(spark, d, "part").where("p_size > 25").select("p_partkey").intersect(used)


@query("SELECT count(*) > 0 AS some, false AS none FROM part")
def any_row(spark, d):
    parts = t(spark, d, "part")
    return spark.createDataFrame([(publish.any_row(parts), publish.any_row(parts.where("p_size > 1000000")))], "some boolean, none boolean")


# ---- table rewrites and passes --------------------------------------------------------------------------------------


@query("SELECT 'created' AS step, 0::BIGINT AS n UNION ALL SELECT 'appended', 2 * count(*) FROM region UNION ALL SELECT 'replaced', count(*) FROM region WHERE r_regionkey > 1 UNION ALL SELECT 'truncated', 0")
def table_rewrites(spark, d):
    region, path, steps = t(spark, d, "region"), new_path(spark, "rewrites"), []
    now = lambda: spark.read.parquet(path)
    tab.create_if_absent(spark, path, ", ".join(f"{c} {k}" for c, k in region.dtypes))
    steps.append(("created", now().count()))
    tab.append(region, path)
    tab.append(region, path)
    tab.create_if_absent(spark, path, "other int")
    steps.append(("appended", now().count()))
    tab.replace_table(now().where("r_regionkey > 1").distinct(), path)
    steps.append(("replaced", now().count()))
    tab.truncate(spark, path)
    steps.append(("truncated", now().count()))
    return spark.createDataFrame(steps, "step string, n long")


@query("SELECT n_nationkey, 0 AS batch FROM nation UNION ALL SELECT n_nationkey + 100, 1 FROM nation")
def batch_sink(spark, d):
    """A batch that arrives twice, with repeated rows, is there once."""
    nation, path = t(spark, d, "nation").select("n_nationkey"), new_path(spark, "batches")
    sink = incremental.batches(path, "n_nationkey")
    for batch, number in ((nation, 0), (nation.union(nation), 0), (nation.select((F.col("n_nationkey") + 100).alias("n_nationkey")), 1)):
        sink(batch, number)
    return spark.read.parquet(path)


@query("SELECT true AS first, false AS again, true AS changed, 2::BIGINT AS ran")
def pass_memo(spark, d):
    region, path, ran = t(spark, d, "region"), new_path(spark, "memo"), []
    run = lambda df: incremental.run_if_changed(spark, path, "pass", lambda: incremental.input_digest(df, "r_regionkey", "r_name"), lambda: ran.append(1))
    out = [run(region), run(region), run(region.where("r_regionkey > 0"))]
    return spark.createDataFrame([(*out, len(ran))], "first boolean, again boolean, changed boolean, ran long")


@query("SELECT 'derived/fold/' || substr(sha256(count(*)::VARCHAR || ' rows'), 1, 16) AS path FROM nation")
def derived_path(spark, d):
    return spark.createDataFrame([(incremental.versioned_path("derived", "fold", f"{t(spark, d, 'nation').count()} rows"),)], "path string")


# ---- joins and summaries --------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def complete_join(spark, d):
    names = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return rel.complete_join(t(spark, d, "orders").select("o_orderkey", "o_custkey"), names, "o_custkey").select("o_orderkey", "c_name")


@query("SELECT count(*) AS n, sum(l_quantity)::DOUBLE AS quantity, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem")
def summary_of_shares(spark, d):
    rows = t(spark, d, "lineitem")
    share = lambda flag: rows.where(F.col("l_linestatus") == flag).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("quantity"), F.collect_set("l_returnflag").alias("flags"))
    return rel.summed([share("O"), share("F")], ["n", "quantity"], ["flags"]).select("n", "quantity", F.array_join("flags", ",").alias("flags"))


# ---- functions ------------------------------------------------------------------------------------------------------


@query("SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '^(.+)\\.[^.]+$', '\\1') AS stem FROM pages")
def file_stem(spark, d):
    return t(spark, d, "pages").select("page_id", labels.stem(F.col("url")).alias("stem"))


STEP = "concat('a', page_id % 3)"
PLACE = f"CASE page_id % 6 WHEN 0 THEN concat('/', {STEP}) WHEN 1 THEN concat('../', {STEP}) WHEN 2 THEN concat({STEP}, '/./y') WHEN 3 THEN concat({STEP}, '//y') WHEN 4 THEN concat({STEP}, chr(92), 'y') ELSE concat({STEP}, '/y.z') END"


@query(f"SELECT page_id, location, NOT starts_with(location, '/') AND NOT contains(location, chr(92)) AND len(list_filter(string_split(location, '/'), lambda s: s IN ('', '.', '..'))) = 0 AS safe FROM (SELECT page_id, {PLACE} AS location FROM pages)")
def safe_location(spark, d):
    return t(spark, d, "pages").select("page_id", F.expr(PLACE).alias("location")).withColumn("safe", labels.inside_root(F.col("location")))


@query("SELECT p_partkey, upper(p_type) || '|' || upper(p_brand) AS tops, upper(p_type) = 'SMALL' AS small, CASE WHEN upper(p_type) = 'SMALL' THEN upper(p_brand) ELSE upper(p_type) || ', ' || upper(p_brand) END || ', SMALL: NEW' AS tagged FROM part")
def tag_edits(spark, d):
    paths, path = labels.written_paths(F.concat_ws(", ", "p_type", "p_brand")), lambda *steps: F.array(*map(F.lit, steps))
    tops, tagged = F.array_join(labels.top_level(paths), "|"), labels.format_paths(labels.with_tag(paths, path("SMALL", "NEW")))
    return t(spark, d, "part").select("p_partkey", tops.alias("tops"), labels.asserts(paths, path("SMALL")).alias("small"), tagged.alias("tagged"))


@query("SELECT vec_id, round_even(embedding[1]::DOUBLE, 4) AS x, round_even(embedding[2]::DOUBLE, 4) AS y FROM embeddings")
def coordinates_rounded(spark, d):
    at = lambda i: publish.rounded(F.get("embedding", F.lit(i)).cast("double"), 4)
    return t(spark, d, "embeddings").select("vec_id", at(0).alias("x"), at(1).alias("y"))


@query(f"SELECT user_id, round(list_sum(list_transform(r, lambda x: abs(x / greatest(peak, 1e-9) - list_avg(r) / greatest(peak, 1e-9)))), 6) AS total FROM ({WAVES})")
def wave_without_constant(spark, d):
    return waveforms.centred(wave_frames(spark, d), "user_id").groupBy("user_id").agg(F.round(F.sum(F.abs("x")), 6).alias("total"))


def _points(n, m):
    """SQL for the points of a wave ``r`` of ``n`` samples at ``m`` even fractions, linear between samples."""
    at = f"(k * (n - 1)::DOUBLE / greatest({m} - 1, 1))"
    return f"SELECT user_id, k::INT AS point, {m} AS frames, (r[floor({at})::INT + 1] + ({at} - floor({at})) * (r[least(floor({at})::INT + 2, n)] - r[floor({at})::INT + 1])) / greatest(peak, 1e-9) AS value FROM ({n}), unnest(range({m})) AS u(k)"


@query(f"SELECT user_id, point, round(value, 6) AS value FROM ({_points(WAVES, 16)})")
def wave_at_points(spark, d):
    rows = waveforms.at_points(wave_frames(spark, d), "user_id", 16)
    return rows.select("user_id", F.col("i").cast("int").alias("point"), F.round("x", 6).alias("value"))


@query(f"SELECT user_id, any_value(frames)::INT AS frames, round(sum(abs(value)), 5) AS total FROM ({_points(WAVES, 'greatest(1, round_even(n / 2, 0)::INT)')}) GROUP BY 1")
def wave_an_octave_up(spark, d):
    rows = waveforms.tuned(wave_frames(spark, d), "user_id", 12.0)
    return rows.groupBy("user_id").agg(F.count("*").cast("int").alias("frames"), F.round(F.sum(F.abs("x")), 5).alias("total"))


@query(f"SELECT user_id, round(list_sum(list_transform(r, lambda x: greatest(-128, least(127, round_even(x / greatest(peak, 1e-9) * 128, 0))) / 128)), 6) AS total FROM ({WAVES})")
def wave_in_eight_bits(spark, d):
    return waveforms.in_bits(wave_frames(spark, d), "user_id", 8).groupBy("user_id").agg(F.round(F.sum("x"), 6).alias("total"))
