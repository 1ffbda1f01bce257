"""Named queries over the driver's tables, each with the SQL that gives the same rows.

The tables hold no sounds, so each operator runs on the nearest table: ``part`` stands for the catalogued item,
``orders`` for what contains items, ``lineitem`` for an item's occurrence, ``events`` for usage and for a change log,
``embeddings`` for feature vectors, ``p_name`` for a label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions import hashing, labels, pitch, vectors
from tonelake.operators import aggregates as agg
from tonelake.operators import history, publish
from tonelake.operators import relational as rel
from tonelake.plans.ranks import numbered
from tonelake.sources import tables as tab

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- listing, joins -------------------------------------------------------------------------------------------------

PART_COUNTS = "SELECT p.*, coalesce(n, 0) AS occurrences FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) c ON p_partkey = l_partkey"


def _counted(spark, d):
    parts = t(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return rel.with_counts(parts, t(spark, d, "lineitem"), "p_partkey", "l_partkey")


@query(f"SELECT p_partkey, p_name, occurrences FROM ({PART_COUNTS}) ORDER BY occurrences DESC, p_partkey LIMIT 50 OFFSET 100")
def page_by_occurrences(spark, d):
    return rel.page(_counted(spark, d), [F.desc("occurrences"), F.asc("p_partkey")], 50, 100).select("p_partkey", "p_name", "occurrences")


RATING = "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_partkey % 5 + 1 AS INT) END"


@query(f"SELECT p_partkey, occurrences, rating FROM (SELECT *, {RATING} AS rating FROM ({PART_COUNTS})) ORDER BY rating DESC NULLS LAST, occurrences DESC, p_partkey LIMIT 60 OFFSET 20")
def page_by_rating_nulls_last(spark, d):
    rows = _counted(spark, d).withColumn("rating", F.expr(RATING))
    return rel.page(rows, [F.col("rating").desc_nulls_last(), F.desc("occurrences"), F.asc("p_partkey")], 60, 20).select("p_partkey", "occurrences", "rating")


@query(f"SELECT count(*) AS n, min(rating) AS lowest, sum(occurrences)::BIGINT AS occurrences FROM (SELECT *, {RATING} AS rating FROM ({PART_COUNTS})) WHERE rating >= 3 AND p_size BETWEEN 10 AND 30")
def filtered_count(spark, d):
    rows = _counted(spark, d).withColumn("rating", F.expr(RATING))
    kept = rel.where_given(rows, least=F.col("rating") >= 3, size=F.col("p_size").between(10, 30), name=None)
    return kept.agg(F.count("*").alias("n"), F.min("rating").alias("lowest"), F.sum("occurrences").alias("occurrences"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 77")
def point_lookup(spark, d):
    return t(spark, d, "customer").where("c_custkey = 77").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def batched_lookup(spark, d):
    keys = t(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return rel.lookup(t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), keys, "o_custkey").drop("o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 OR o_orderkey = 7")
def either_column(spark, d):
    return rel.either(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", 7)


@query("SELECT l_partkey, p_size AS rate, CAST(l_quantity AS INT) AS note, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N' GROUP BY ALL")
def usage_by_key_rate_note(spark, d):
    lines = t(spark, d, "lineitem").where("l_returnflag <> 'N'").select("l_partkey", F.col("l_quantity").cast("int").alias("note"))
    parts = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("rate"))
    return lines.join(parts, "l_partkey").groupBy("l_partkey", "rate", "note").agg(F.count("*").alias("n"))


@query("SELECT r_name, n_name, c_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
def three_way_join(spark, d):
    r, n, c = (t(spark, d, x) for x in ("region", "nation", "customer"))
    return c.where("c_acctbal > 9000").join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("r_name", "n_name", "c_name")


@query("SELECT r_name AS name, kind FROM region, unnest(['read', 'write', 'drop']) AS k(kind) WHERE NOT (kind = 'drop' AND r_name LIKE 'A%')")
def roles_by_privileges(spark, d):
    roles = t(spark, d, "region").select(F.col("r_name").alias("name"))
    return rel.privileges(roles, ["read", "write", "drop"], ~((F.col("kind") == "drop") & F.col("name").startswith("A")))


@query(
    "SELECT p_partkey, p_type, p_size, p_brand, p_retailprice FROM (SELECT p_partkey, p_type, p_size FROM part) b LEFT JOIN (SELECT p_partkey AS k, p_brand FROM part WHERE p_size > 10) x ON k = p_partkey AND p_type = (SELECT min(p_type) FROM part) LEFT JOIN (SELECT p_partkey AS k2, p_retailprice FROM part) y ON k2 = p_partkey AND p_type = (SELECT max(p_type) FROM part) WHERE (p_type = (SELECT min(p_type) FROM part) AND p_brand IS NOT NULL) OR (p_type = (SELECT max(p_type) FROM part))"
)
def subtype_union(spark, d):
    part = t(spark, d, "part")
    first, last = part.agg(F.min("p_type"), F.max("p_type")).first()
    base = part.select("p_partkey", "p_type", "p_size")
    kinds = {first: (part.where("p_size > 10").select("p_partkey", "p_brand"), ["p_partkey"]), last: (part.select("p_partkey", "p_retailprice"), ["p_partkey"])}
    return rel.subtype_union(base, "p_type", kinds)


DEAR = "o_totalprice > 400000"


@query(f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {DEAR}) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")
def orphans_anti(spark, d):
    return rel.orphans(t(spark, d, "customer").select("c_custkey"), "c_custkey", (t(spark, d, "orders").where(DEAR), "o_custkey"), (t(spark, d, "supplier"), "s_suppkey"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")
def holders_semi(spark, d):
    return rel.held(t(spark, d, "customer").select("c_custkey"), "c_custkey", (t(spark, d, "orders"), "o_custkey"), (t(spark, d, "supplier"), "s_suppkey"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def in_subquery_semi(spark, d):
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts, sups = t(spark, d, "part").where("p_size = 1"), t(spark, d, "supplier").where("s_acctbal < 0")
    return lines.join(parts, lines.l_partkey == parts.p_partkey, "left_semi").join(sups, lines.l_suppkey == sups.s_suppkey, "left_semi").drop("l_suppkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = (SELECT max(o_orderpriority) FROM orders) AND o_totalprice > 400000")
def promoted_version(spark, d):
    orders = t(spark, d, "orders")
    pointer = orders.agg(F.max("o_orderpriority").alias("o_orderpriority"))
    return rel.pointed(orders.where("o_totalprice > 400000").select("o_orderkey", "o_orderpriority"), pointer, "o_orderpriority")


# ---- aggregates -----------------------------------------------------------------------------------------------------


@query("SELECT (SELECT count(*) FROM part) AS items, (SELECT count(*) FROM orders) AS containers, (SELECT count(*) FROM lineitem) AS occurrences, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS used, (SELECT count(*) FROM events) AS events, (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT sum(p_size)::BIGINT FROM part) AS size")
def library_stats(spark, d):
    one = lambda name, *a: t(spark, d, name).agg(*a)
    parts = [
        one("part", F.count("*").alias("items"), F.sum("p_size").alias("size")), one("orders", F.count("*").alias("containers")),
        one("lineitem", F.count("*").alias("occurrences"), F.countDistinct("l_partkey").alias("used")), one("events", F.count("*").alias("events"), F.countDistinct("user_id").alias("users")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@query("SELECT p_size % 2 AS depth, p_type AS layout, count(*) AS n, sum(p_size)::BIGINT AS frames, sum(p_size * (1 + p_size % 2) * 2)::BIGINT AS bytes FROM part GROUP BY ALL")
def stored_totals(spark, d):
    rows = t(spark, d, "part").withColumn("bytes", F.col("p_size") * (1 + F.col("p_size") % 2) * 2)
    return rows.groupBy((F.col("p_size") % 2).alias("depth"), F.col("p_type").alias("layout")).agg(F.count("*").alias("n"), F.sum("p_size").alias("frames"), F.sum("bytes").alias("bytes"))


@query("SELECT l_partkey, count(*) AS events, count(DISTINCT l_quantity::INT) AS notes, min(l_quantity::INT) AS lowest, max(l_quantity::INT) AS highest, max(l_quantity::INT) - min(l_quantity::INT) AS span FROM lineitem GROUP BY 1")
def note_statistics(spark, d):
    rows = t(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").cast("int").alias("note"))
    return agg.note_statistics(rows, "l_partkey", "note")


@query("SELECT o_custkey, o_orderpriority AS dominant FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn FROM orders GROUP BY 1, 2) WHERE rn = 1")
def dominant_value(spark, d):
    return agg.dominant(t(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query(
    "WITH u AS (SELECT l_partkey AS key, l_returnflag AS value FROM lineitem UNION ALL SELECT p_partkey, substr(p_brand, length(p_brand), 1) FROM part), c AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, value) AS rn FROM u GROUP BY 1, 2) SELECT key, value AS dominant FROM c WHERE rn = 1"
)
def dominant_of_two_sources(spark, d):
    part = t(spark, d, "part").withColumn("mark", F.expr("substr(p_brand, length(p_brand), 1)"))
    return agg.dominant_of_sources([(t(spark, d, "lineitem"), "l_partkey", "l_returnflag"), (part, "p_partkey", "mark")])


USAGE = "SELECT l_partkey, 100 + l_partkey % 9000 AS rate, l_quantity::INT AS note FROM lineitem"
FOLDED = f"SELECT l_partkey, round_even(rate * pow(2.0, (note - 60) / 12.0), 0)::BIGINT AS hz, sum(n)::BIGINT AS events FROM (SELECT l_partkey, rate, note, count(*) AS n FROM ({USAGE}) GROUP BY ALL) WHERE round_even(rate * pow(2.0, (note - 60) / 12.0), 0) >= 1 GROUP BY 1, 2"
RATES = f"SELECT l_partkey, hz FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY events DESC, hz) AS rn FROM ({FOLDED})) WHERE rn = 1"


def _folded(spark, d):
    usage = t(spark, d, "lineitem").select("l_partkey", (100 + F.col("l_partkey") % 9000).alias("rate"), F.col("l_quantity").cast("int").alias("note"))
    return agg.fold_rates(usage, "l_partkey", "rate", "note")


@query(FOLDED)
def rate_folding(spark, d):
    return _folded(spark, d)


@query(RATES)
def dominant_rate(spark, d):
    return agg.dominant_rate(_folded(spark, d), "l_partkey")


@query(f"SELECT coalesce(a.key, b.key) AS key, coalesce(a.hz, b.hz) AS hz FROM (SELECT l_partkey AS key, hz FROM ({RATES}) WHERE l_partkey % 3 = 0) a FULL JOIN (SELECT p_partkey AS key, 1000 + p_size::BIGINT AS hz FROM part) b ON a.key = b.key")
def dominant_with_fallback(spark, d):
    played = agg.dominant_rate(_folded(spark, d).where("l_partkey % 3 = 0"), "l_partkey").withColumnRenamed("l_partkey", "key")
    declared = t(spark, d, "part").select(F.col("p_partkey").alias("key"), (1000 + F.col("p_size")).cast("long").alias("hz"))
    return agg.with_fallback(played, declared, "key", "hz")


@query(f"SELECT hz, events FROM ({FOLDED}) WHERE l_partkey = 42 ORDER BY events DESC, hz")
def rates_of_one_item(spark, d):
    usage = t(spark, d, "lineitem").where("l_partkey = 42").select("l_partkey", (100 + F.col("l_partkey") % 9000).alias("rate"), F.col("l_quantity").cast("int").alias("note"))
    return agg.fold_rates(usage, "l_partkey", "rate", "note").select("hz", "events").orderBy(F.desc("events"), "hz")


@query("SELECT count(*) AS n, max(ts) AS newest FROM events")
def revision_count_max(spark, d):
    return t(spark, d, "events").agg(F.count("*").alias("n"), F.max("ts").alias("newest"))


@query("SELECT count(*) AS n, CAST(sum(('0x' || substr(md5(concat_ws('|', event_id, user_id, event_type)), 1, 15))::BIGINT) AS VARCHAR) AS mark FROM events")
def revision_count_hash(spark, d):
    return hashing.revision(t(spark, d, "events"), "event_id", "user_id", "event_type")


@query("SELECT sha256(string_agg('[\"' || n_nationkey || '\",\"' || n_name || '\"]' || chr(10), '' ORDER BY n_nationkey)) AS digest FROM nation")
def ordered_digest(spark, d):
    return hashing.ordered_digest(t(spark, d, "nation"), "n_nationkey", hashing.row_line(F.col("n_nationkey"), F.col("n_name")), parts=1)


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_pairs(spark, d):
    return t(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states FROM orders GROUP BY 1")
def collected_sets(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("states"))


@query("SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1")
def collected_lists(spark, d):
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("r"))
    return rows.select("l_orderkey", F.array_join(F.transform("r", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("SELECT p_brand, round(CASE WHEN sum(p_size - 1) <> 0 THEN sum(p_retailprice * (p_size - 1)) / sum(p_size - 1) ELSE avg(p_retailprice) END, 4) AS mean FROM part GROUP BY 1")
def weighted_mean(spark, d):
    rows = t(spark, d, "part").withColumn("w", F.col("p_size") - 1)
    return agg.weighted_mean(rows, "p_brand", "p_retailprice", "w").withColumn("mean", F.round("mean", 4))


@query("SELECT round(min(CASE WHEN toxic = 0 THEN doc_id + 5000 END) - max(CASE WHEN toxic <> 0 THEN doc_id END), 3)::BIGINT AS gap FROM labels")
def separation_gap(spark, d):
    rows = t(spark, d, "labels").withColumn("score", F.col("doc_id") + F.when(F.col("toxic") == 0, 5000).otherwise(0))
    return agg.separation_gap(rows, "score", F.col("toxic") == 0)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 12")
def marginal_relations(spark, d):
    return agg.marginal(t(spark, d, "orders"), F.col("o_orderstatus") == "F", "o_totalprice", "o_orderkey", 12).select("o_orderkey", "o_totalprice")


@query("SELECT cx, cy, count(*) AS n, sum(label)::BIGINT AS total FROM (SELECT floor((embedding[1]::DOUBLE + 0.3) / (0.6 / 12))::INT AS cx, floor((embedding[2]::DOUBLE + 0.3) / (0.6 / 12))::INT AS cy, label FROM embeddings) WHERE cx BETWEEN 0 AND 11 AND cy BETWEEN 0 AND 11 GROUP BY 1, 2")
def density_grid(spark, d):
    e = t(spark, d, "embeddings")
    x, y = F.get("embedding", F.lit(0)).cast("double"), F.get("embedding", F.lit(1)).cast("double")
    return agg.density_grid(e, x, y, 12, -0.3, 0.3, F.col("label"))


@query("SELECT count(*) AS n FROM (SELECT 1 FROM embeddings WHERE embedding[1] BETWEEN 0 AND 0.1 AND embedding[2] BETWEEN 0 AND 0.1 LIMIT 31)")
def count_in_box(spark, d):
    inside = F.get("embedding", F.lit(0)).between(0, 0.1) & F.get("embedding", F.lit(1)).between(0, 0.1)
    return agg.count_in_box(t(spark, d, "embeddings"), inside, 30)


@query("SELECT vec_id, round(sqrt(d2), 9) AS distance FROM (SELECT vec_id, pow(embedding[1]::DOUBLE - 0.05, 2) + pow(embedding[2]::DOUBLE - 0.05, 2) AS d2 FROM embeddings) WHERE d2 <= 0.04 ORDER BY d2, vec_id LIMIT 1")
def nearest_point(spark, d):
    x, y = F.get("embedding", F.lit(0)).cast("double"), F.get("embedding", F.lit(1)).cast("double")
    return agg.nearest_point(t(spark, d, "embeddings"), "vec_id", x, y, (0.05, 0.05), 0.2).withColumn("distance", F.round("distance", 9))


DAILY = "SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2"


def _daily(spark, d):
    return t(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query(
    f"WITH b AS ({DAILY}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i, count(*) OVER (PARTITION BY user_id) AS c FROM b), k AS (SELECT unnest(range(-2, 3)) AS k) SELECT r.user_id, r.day, round(sum(o.n) / 5.0, 6) AS blurred FROM r, k JOIN r o ON o.user_id = r.user_id AND o.i = least(greatest(r.i + k.k, 1), r.c) GROUP BY 1, 2"
)
def box_blur(spark, d):
    return agg.box_blur(_daily(spark, d), "user_id", "day", "n", 2).select("user_id", "day", F.round("blurred", 6).alias("blurred"))


@query(
    f"WITH b AS ({DAILY}), u AS (SELECT *, n - coalesce(lag(n, 2) OVER w, 0) >= 3 AS up FROM b WINDOW w AS (PARTITION BY user_id ORDER BY day)) SELECT user_id, day, n FROM (SELECT *, coalesce(lag(up) OVER (PARTITION BY user_id ORDER BY day), false) AS before FROM u) WHERE up AND NOT before"
)
def strike_segments(spark, d):
    rows = _daily(spark, d).withColumn("level", F.col("n").cast("double"))
    return agg.strikes(rows, "user_id", "day", "level", 2, 3.0).select("user_id", "day", "n")


@query(f"SELECT user_id, day, round(sum(n) OVER (PARTITION BY user_id ORDER BY day) / sum(n) OVER (PARTITION BY user_id), 9) AS share FROM ({DAILY})")
def quantile_map(spark, d):
    return agg.quantile_map(_daily(spark, d), "user_id", "n", "day").select("user_id", "day", F.round("share", 9).alias("share"))


# ---- labels and names -----------------------------------------------------------------------------------------------

LABEL = "upper(p_type) || ': ' || replace(p_name, ' ', ': ') || ', ' || p_brand"
PATHS = f"SELECT p_partkey, upper(p_type) AS a, upper(p_type) || ': ' || upper(split_part(p_name, ' ', 1)) AS b, upper(p_type) || ': ' || upper(replace(p_name, ' ', ': ')) AS c, upper(p_brand) AS e FROM part"
CLOSED = f"SELECT DISTINCT p_partkey, path FROM (SELECT p_partkey, unnest([a, b, c, e]) AS path FROM ({PATHS}))"


def _labelled(spark, d):
    return t(spark, d, "part").select("p_partkey", "p_name", F.expr(LABEL).alias("label"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim('  ' || p_name || ' #' || p_brand || '!  ')), '[^a-z0-9 _-]', '', 'g'), ' +', ' ', 'g')) AS name FROM part")
def sanitize_names(spark, d):
    rows = t(spark, d, "part").withColumn("raw", F.concat(F.lit("  "), "p_name", F.lit(" #"), "p_brand", F.lit("!  ")))
    return rows.select("p_partkey", labels.sanitize_name(F.col("raw")).alias("name"))


@query(f"SELECT p_partkey, c || ', ' || e AS canonical FROM ({PATHS})")
def canonical_labels(spark, d):
    return _labelled(spark, d).select("p_partkey", labels.canonical_label(F.col("label")).alias("canonical"))


@query(f"SELECT path, len(string_split(path, ': '))::INT AS depth, count(*) AS n FROM ({CLOSED}) GROUP BY 1, 2")
def label_closure_counts(spark, d):
    return agg.closure_counts(_labelled(spark, d), "label")


@query(f"SELECT path, count(*) AS n FROM ({CLOSED}) GROUP BY 1")
def top_level_rollup(spark, d):
    counts = _labelled(spark, d).groupBy("label").agg(F.count("*").alias("c"))
    return agg.rollup_counts(counts, "label", "c")


@query(
    f"WITH k AS ({CLOSED}), s AS (SELECT x.p_partkey AS a, y.p_partkey AS b, count(*) AS shared FROM k x JOIN k y ON x.path = y.path AND x.p_partkey <> y.p_partkey WHERE x.p_partkey % 20 = 0 GROUP BY 1, 2), n AS (SELECT p_partkey, count(*) AS n FROM k GROUP BY 1) SELECT s.a, s.b, round(shared / (na.n + nb.n - shared), 9) AS agreement FROM s JOIN n na ON na.p_partkey = s.a JOIN n nb ON nb.p_partkey = s.b"
)
def label_jaccard(spark, d):
    """Every twentieth item as a query against all items."""
    rows = _labelled(spark, d).select("p_partkey", labels.written_paths(F.col("label")).alias("paths"))
    return rel.label_agreements(rows.where("p_partkey % 20 = 0"), rows, "p_partkey", "paths", 9)


@query(f"SELECT path, row_number() OVER (ORDER BY min(p_partkey), path)::INT AS rank FROM ({CLOSED}) GROUP BY path")
def tag_first_use_rank(spark, d):
    uses = _labelled(spark, d).select("p_partkey", F.explode(labels.closure(labels.written_paths(F.col("label")))).alias("p"))
    return rel.rank_first_use(uses.select("p_partkey", labels.format_path(F.col("p")).alias("path")), "path", "p_partkey").withColumn("rank", F.col("rank").cast("int"))


@query(f"WITH c AS (SELECT path, count(*) AS n FROM ({CLOSED}) GROUP BY 1), r AS (SELECT path, row_number() OVER (ORDER BY n DESC, path) AS rank FROM c WHERE n > 5) SELECT path, row_number() OVER (ORDER BY rank NULLS LAST, path)::INT AS place FROM c LEFT JOIN r USING (path)")
def vocabulary_ranks(spark, d):
    counts = agg.closure_counts(_labelled(spark, d), "label").select("path", "n")
    recorded = numbered(counts.where("n > 5"), [F.desc("n"), F.col("path")], "rank").select("path", "rank")
    return agg.vocabulary_ranks(counts, "path", recorded).select("path", F.col("place").cast("int").alias("place"))


@query(f"WITH c AS (SELECT path, len(string_split(path, ': ')) AS depth, count(*) AS n FROM ({CLOSED}) GROUP BY 1) SELECT 'used once' AS finding, path AS name FROM c WHERE n = 1 UNION ALL SELECT 'at several depths', name FROM (SELECT list_last(string_split(path, ': ')) AS name, count(DISTINCT depth) AS k FROM c GROUP BY 1) WHERE k > 1")
def vocabulary_findings(spark, d):
    return agg.vocabulary_findings(agg.closure_counts(_labelled(spark, d), "label"))


@query("SELECT p_name AS label, count(*) AS uses FROM part GROUP BY 1 ORDER BY uses DESC, label")
def label_vocabulary(spark, d):
    return agg.label_vocabulary(t(spark, d, "part").withColumnRenamed("p_name", "label"), "label")


@query("SELECT DISTINCT p_name, lower(split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)) || ' sound' AS prompt FROM part")
def prompts(spark, d):
    path = labels.written_paths(F.regexp_replace("p_name", " ", ": "))
    return t(spark, d, "part").select("p_name", labels.prompt(F.element_at(path, 1), "{} sound").alias("prompt")).distinct()


@query("SELECT count(*) AS n, count(*) FILTER (regexp_matches(url, '^https?://[^\\s/?#]+[^\\s]*$')) AS valid, count(*) FILTER (lower(url) LIKE '%.example.com/%') AS matching FROM pages")
def page_urls(spark, d):
    ok, hit = labels.page_url(F.col("url")), labels.glob(F.col("url"), "*.example.com/*")
    return t(spark, d, "pages").agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("valid"), F.sum(hit.cast("long")).alias("matching"))


@query(f"SELECT p_partkey, CASE WHEN c LIKE '%A' THEN c WHEN e LIKE '%1' THEN e END AS slot FROM ({PATHS})")
def first_chosen_tag(spark, d):
    rows = _labelled(spark, d).select("p_partkey", F.transform(labels.written_paths(F.col("label")), labels.format_path).alias("tags"))
    chosen = F.filter("tags", lambda x: x.endswith("A") & x.contains(":") | x.endswith("1") & ~x.contains(":"))
    return rows.select("p_partkey", labels.first_in(F.col("tags"), chosen).alias("slot"))


@query(f"SELECT count(*) AS labelled, sum((p_size > 20)::INT)::BIGINT AS exact, sum((p_size > 20 OR p_size < 5)::INT)::BIGINT AS top_level FROM part")
def category_agreement(spark, d):
    from tonelake.operators import evaluation as ev

    guess = F.when(F.col("p_size") > 20, F.concat(F.upper("p_type"), F.lit(": "), F.expr("split_part(p_name, ' ', 1)"))).when(F.col("p_size") < 5, F.concat(F.upper("p_type"), F.lit(": ELSE"))).otherwise(F.lit("NOTHING: SUCH"))
    rows = t(spark, d, "part").select(F.expr(LABEL).alias("label"), guess.alias("guess"))
    return ev.category_agreement(rows, "guess", "label")


# ---- drawing --------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 45 ORDER BY md5(p_partkey::VARCHAR || 'seed'), p_partkey LIMIT 50")
def reproducible_sample(spark, d):
    return rel.reproducible_sample(t(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", "seed", 50, F.col("p_size").between(5, 45))


@query("SELECT p_partkey, p_type, floor((row_number() OVER (PARTITION BY p_type ORDER BY md5(p_partkey::VARCHAR || 's:3'), p_partkey) - 1) / 4)::INT AS batch FROM part")
def stratified_batches(spark, d):
    return rel.stratified_batches(t(spark, d, "part").select("p_partkey", "p_type"), "p_partkey", "p_type", 4, "s", 3)


@query("SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR || 'h'), 1, 8))::BIGINT < 858993459 AS held FROM labels")
def holdout_split(spark, d):
    return rel.holdout(t(spark, d, "labels").select("doc_id"), "doc_id", "h", 0.2)


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) ORDER BY md5(p_partkey::VARCHAR || 'r'), p_partkey LIMIT 25")
def draw_restricted(spark, d):
    ok = t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return rel.reproducible_sample(rel.lookup(t(spark, d, "part").select("p_partkey"), ok, "p_partkey"), "p_partkey", "r", 25)


# ---- history --------------------------------------------------------------------------------------------------------

OPERATION = "CASE WHEN event_id % 11 = 0 THEN 'delete' ELSE 'update' END"
LOG = f"SELECT user_id, event_id, ts AS recorded_at, event_type, {OPERATION} AS operation FROM events"
STATE = "SELECT DISTINCT ON (user_id) user_id, event_id, event_type, operation FROM ({log}) WHERE recorded_at <= TIMESTAMP '{at}' ORDER BY user_id, event_id DESC"
EARLY, LATE = "2024-01-12 00:00:00", "2024-01-20 00:00:00"


def _log(spark, d):
    return t(spark, d, "events").select("user_id", "event_id", F.col("ts").alias("recorded_at"), "event_type", F.expr(OPERATION).alias("operation"))


def _state(spark, d, moment):
    return history.state_as_of(_log(spark, d), "user_id", ["event_id"], F.lit(moment).cast("timestamp_ntz")).select("user_id", "event_id", "event_type")


def _state_sql(moment):
    return f"SELECT user_id, event_id, event_type FROM ({STATE.format(log=LOG, at=moment)}) WHERE operation <> 'delete'"


@query(_state_sql(EARLY))
def state_as_of(spark, d):
    return _state(spark, d, EARLY)


PAIRED = f"({_state_sql(LATE)}) c FULL JOIN ({_state_sql(EARLY)}) g USING (user_id)"


@query(f"SELECT user_id, CASE WHEN g.event_id IS NULL THEN 'remove' WHEN c.event_id IS NULL OR c.event_type IS DISTINCT FROM g.event_type THEN 'upsert' ELSE 'keep' END AS action, coalesce(g.event_type, c.event_type) AS event_type FROM {PAIRED}")
def restore_diff(spark, d):
    return history.restore_plan(_state(spark, d, LATE), _state(spark, d, EARLY), "user_id", ["event_type"])


@query(
    f"SELECT * FROM (SELECT user_id, CASE WHEN c.event_id IS NULL THEN 'delete' WHEN g.event_id IS NULL THEN 'insert' WHEN c.event_type IS DISTINCT FROM g.event_type THEN 'update' END AS operation, '{{\"event_type\":\"' || g.event_type || '\"}}' AS previous, '{{\"event_type\":\"' || c.event_type || '\"}}' AS current FROM {PAIRED}) WHERE operation IS NOT NULL"
)
def change_capture(spark, d):
    return history.capture_changes(_state(spark, d, EARLY), _state(spark, d, LATE), "user_id", ["event_type"])


@query("SELECT n_nationkey, 'baseline' AS operation, NULL::VARCHAR AS previous, '{\"n_name\":\"' || n_name || '\"}' AS current FROM nation")
def baseline_history(spark, d):
    return history.baseline(t(spark, d, "nation"), "n_nationkey", ["n_name"])


@query(f"SELECT event_id, user_id, operation FROM (SELECT * FROM ({LOG}) WHERE user_id = 5 ORDER BY event_id DESC LIMIT 20) ORDER BY event_id")
def history_newest(spark, d):
    return history.newest(_log(spark, d), "event_id", 20, F.col("user_id") == 5).select("event_id", "user_id", "operation")


@query(
    "WITH cur AS (SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 3 <> 0), chg AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE quality END AS quality, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1 - toxic END AS toxic FROM labels WHERE doc_id % 2 = 0), j AS (SELECT chg.doc_id, cur.doc_id IS NOT NULL AS had, coalesce(chg.quality, cur.quality) AS quality, coalesce(chg.toxic, cur.toxic) AS toxic, cur.quality AS q, cur.toxic AS x, chg.doc_id % 7 <> 0 AS known FROM chg LEFT JOIN cur USING (doc_id)) SELECT doc_id, CASE WHEN NOT known THEN 'skipped' WHEN quality IS NULL AND toxic IS NULL THEN CASE WHEN had THEN 'removed' ELSE 'unchanged' END WHEN NOT had OR quality IS DISTINCT FROM q OR toxic IS DISTINCT FROM x THEN 'upserted' ELSE 'unchanged' END AS action, quality, toxic FROM j"
)
def annotation_write_plan(spark, d):
    rows = t(spark, d, "labels")
    change = lambda c, v: F.when(F.col("doc_id") % 5 != 0, v).alias(c)
    changes = rows.where("doc_id % 2 = 0").select("doc_id", change("quality", F.col("quality")), change("toxic", 1 - F.col("toxic")))
    return history.write_plan(rows.where("doc_id % 3 <> 0"), changes, "doc_id", ["quality", "toxic"], rows.where("doc_id % 7 <> 0"))


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def anchor_lowest(spark, d):
    return history.anchors(t(spark, d, "lineitem"), "l_partkey", ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"])


@query("SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NOT NULL THEN 'first' ELSE 'second' END AS kind, coalesce(a.place, b.place) AS place FROM (SELECT l_partkey AS k, min(l_orderkey) AS place FROM lineitem WHERE l_quantity > 48 GROUP BY 1) a FULL JOIN (SELECT p_partkey AS k, p_size::BIGINT AS place FROM part) b ON a.k = b.k")
def anchor_preference(spark, d):
    first = t(spark, d, "lineitem").where("l_quantity > 48").groupBy(F.col("l_partkey").alias("key")).agg(F.min("l_orderkey").alias("place"))
    return history.preferred_anchor(first, t(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("place")), "key")


@query(
    "WITH ann AS (SELECT o_orderkey AS key, o_custkey AS slot FROM orders WHERE o_orderkey % 6 = 0), cat AS (SELECT o_orderkey AS key, o_custkey AS slot FROM orders WHERE o_orderkey % 4 <> 0), stale AS (SELECT * FROM ann WHERE key NOT IN (SELECT key FROM cat)), now AS (SELECT slot, min(key) AS target FROM cat GROUP BY 1), f AS (SELECT stale.key, stale.slot, target FROM stale LEFT JOIN now USING (slot)), w AS (SELECT target, count(*) AS n FROM f WHERE target IS NOT NULL GROUP BY 1) SELECT f.key, f.slot, f.target, CASE WHEN f.target IS NULL THEN 'lost' WHEN f.target IN (SELECT key FROM ann) THEN 'taken' WHEN n > 1 THEN 'contested' ELSE 'relink' END AS outcome FROM f LEFT JOIN w ON w.target = f.target"
)
def relink_conflicts(spark, d):
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("slot"))
    return history.relink(orders.where("key % 6 = 0"), orders.where("key % 4 <> 0"), "key", ["slot"])


@query("SELECT key, url, CASE WHEN n > 1 THEN 'conflict' WHEN key > 20 THEN 'unknown' ELSE 'link' END AS outcome FROM (SELECT n_nationkey AS key, min(c_mktsegment) AS url, count(DISTINCT c_mktsegment) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 37 = 0 GROUP BY 1)")
def links_import(spark, d):
    links = t(spark, d, "customer").where("c_custkey % 37 = 0").select(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("url"))
    catalog = t(spark, d, "nation").where("n_nationkey <= 20").select(F.col("n_nationkey").alias("key"))
    return history.import_links(links, catalog, "key", "url")


# ---- writes as table rewrites ---------------------------------------------------------------------------------------

NEW_ORDERS = "SELECT o_orderkey + 40 AS o_orderkey, o_custkey, 'N' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 9 = 0"
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def _new_orders(spark, d):
    orders = t(spark, d, "orders").where("o_orderkey % 9 = 0")
    return orders.select((F.col("o_orderkey") + 40).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))


@query(f"SELECT n.* FROM ({NEW_ORDERS}) n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def insert_if_absent(spark, d):
    return tab.insert_absent(t(spark, d, "orders").select(*ORDER_COLUMNS), _new_orders(spark, d), ["o_orderkey"])


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({NEW_ORDERS})) UNION ALL SELECT * FROM ({NEW_ORDERS})")
def upsert(spark, d):
    return tab.upsert(t(spark, d, "orders").select(*ORDER_COLUMNS), _new_orders(spark, d), ["o_orderkey"])


@query(f"SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_custkey, o.o_custkey) AS o_custkey, coalesce(o.o_orderstatus, n.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice FROM orders o FULL JOIN ({NEW_ORDERS}) n ON n.o_orderkey = o.o_orderkey")
def upsert_preserving_review(spark, d):
    return tab.upsert(t(spark, d, "orders").select(*ORDER_COLUMNS), _new_orders(spark, d), ["o_orderkey"], keep=["o_orderstatus"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_where(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return tab.update(rows, (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 300000), o_orderstatus=F.lit("X")).drop("o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_quantity < 3)")
def delete_by_composite_key(spark, d):
    rows = t(spark, d, "lineitem")
    return tab.delete(rows.select("l_orderkey", "l_linenumber", "l_partkey"), rows.where("l_quantity < 3"), ["l_orderkey", "l_linenumber"])


@query(f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {DEAR})")
def orphan_cascade(spark, d):
    orders = t(spark, d, "orders")
    gone = orders.where(f"NOT ({DEAR})").select("o_orderkey")
    left = tab.cascade({"orders": orders.select("o_orderkey", "o_custkey"), "customer": t(spark, d, "customer").select("c_custkey")}, gone, "o_orderkey")
    return rel.orphans(left["customer"], "c_custkey", (left["orders"], "o_custkey"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, d):
    return tab.repeated_keys(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---- sets -----------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE p_size <> 7 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) UNION SELECT p_partkey FROM part WHERE p_size = 7")
def pending_items(spark, d):
    from tonelake.plans.incremental import pending

    parts = t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") == 7, 2).otherwise(1).alias("version"))
    done = t(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"), F.lit(1).alias("version")).distinct()
    return pending(parts, done, "p_partkey", "version").select("p_partkey")


@query("SELECT count(*) = 0 AS equal FROM (SELECT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part UNION ALL (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem))")
def set_equality(spark, d):
    return rel.same_set(t(spark, d, "lineitem").select(F.col("l_partkey").alias("k")), t(spark, d, "part").select(F.col("p_partkey").alias("k")))


@query("SELECT coalesce(a.k, b.k) AS key, a.v AS before, b.v AS after FROM (SELECT n_nationkey AS k, md5(n_name) AS v FROM nation WHERE n_nationkey < 20) a FULL JOIN (SELECT n_nationkey AS k, md5(CASE WHEN n_nationkey % 4 = 0 THEN 'new' ELSE n_name END) AS v FROM nation WHERE n_nationkey > 3) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def changed_components(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    before = n.where("key < 20").select("key", F.md5("n_name").alias("v"))
    after = n.where("key > 3").select("key", F.md5(F.when(F.col("key") % 4 == 0, "new").otherwise(F.col("n_name"))).alias("v"))
    return rel.changed(before, after, "key", "v")


@query("SELECT 'role ' || r_name AS line FROM region UNION ALL SELECT 'member ' || n_name FROM nation UNION ALL SELECT 'role ' || r_name FROM region")
def union_of_scans(spark, d):
    r, n = t(spark, d, "region"), t(spark, d, "nation")
    return publish.described([(r, F.concat(F.lit("role "), "r_name")), (n, F.concat(F.lit("member "), "n_name")), (r, F.concat(F.lit("role "), "r_name"))])


@query("SELECT n_nationkey AS key, 'beyond' AS finding FROM nation WHERE n_nationkey < 10 AND n_nationkey % 3 <> 0 UNION ALL SELECT n_nationkey, 'lacking' FROM nation WHERE n_nationkey >= 10 AND n_nationkey % 3 = 0")
def beyond_and_lacking(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("key"))
    return publish.beyond_and_lacking(n.where("key < 10"), n.where("key % 3 = 0"))


# ---- publication, masks, JSON ---------------------------------------------------------------------------------------


@query("SELECT c_custkey, '/' || CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' END AS c_mktsegment, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def publish_rules(spark, d):
    rule = publish.Rule(
        rows=lambda df, all_: df.join(all_["orders"].where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi"),
        rewrite={"c_mktsegment": publish.renamed_directory(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"], ["b", "m"])},
        drop=("c_name", "c_acctbal"),
    )
    return publish.published({"customer": t(spark, d, "customer"), "orders": t(spark, d, "orders")}, {"customer": rule})["customer"]


@query(
    "WITH h AS (SELECT unnest([CASE WHEN contains(c_name, '00001') THEN ['c_name', '00001'] END, CASE WHEN contains(c_mktsegment, 'BUILD') THEN ['c_mktsegment', 'BUILD'] END, CASE WHEN contains(c_mktsegment, '00001') THEN ['c_mktsegment', '00001'] END, CASE WHEN contains(c_name, 'BUILD') THEN ['c_name', 'BUILD'] END]) AS h FROM customer) SELECT 'customer' AS \"table\", h[1] AS \"column\", h[2] AS needle, count(*) AS n FROM h WHERE h IS NOT NULL GROUP BY ALL"
)
def privacy_scan(spark, d):
    return publish.leaks(t(spark, d, "customer"), "customer", ["00001", "BUILD"])


@query("SELECT c_custkey, CASE WHEN c_nationkey > 10 THEN c_name END AS c_name, CASE WHEN c_nationkey > 10 THEN c_acctbal END AS c_acctbal FROM customer")
def mask_columns(spark, d):
    rows = t(spark, d, "customer")
    return rel.masked(rows, ["c_name", "c_acctbal"], F.col("c_nationkey") <= 10).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0")
def json_extract(spark, d):
    rows = t(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return rows.where("k % 2 = 0")


@query("SELECT event_id, '{\"k\":\"' || json_extract_string(props, '$.k') || '\"}' AS props FROM events")
def json_rebuild(spark, d):
    return t(spark, d, "events").select("event_id", publish.only_key(F.col("props"), "k").alias("props"))


@query("SELECT o_orderkey, o_totalprice, 'size' AS broken FROM orders WHERE NOT o_totalprice <= 450000 AND o_orderstatus IN ('O', 'F', 'P') UNION ALL SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice <= 450000 THEN 'state' ELSE 'size,state' END FROM orders WHERE NOT o_orderstatus IN ('O', 'F', 'P')")
def constraint_violations(spark, d):
    rules = {"size": F.col("o_totalprice") <= 450000, "state": F.col("o_orderstatus").isin("O", "F", "P")}
    bad = rel.validate(t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), rules)
    return bad.select("o_orderkey", "o_totalprice", F.array_join("broken", ",").alias("broken"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 13)")
def missing_references(spark, d):
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return rel.missing_references(lines, ["l_partkey"], t(spark, d, "part").where("p_size <> 13"), ["p_partkey"])


@query("SELECT p_partkey, round(12 * log2((100 + p_size) / 440.0), 9) AS semitones, round(21.4 * log10(1 + 0.00437 * (100 + p_size)), 9) AS erb, round(pow(2.0, 1 - (8 + 8 * (p_size % 2))) / sqrt(12), 12) AS noise, round(exp(0.75 * ln(p_size) + 0.25 * ln(p_size + 50)), 9) AS mixed, greatest(2, least(15, p_size - 1)) AS neighbours FROM part")
def pitch_scales(spark, d):
    s = F.col("p_size")
    return t(spark, d, "part").select(
        "p_partkey", F.round(pitch.semitones(100 + s), 9).alias("semitones"), F.round(pitch.erb_number(100 + s), 9).alias("erb"), F.round(pitch.quantisation_noise(8 + 8 * (s % 2)), 12).alias("noise"),
        F.round(pitch.geometric_mix(s, s + 50, F.lit(0.25)), 9).alias("mixed"), pitch.neighbours(s).alias("neighbours"),
    )


@query("SELECT vec_id, round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), 6) AS distance, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), 6) AS cosine FROM embeddings")
def vector_distance(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    one = e.where("vec_id = 3").select(F.col("embedding").alias("q")).limit(1)
    rows = e.crossJoin(F.broadcast(one))
    return rows.select("vec_id", F.round(vectors.euclidean(F.col("embedding"), F.col("q")), 6).alias("distance"), F.round(vectors.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


KEYMAP = "SELECT l_linenumber AS module_id, l_suppkey % 7 AS instrument, l_quantity::INT AS note, min(l_quantity::INT) + 12 AS sounded_note, min(l_partkey % 9) AS sample FROM lineitem WHERE l_quantity < 40 GROUP BY 1, 2, 3"


@query(
    f"WITH e AS (SELECT event_id, event_id % 7 + 1 AS module_id, CASE WHEN event_id % 5 <> 0 THEN user_id % 7 END AS instrument, (event_id % 50 + 1)::INT AS note FROM events), k AS ({KEYMAP}), s AS (SELECT m AS module_id, i AS instrument, x AS sample, m * 100 + x AS slot FROM range(1, 8) a(m), range(7) b(i), range(6) c(x)) SELECT e.*, sounded_note, slot FROM e LEFT JOIN k ON e.module_id = k.module_id AND e.instrument = k.instrument AND e.note = k.note LEFT JOIN s ON s.module_id = e.module_id AND s.instrument = e.instrument AND s.sample = k.sample"
)
def note_resolution(spark, d):
    from tonelake.operators import notes

    e = t(spark, d, "events").select("event_id", (F.col("event_id") % 7 + 1).alias("module_id"), F.when(F.col("event_id") % 5 != 0, F.col("user_id") % 7).alias("instrument"), (F.col("event_id") % 50 + 1).cast("int").alias("note"))
    note = F.col("l_quantity").cast("int")
    lines = t(spark, d, "lineitem").where("l_quantity < 40").select(F.col("l_linenumber").cast("long").alias("module_id"), (F.col("l_suppkey") % 7).alias("instrument"), note.alias("note"), (F.col("l_partkey") % 9).alias("part"))
    keymap = lines.groupBy("module_id", "instrument", "note").agg((F.min("note") + 12).alias("sounded_note"), F.min("part").alias("sample"))
    grid = spark.range(1, 8).select(F.col("id").alias("module_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("instrument"))
    slots = grid.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("sample")).withColumn("slot", F.col("module_id") * 100 + F.col("sample"))
    return notes.resolve(e, keymap, slots)
