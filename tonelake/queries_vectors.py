"""Queries over vectors, rankings, classes and waveforms; see queries.py for the analogies."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.functions import signal, vectors
from tonelake.operators import blocks
from tonelake.operators import evaluation as ev
from tonelake.operators import relational as rel
from tonelake.operators import similarity as sim
from tonelake.operators import variants, waveforms
from tonelake.plans.joins import join_back
from tonelake.queries import query, t
from tonelake.sources.shared import materialize

UNIT = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings"
PAIRS = f"SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS cosine FROM ({UNIT}) a JOIN ({UNIT}) b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.4"


def _unit(spark, d):
    return t(spark, d, "embeddings").select("vec_id", "label", vectors.unit(F.col("embedding")).alias("v"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length FROM embeddings")
def vector_norm(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("length"))


@query(f"SELECT vec_id, round(list_sum(v), 6) AS total FROM ({UNIT})")
def unit_normalise(spark, d):
    return _unit(spark, d).select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT vec_id, k::INT AS bin, round(list_avg(list_transform(embedding[(k * 64 // 5) + 1 : ((k + 1) * 64 + 4) // 5], lambda x: x::DOUBLE)), 6) AS mean FROM embeddings, unnest(range(5)) AS u(k)")
def pooled_bands(spark, d):
    rows = t(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.pooled(F.col("embedding"), 5)).alias("bin", "mean"))
    return rows.withColumn("mean", F.round("mean", 6))


@query("SELECT vec_id, round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), vec_id LIMIT 10")
def knn_exact(spark, d):
    e = t(spark, d, "embeddings")
    one = e.where("vec_id = 7").select("embedding").first()[0]
    return sim.nearest(e, "vec_id", "embedding", one, 10).withColumn("distance", F.round("distance", 6))


@query("WITH p AS (SELECT vec_id AS pid, embedding AS pe FROM embeddings WHERE vec_id < 6), s AS (SELECT vec_id, 'p' || pid AS label, list_dot_product(embedding::DOUBLE[], pe::DOUBLE[]) AS s, pid FROM embeddings, p) SELECT vec_id, (rn - 1)::INT AS rank, label, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, pid) AS rn FROM s) WHERE rn <= 3")
def topk_categories(spark, d):
    e = t(spark, d, "embeddings")
    prompts = {f"p{r.vec_id}": list(r.embedding) for r in e.where("vec_id < 6").orderBy("vec_id").collect()}
    return sim.top_categories(e, "vec_id", "embedding", prompts, 3).withColumn("score", F.round("score", 6))


@query("WITH l AS (SELECT vec_id, unnest(range(64))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS sd FROM l GROUP BY 1) SELECT vec_id, dim, round((x - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS z FROM l JOIN s USING (dim)")
def standardise(spark, d):
    return sim.standardise(t(spark, d, "embeddings"), "vec_id", "embedding").withColumn("z", F.round("z", 6))


@query(f"SELECT a, b, round(cosine, 6) AS cosine FROM ({PAIRS})")
def cosine_pairs(spark, d):
    return sim.self_join(_unit(spark, d), "vec_id", "v", 0.4, block=200).withColumn("cosine", F.round("cosine", 6))


@query(f"SELECT a, b, round(cosine, 6) AS cosine FROM ({PAIRS}) WHERE a % 4 = 0 OR b % 4 = 0")
def pairs_with_new_items(spark, d):
    return sim.self_join(_unit(spark, d), "vec_id", "v", 0.4, block=100, new=F.col("vec_id") % 4 == 0).withColumn("cosine", F.round("cosine", 6))


LENGTH = "(100 + vec_id * 37 % 900)"
LONG_PAIRS = f"SELECT p.*, 100 + a * 37 % 900 AS la, 100 + b * 37 % 900 AS lb FROM ({PAIRS.replace('0.4', '0.25')}) p"


@query(f"SELECT a, b, round(cosine, 6) AS cosine FROM ({LONG_PAIRS}) WHERE abs(la - lb) <= 32")
def gain_candidate_pairs(spark, d):
    rows = _unit(spark, d).withColumn("length", F.expr(LENGTH))
    return sim.self_join(rows, "vec_id", "v", 0.25, ["length"], sim.gain_candidates).withColumn("cosine", F.round("cosine", 6))


@query(f"SELECT a, b, round(cosine, 6) AS cosine FROM ({LONG_PAIRS}) WHERE abs(la - lb) > 32 AND least(la, lb) >= 64 AND greatest(la, lb) <= 8 * least(la, lb)")
def resampled_candidate_pairs(spark, d):
    rows = _unit(spark, d).withColumn("length", F.expr(LENGTH))
    return sim.self_join(rows, "vec_id", "v", 0.25, ["length"], sim.resampled_candidates).withColumn("cosine", F.round("cosine", 6))


# Texts that repeat: documents with the same text are linked to the first of them.
COMPONENT = "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS component, count(*) OVER (PARTITION BY text) AS class_size FROM documents"


def _links(docs):
    rows = docs.select(F.sha2("text", 256).alias("h"), F.col("doc_id").alias("b"))
    return join_back(rows, rows.groupBy("h").agg(F.min("b").alias("a")), ["h"]).where("a <> b").select("a", "b")


def _classes(spark, d):
    docs = t(spark, d, "documents")
    return sim.classes(docs, "doc_id", _links(docs))


@query(COMPONENT)
def components(spark, d):
    return _classes(spark, d)


@query(f"SELECT DISTINCT component, class_size FROM ({COMPONENT}) WHERE class_size > 1")
def class_sizes(spark, d):
    return _classes(spark, d).where("class_size > 1").select("component", "class_size").distinct()


@query(f"SELECT component, sha256(encode('equivalence-class') || '\\x00'::BLOB || encode(string_agg(doc_id::VARCHAR, chr(0) ORDER BY doc_id::VARCHAR))) AS hash FROM ({COMPONENT}) GROUP BY 1 HAVING count(*) > 1")
def class_hashes(spark, d):
    return sim.class_hashes(_classes(spark, d), "doc_id")


@query(f"WITH c AS ({COMPONENT}) SELECT doc_id FROM c WHERE component = (SELECT component FROM c WHERE class_size > 1 ORDER BY doc_id LIMIT 1)")
def class_members(spark, d):
    classes = _classes(spark, d)
    one = classes.where("class_size > 1").agg(F.min("doc_id")).first()[0]
    return sim.class_members(classes, "doc_id", one)


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS component, count(*) OVER (PARTITION BY text) AS class_size FROM documents WHERE doc_id % 3 <> 1")
def components_within(spark, d):
    docs = t(spark, d, "documents").where("doc_id % 3 <> 1")
    outside = t(spark, d, "documents").where("doc_id % 3 = 1").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return sim.components_within(docs, "doc_id", _links(docs).unionByName(outside))


@query(f"WITH p AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS pos, length(text) AS size FROM (SELECT * FROM ({COMPONENT}) ORDER BY doc_id LIMIT 400) JOIN documents USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n_chars DESC, doc_id) AS rn, min(pos) OVER (PARTITION BY component) AS place, count(*) OVER (PARTITION BY component) AS k FROM p) SELECT doc_id, component, place::INT AS pos, k AS class_size FROM r WHERE rn = 1")
def collapse_page(spark, d):
    page = _classes(spark, d).select("doc_id", "component").join(rel.page(t(spark, d, "documents").select("doc_id", "n_chars"), [F.asc("doc_id")], 400, 0), "doc_id")
    page = page.withColumn("pos", F.row_number().over(W.orderBy("doc_id")))
    return rel.collapse(page, "component", "pos", [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "component", "pos", "class_size")


SETS = "SELECT label AS s, vec_id AS m FROM embeddings"
NEAR = f"SELECT e.vec_id, s, min(list_distance(e.embedding::DOUBLE[], x.embedding::DOUBLE[])) AS distance FROM embeddings e, ({SETS}) q JOIN embeddings x ON x.vec_id = q.m GROUP BY ALL"


def _sets(spark, d):
    return t(spark, d, "embeddings").select(F.col("label").alias("s"), F.col("vec_id").alias("m"))


@query(f"SELECT vec_id, s, round(distance, 5) AS distance FROM ({NEAR})")
def nearest_set_member(spark, d):
    out = sim.nearest_members(t(spark, d, "embeddings"), "vec_id", "embedding", _sets(spark, d), "s", "m")
    return out.select("vec_id", F.col("_set").alias("s"), F.round("distance", 5).alias("distance"))


@query(f"WITH n AS ({NEAR}), w AS (SELECT q.s AS f, n.s AS s, avg(distance) AS d FROM n JOIN ({SETS}) q ON q.m = n.vec_id GROUP BY 1, 2) SELECT x.f AS a, x.s AS b, round(0.5 * (x.d + y.d), 5) AS distance FROM w x JOIN w y ON x.f = y.s AND x.s = y.f AND x.f < x.s")
def chamfer_between_groups(spark, d):
    out = sim.chamfer(t(spark, d, "embeddings"), "vec_id", "embedding", _sets(spark, d), "s", "m")
    return out.withColumn("distance", F.round("distance", 5))


@query(None)
def layout_pca(spark, d):
    return sim.layout_pca(t(spark, d, "embeddings"), "vec_id", "embedding").select("vec_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


# ---- rankings -------------------------------------------------------------------------------------------------------

RANKED = "SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, item) AS rank FROM (SELECT q.vec_id AS query, i.vec_id AS item, q.label AS q_label, i.label AS i_label, round(list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 9) AS similarity FROM embeddings q, embeddings i WHERE q.vec_id % 20 = 0 AND q.vec_id <> i.vec_id)"


def _met(spark, d, *more):
    """Every twentieth vector as a query, and all vectors as items; ``more``: further columns, by their names on both sides."""
    e = t(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("_v"), *[F.col(c).alias(n) for c, n, _ in more])
    return q, e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("_v"), *[F.col(c).alias(n) for c, _, n in more])


def _average_precision(spark, d):
    return blocks.average_precision(*_met(spark, d, ("label", "_label", "_label")), 5)


@query(f"WITH r AS ({RANKED}), g AS (SELECT *, 1.0 / (1 + abs(q_label - i_label)) AS g FROM r), b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY g DESC, item) AS best FROM g) SELECT query, round(sum(CASE WHEN rank <= 10 THEN g / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN best <= 10 THEN g / log2(best + 1) ELSE 0 END), 6) AS ndcg FROM b GROUP BY 1")
def ndcg_at_10(spark, d):
    q, i = _met(spark, d, ("label", "q_label", "i_label"))
    gain = 1 / (1 + F.abs(F.col("q_label") - F.col("i_label")))
    best = ev.best_gains(q.select("query", "q_label"), i.select("i_label"), F.col("q_label") == F.col("i_label"), gain, 10)
    return ev.ndcg_of_best(blocks.nearest_to(q, i, 10), best, gain, 10).withColumn("ndcg", F.round("ndcg", 6))


@query(f"WITH r AS ({RANKED}), p AS (SELECT *, (q_label = i_label)::INT AS rel, sum((q_label = i_label)::INT) OVER (PARTITION BY query ORDER BY rank) / rank AS p FROM r) SELECT query, round(avg(p) FILTER (rel = 1), 6) AS ap FROM p GROUP BY 1 HAVING sum(rel) >= 5")
def average_precision(spark, d):
    return _average_precision(spark, d).withColumn("ap", F.round("ap", 6))


GROUPED = "SELECT query, item FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, item) AS rank FROM (SELECT q.vec_id AS query, i.vec_id AS item, round(list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 9) AS similarity FROM embeddings q, embeddings i WHERE q.vec_id % 20 = 0 AND q.vec_id <> i.vec_id AND q.label <> i.label)) WHERE rank <= 3"


@query(GROUPED)
def ranking_outside_group(spark, d):
    return blocks.nearest_to(*_met(spark, d, ("label", "_g", "_g")), 3, group=True).select("query", "item")


@query(f"WITH r AS (SELECT query, item, -similarity AS dist FROM ({RANKED})), g AS (SELECT query, dist AS goal FROM r WHERE item = query + 1) SELECT query, sum((dist < goal)::INT)::BIGINT + 1 AS rank FROM r JOIN g USING (query) GROUP BY 1")
def retrieval_rank(spark, d):
    q, i = _met(spark, d)
    at = i.select((F.col("item") - 1).alias("query"), F.col("item").alias("goal_item"), F.col("_v").alias("_goal"))
    goals = q.join(at, "query").select("query", "goal_item", F.round(vectors.dot(F.col("_v"), F.col("_goal")), 9).alias("goal"), "_v")
    return blocks.places(goals, i, ties=False).select("query", F.col("place").alias("rank"))


@query(f"WITH r AS (SELECT query, item, -similarity AS dist FROM ({RANKED})), g AS (SELECT query, dist AS goal FROM r WHERE item = query + 1), k AS (SELECT query, sum((dist < goal)::INT)::BIGINT + 1 AS rank FROM r JOIN g USING (query) GROUP BY 1) SELECT round(avg((rank = 1)::INT::DOUBLE), 6) AS first, round(avg((rank <= 5)::INT::DOUBLE), 6) AS top5, quantile_cont(rank, 0.5)::DOUBLE AS median_rank FROM k")
def retrieval_summary(spark, d):
    ranks = retrieval_rank(spark, d)
    return ev.rank_summary(ranks).select(F.round("first", 6).alias("first"), F.round("top5", 6).alias("top5"), F.col("median_rank").cast("double").alias("median_rank"))


@query("WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part) SELECT round(corr(a, b), 6) AS rho FROM r")
def spearman(spark, d):
    return ev.spearman(t(spark, d, "part").select("p_size", "p_retailprice"), "p_size", "p_retailprice").select(F.round("rho", 6).alias("rho"))


@query("WITH r AS (SELECT toxic, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM labels JOIN documents USING (doc_id)) SELECT round((sum(r) FILTER (toxic = 1) - sum(toxic) * (sum(toxic) + 1) / 2) / (sum(toxic) * (count(*) - sum(toxic))), 6) AS auc FROM r")
def auc(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return ev.auc(rows, "n_chars", F.col("toxic") == 1).select(F.round("auc", 6).alias("auc"))


FOLDS = "SELECT vec_id, label, embedding, (('0x' || substr(md5(label::VARCHAR || 'f'), 1, 8))::BIGINT % 4)::INT AS fold FROM embeddings"


@query(f"SELECT vec_id, fold FROM ({FOLDS})")
def group_folds(spark, d):
    return ev.group_folds(t(spark, d, "embeddings"), "label", "f", 4).select("vec_id", "fold")


@query(f"WITH e AS ({FOLDS}), r AS (SELECT q.vec_id, q.label AS target, i.label AS other, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 9) DESC, i.vec_id) AS rank FROM e q JOIN e i ON q.fold <> i.fold WHERE q.vec_id % 20 = 0) SELECT vec_id, target AS label, round(avg(other), 6) AS predicted FROM r WHERE rank <= 5 GROUP BY 1, 2")
def knn_regression(spark, d):
    rows = ev.group_folds(t(spark, d, "embeddings"), "label", "f", 4).select("vec_id", F.col("embedding").alias("_v"), "label", F.col("fold").alias("_g"))
    q = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "_v", F.col("label").alias("q_label"), "_g")
    best = blocks.nearest_to(q, rows.select(F.col("vec_id").alias("item"), "_v", F.col("label").alias("i_label"), "_g"), 5, group=True)
    return best.groupBy(F.col("query").alias("vec_id"), F.col("q_label").alias("label")).agg(F.round(F.avg("i_label"), 6).alias("predicted"))


@query("WITH s AS (SELECT q.vec_id AS query, i.vec_id AS item, list_dot_product(q.embedding::DOUBLE[], list_transform(i.embedding, lambda x: x::DOUBLE * (1 + i.vec_id % 3))) AS s FROM embeddings q, embeddings i WHERE q.vec_id % 20 = 0), b AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY s DESC, item) AS rn FROM s) SELECT round(avg((query = item)::INT::DOUBLE), 6) AS share FROM b WHERE rn = 1")
def rank_one_share(spark, d):
    q, i = _met(spark, d)
    i = i.withColumn("_v", F.transform("_v", lambda x: x.cast("double") * (1 + F.col("item") % 3)))
    best = blocks.nearest_to(q, i, 1, rounded=False, itself=True)
    return ev.rank_one(best, "query", "item", "score").select(F.round("share", 6).alias("share"))


@query("WITH p AS (SELECT q.vec_id AS query, i.vec_id AS item, round(list_distance(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 9) AS o, round(sqrt(pow(q.embedding[1]::DOUBLE - i.embedding[1]::DOUBLE, 2) + pow(q.embedding[2]::DOUBLE - i.embedding[2]::DOUBLE, 2)), 9) AS p FROM embeddings q, embeddings i WHERE q.vec_id % 20 = 0 AND q.vec_id <> i.vec_id), n AS (SELECT count(*) AS n, count(*) FILTER (vec_id % 20 = 0) AS m FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY o, item) AS ro, row_number() OVER (PARTITION BY query ORDER BY p, item) AS rp FROM p) SELECT round(1 - sum(CASE WHEN rp <= 5 AND ro > 5 THEN ro - 5 ELSE 0 END) * 2 / (any_value(m) * 5 * (2 * any_value(n) - 3 * 5 - 1)), 6) AS trustworthiness FROM r, n")
def trustworthiness(spark, d):
    q, i = _met(spark, d)
    plane = lambda df: df.withColumn("_v", F.slice("_v", 1, 2))
    near = materialize(blocks.nearest_to(plane(q), plane(i), 5, "distance").select("query", "item"), "near")
    whole = near.join(q, "query").join(i.select("item", F.col("_v").alias("_goal")), "item")
    goals = whole.select("query", F.col("item").alias("goal_item"), F.round(vectors.euclidean(F.col("_v"), F.col("_goal")), 9).alias("goal"), "_v")
    sizes = q.agg(F.count("*").alias("m")).crossJoin(i.agg(F.count("*").alias("n")))
    return ev.trust(blocks.places(goals, i, "distance"), sizes, 5).select(F.round("trustworthiness", 6).alias("trustworthiness"))


AVERAGE = f"SELECT query, avg(p) FILTER (rel = 1) AS ap FROM (SELECT *, (q_label = i_label)::INT AS rel, sum((q_label = i_label)::INT) OVER (PARTITION BY query ORDER BY rank) / rank AS p FROM ({RANKED})) GROUP BY 1 HAVING sum(rel) >= 5"
TIMES = " + ".join(f"(u >= {step!r})::INT" for step in ev.poisson_steps())


@query(
    f"WITH v AS ({AVERAGE}), d AS (SELECT ap, k, ('0x' || substr(md5(query::VARCHAR || ':0:' || k::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296 AS u FROM v, unnest(range(1, 1001)) AS x(k)), m AS (SELECT k, sum(ap * ({TIMES})) / sum({TIMES}) AS m FROM d GROUP BY 1) SELECT round((SELECT avg(ap) FROM v), 6) AS mean, round(quantile_cont(m, 0.05), 6) AS low, round(quantile_cont(m, 0.95), 6) AS high FROM m"
)
def bootstrap_interval(spark, d):
    rows = materialize(_average_precision(spark, d), "values")
    out = ev.bootstrap(rows, "query", "ap", 1000)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    f"WITH r AS (SELECT query, k, item, q_label, i_label, row_number() OVER (PARTITION BY query, k ORDER BY md5(query::VARCHAR || ':' || item::VARCHAR || ':' || k::VARCHAR || ':0'), item) AS rank FROM ({RANKED}) x, unnest(range(1, 21)) AS y(k)), p AS (SELECT *, (q_label = i_label)::INT AS rel, sum((q_label = i_label)::INT) OVER (PARTITION BY query, k ORDER BY rank) / rank AS p FROM r), a AS (SELECT avg(p) FILTER (rel = 1) AS ap FROM p GROUP BY query, k HAVING sum(rel) >= 1) SELECT round(avg(ap), 6) AS ap FROM a"
)
def chance_level(spark, d):
    q, i = _met(spark, d, ("label", "_label", "_label"))
    return blocks.chance_level(q.drop("_v"), i.drop("_v")).select(F.round("ap", 6).alias("ap"))


@query("SELECT round(avg(s), 6) AS cosine FROM (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 5 = 0)")
def held_out_cosine(spark, d):
    e = t(spark, d, "embeddings")
    a, b = e.where("vec_id % 5 = 0").select("vec_id", F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id").agg(F.round(F.avg(vectors.cosine(F.col("x"), F.col("y"))), 6).alias("cosine"))


# ---- waveforms: a user's event values in order, scaled to the range of sounds ----------------------------------------


def waves(spark, d):
    e = t(spark, d, "events").where("value is not null")
    rows = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("r"))
    peak = F.array_max(F.transform("r", lambda x: F.abs(x["value"])))
    return rows.select("user_id", F.transform("r", lambda x: x["value"] / F.greatest(peak, F.lit(1e-9))).alias("wave"))


def wave_frames(spark, d):
    """(user_id, i, x): the same, a row for each value."""
    rows = variants.frames(t(spark, d, "events"), "user_id", "event_id", "value")
    peaks = rows.groupBy("user_id").agg(F.greatest(F.max(F.abs("x")), F.lit(1e-9)).alias("peak"))
    return join_back(rows, peaks, ["user_id"]).select("user_id", "i", (F.col("x") / F.col("peak")).alias("x"))


WAVES = "SELECT user_id, list(value ORDER BY event_id) AS r, max(abs(value)) AS peak, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1"


@query(f"SELECT user_id, coalesce(list_max(list_transform(range(1, n + 1), lambda i: CASE WHEN abs(r[i] / greatest(peak, 1e-9)) > 1.0 / 128 THEN i ELSE 0 END)), 0)::INT AS frames FROM ({WAVES})")
def trim_tail(spark, d):
    return variants.trimmed_lengths(wave_frames(spark, d), "user_id")


@query(f"SELECT user_id, k::INT AS bucket, round(list_min(r[a + 1 : b]) / greatest(peak, 1e-9), 9) AS lowest, round(list_max(r[a + 1 : b]) / greatest(peak, 1e-9), 9) AS highest FROM (SELECT user_id, r, peak, k, k * (n // 32) + least(k, n % 32) AS a, (k + 1) * (n // 32) + least(k + 1, n % 32) AS b FROM ({WAVES}), unnest(range(32)) AS u(k)) WHERE b > a")
def thumbnail_buckets(spark, d):
    out = variants.thumbnails(wave_frames(spark, d), "user_id")
    return out.select("user_id", "bucket", F.round("lowest", 9).alias("lowest"), F.round("highest", 9).alias("highest"))


#: Segments of at least 16 frames, their spectra written out as sums, and the root power in even bands and in octaves.
SPECTRA = """w AS (SELECT user_id, r, greatest(peak, 1e-9) AS peak, n, greatest(16, ceil(n / 16))::INT AS size FROM ({})),
    f AS (SELECT user_id, i // size AS seg, i % size AS j, size, r[i + 1] / peak AS x FROM w, unnest(range(n)) AS u(i)),
    k AS (SELECT user_id, seg, size // 2 + 1 AS bins, k, pow(sum(x * cos(2 * pi() * ((j * k) % size) / size)), 2) + pow(sum(x * sin(2 * pi() * ((j * k) % size) / size)), 2) AS power FROM f, unnest(range(size // 2 + 1)) AS u(k) GROUP BY ALL),
    b AS (SELECT user_id, seg, band, sqrt(sum(power) FILTER (k >= round_even(band * bins / 8, 0) AND k < round_even((band + 1) * bins / 8, 0))) AS s, sqrt(sum(power) FILTER (k < pow(2, band) AND (band = 0 OR k >= pow(2, band - 1)))) AS o FROM k, unnest(range(8)) AS u(band) GROUP BY ALL),
    v AS (SELECT w.user_id, (seg * 8 + band)::INT AS place, coalesce(b.s, 0.0) AS s, coalesce(b.o, 0.0) AS o FROM (SELECT user_id, seg, band FROM w, unnest(range(16)) AS u(seg), unnest(range(8)) AS v(band)) w LEFT JOIN b USING (user_id, seg, band)),
    prints AS (SELECT user_id, place, coalesce(s / nullif(sqrt(sum(s * s) OVER (PARTITION BY user_id)), 0), 0.0) AS shape, coalesce(o / nullif(sqrt(sum(o * o) OVER (PARTITION BY user_id)), 0), 0.0) AS rate FROM v)"""


@query(f"WITH {SPECTRA.format(WAVES)} SELECT user_id, place, round(shape, 6) AS shape, round(rate, 6) AS rate FROM prints")
def shape_fingerprint(spark, d):
    """The numbers of both fingerprints, a row for each of their 128 places."""
    rows = waveforms.fingerprints(wave_frames(spark, d), "user_id").select("user_id", F.posexplode(F.arrays_zip("shape", "rate")).alias("place", "v"))
    return rows.select("user_id", "place", F.round("v.shape", 6).alias("shape"), F.round("v.rate", 6).alias("rate"))


@query(None)
def sound_descriptors(spark, d):
    rows = waves(spark, d).select("user_id", signal.described(F.col("wave"), 8000.0).alias("x"), signal.kind_of_sound(F.col("wave"), 8000.0).alias("kind"), signal.pitch_of(F.col("wave"), 8000.0).alias("p"))
    return rows.select("user_id", "kind", F.transform("x", lambda v: F.round(v, 4)).alias("descriptor"), F.round(F.get("p", F.lit(0)), 3).alias("hertz"))


#: Waves and their copies at a quarter of the level in eight bits, by id; fits and residuals of the pairs ``p``.
COPIES = f"""waved AS (SELECT user_id, list_transform(r, lambda x: x / greatest(peak, 1e-9)) AS v FROM ({WAVES})),
    s AS (SELECT user_id * 2 AS id, 16 AS depth, v FROM waved UNION ALL SELECT user_id * 2 + 1, 8, list_transform(v, lambda x: round_even(x * 0.25 * 128, 0) / 128) FROM waved)"""
GAINS = """g AS (SELECT *, list_sum(list_transform(range(1, n + 1), lambda i: x[i] * y[i])) / nullif(list_sum(list_transform(range(1, n + 1), lambda i: x[i] * x[i])), 0) AS gain FROM p),
    e AS (SELECT a, b, depth, gain, n, list_transform(range(1, n + 1), lambda i: y[i] - gain * x[i]) AS rest FROM g WHERE abs(gain) BETWEEN 0.1 AND 10),
    q AS (SELECT *, sqrt(list_sum(list_transform(rest, lambda z: z * z)) / n) AS rms FROM e)"""
LIKE_COPIES = f"""WITH {COPIES},
    {SPECTRA.format("SELECT id AS user_id, v AS r, 1.0 AS peak, len(v) AS n FROM s")},
    l AS (SELECT s.id, s.depth, s.v, z.shape FROM s JOIN (SELECT user_id AS id, list(shape ORDER BY place) AS shape FROM prints GROUP BY 1) z USING (id)),
    p AS (SELECT a.id AS a, b.id AS b, least(a.depth, b.depth) AS depth, a.v AS x, b.v AS y, least(len(a.v), len(b.v)) AS n FROM l a JOIN l b ON a.id < b.id WHERE abs(len(a.v) - len(b.v)) <= 32 AND list_dot_product(a.shape, b.shape) >= 0.98),
    {GAINS},
    c AS (SELECT a, b, round(gain, 4) AS gain, round(greatest(0.0, 1 - rms / (0.02 * pow(2.0, 8 - depth))), 4) AS confidence FROM q)
    SELECT *, CASE WHEN a % 2 <> b % 2 AND abs(gain - 1) <= 0.05 THEN 'bit_depth_variant' ELSE 'amplification_variant' END AS relation FROM c WHERE confidence >= 0.5"""


@query(LIKE_COPIES)
def gain_pairs(spark, d):
    """Waves and their copies at a quarter of the level: pairs of near lengths and like fingerprints, then the gain score.
    Waves that are the same frame by frame are one class, scored once and then spread over its members."""
    loud = wave_frames(spark, d).select((F.col("user_id") * 2).alias("id"), "i", "x")
    soft = loud.select((F.col("id") + 1).alias("id"), "i", (F.bround(F.col("x") * 0.25 * 128) / 128).alias("x"))
    rows = materialize(loud.unionByName(soft), "waves")
    members = materialize(variants.alike(rows, F.when(F.col("id") % 2 == 0, 16).otherwise(8)), "classes")
    firsts = members.where("id = first")
    rows = materialize(rows.join(firsts, "id", "left_semi"), "waves")
    prints = materialize(waveforms.fingerprints(rows, "id").join(firsts, "id").select("id", F.col("shape").alias("v"), F.col("n").alias("length"), "last", "copies"), "prints")
    pairs = materialize(sim.self_join(prints, "id", "v", 0.98, ["length"], sim.gain_candidates).select("a", "b"), "pairs")
    pairs = variants.both_ways(pairs, prints.where(vectors.dot(F.col("v"), F.col("v")) >= 0.98))
    scored = variants.gain_scores(pairs, rows, firsts.select("id", "n", "depth"))
    out = scored.select("a", "b", F.round("gain", 4).alias("gain"), F.round("confidence", 4).alias("confidence"))
    out = out.withColumn("relation", signal.relation(F.col("gain"), F.col("confidence"), F.col("a") % 2 != F.col("b") % 2)).where("relation is not null")
    return variants.spread(materialize(out, "scores"), members)
