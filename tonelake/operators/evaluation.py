"""Retrieval and regression measures as window and aggregate plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.functions import vectors
from tonelake.plans.joins import join_back
from tonelake.plans.ranks import running_sums


def ranked_others(items: DataFrame, key: str, vector: str, group: str | None = None, queries: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """``(query, item, similarity, rank, q_*, i_*)``: every other item of each query by falling dot product, ties by key.

    Items of the query's own ``group`` are left out. ``queries`` states the query set; each query meets all items.
    """
    carry = carry or []
    q = items if queries is None else items.where(queries)
    q = q.select(F.col(key).alias("query"), F.col(vector).alias("_q"), *[F.col(c).alias(f"q_{c}") for c in carry], *([F.col(group).alias("_qg")] if group else []))
    i = items.select(F.col(key).alias("item"), F.col(vector).alias("_i"), *[F.col(c).alias(f"i_{c}") for c in carry], *([F.col(group).alias("_ig")] if group else []))
    pairs = i.join(q, F.col("query") != F.col("item"))
    if group:
        pairs = pairs.where("_qg <> _ig")
    scored = pairs.withColumn("similarity", F.round(vectors.dot(F.col("_q"), F.col("_i")), 9)).drop("_q", "_i", "_qg", "_ig")
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "item")))


def against(queries: DataFrame, items: DataFrame, parts: int = 64) -> DataFrame:
    """A stated query set with every item, dealt by parts of the items; a part holds the query set in a hash table and streams its items."""
    q = queries.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(2 * parts, "_part")
    i = items.withColumn("_part", F.pmod(F.xxhash64(*items.columns), F.lit(parts)).cast("int")).repartition(2 * parts, "_part")
    return i.join(q.hint("shuffle_hash"), "_part").drop("_part")


def ndcg(ranked: DataFrame, gain: Column, k: int = 10) -> DataFrame:
    """``(query, ndcg)`` at k from ranked rows; null where no item has any gain."""
    rows = ranked.withColumn("_g", gain.cast("double"))
    ideal = F.row_number().over(W.partitionBy("query").orderBy(F.desc("_g"), "item"))
    rows = rows.withColumn("_best", ideal)
    part = lambda place: F.sum(F.when(F.col(place) <= k, F.col("_g") / F.log2(F.col(place) + 1)).otherwise(0.0))
    sums = rows.groupBy("query").agg(part("rank").alias("_dcg"), part("_best").alias("_ideal"))
    return sums.select("query", F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")).alias("ndcg"))


def best_gains(queries: DataFrame, items: DataFrame, own: Column, gain: Column, k: int = 10) -> DataFrame:
    """``queries`` with ``ideal``, the discounted sum of the k highest gains among all other items.

    ``gain`` and ``own``, whether the query's own item is among those with the item's values, see the columns of both. Items
    count by their values, so the work is that of different values; a query's own item is one of ``items``.
    """
    kinds, values = [c for c in queries.columns if c != "query"], items.groupBy(*items.columns).agg(F.count("*").alias("_n"))
    met = queries.select(*kinds).distinct().crossJoin(values).withColumn("_g", gain.cast("double"))
    met = met.withColumn("_n", F.col("_n") - F.coalesce(own, F.lit(False)).cast("int")).where("_n > 0 and _g is not null")
    best = met.groupBy(*kinds, "_g").agg(F.sum("_n").alias("_n")).withColumn("_to", F.sum("_n").over(W.partitionBy(*kinds).orderBy(F.desc("_g"))))
    places = best.withColumn("_from", F.col("_to") - F.col("_n") + 1).where(F.col("_from") <= k)
    each = places.select(*kinds, "_g", F.explode(F.sequence("_from", F.least("_to", F.lit(k)))).alias("_at"))
    sums = each.groupBy(*kinds).agg(F.sum(F.col("_g") / F.log2(F.col("_at") + 1)).alias("ideal"))
    return join_back(queries, sums, kinds, "left")


def ndcg_of_best(best: DataFrame, ideal: DataFrame, gain: Column, k: int = 10) -> DataFrame:
    """``(query, ndcg)`` as :func:`ndcg`, from the k best ranked items of each query and the table of :func:`best_gains`."""
    sums = best.groupBy("query").agg(F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("_dcg"))
    return sums.join(ideal, "query").select("query", F.when(F.col("ideal") > 0, F.col("_dcg") / F.col("ideal")).alias("ndcg"))


def average_precision(ranked: DataFrame, relevant: Column, support: int = 1) -> DataFrame:
    """``(query, ap)``: mean over relevant items of the share of relevant ones up to their rank; fewer than ``support`` give none."""
    rows = ranked.withColumn("_rel", relevant.cast("int"))
    upto = W.partitionBy("query").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_precision", F.sum("_rel").over(upto) / F.col("rank"))
    return rows.groupBy("query").agg(F.sum("_rel").alias("_n"), F.avg(F.when(F.col("_rel") == 1, F.col("_precision"))).alias("ap")).where(F.col("_n") >= support).select("query", "ap")


def retrieval_ranks(distances: DataFrame, query: str, item: str, distance: str, target: Column) -> DataFrame:
    """``(query, rank)``: one more than the number of items closer than the query's target, without a sort."""
    goals = distances.where(target).groupBy(query).agg(F.min(distance).alias("_goal"))
    return distances.join(goals, query).groupBy(query).agg((F.sum((F.col(distance) < F.col("_goal")).cast("long")) + 1).alias("rank"))


def rank_summary(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    return ranks.groupBy(*(by or [])).agg(F.avg((F.col("rank") == 1).cast("double")).alias("first"), F.avg((F.col("rank") <= 5).cast("double")).alias("top5"), F.percentile("rank", F.lit(0.5)).alias("median_rank"))


def average_ranks(df: DataFrame, value: str, out: str, group: list[str] | None = None) -> DataFrame:
    """Ranks in which equal values share their mean place.

    Places come from value counts: a running sum over distinct values, in each group or, without ``group``, over ranges
    of the values, so that no task sees all of them.
    """
    keys = group or []
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    if keys:
        counts = counts.withColumn("_s", F.sum("_c").over(W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)))
    else:
        counts = running_sums(counts, [F.col(value)], {"_s": "_c"})
    places = counts.select(*keys, value, (F.col("_s") - (F.col("_c") - 1) / 2).alias(out))
    return df.join(places, [*keys, value])


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    rows = average_ranks(average_ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "_ra"), b, "_rb")
    return rows.agg(F.corr("_ra", "_rb").alias("rho"))


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve by the rank sum; null without both classes."""
    rows = average_ranks(df.withColumn("_p", positive.cast("int")), score, "_r")
    sums = rows.agg(F.sum(F.col("_r") * F.col("_p")).alias("_sum"), F.sum("_p").alias("_pos"), F.count("*").alias("_n"))
    neg = F.col("_n") - F.col("_pos")
    return sums.select(F.when((F.col("_pos") > 0) & (neg > 0), (F.col("_sum") - F.col("_pos") * (F.col("_pos") + 1) / 2) / (F.col("_pos") * neg)).alias("auc"))


def group_folds(df: DataFrame, group: str, seed: str, folds: int) -> DataFrame:
    """``fold``: all rows of a group in one fold, by a seeded hash."""
    return df.withColumn("fold", F.pmod(F.conv(F.substring(F.md5(F.concat(F.col(group).cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int"))


def knn_regression(items: DataFrame, key: str, vector: str, target: str, k: int, queries: Column | None = None) -> DataFrame:
    """``(key, target, predicted)``: mean target of the k nearest items of other folds (column ``fold``)."""
    ranked = ranked_others(items, key, vector, group="fold", queries=queries, carry=[target])
    best = ranked.where(F.col("rank") <= k)
    return best.groupBy(F.col("query").alias(key), F.col(f"q_{target}").alias(target)).agg(F.avg(f"i_{target}").alias("predicted"))


def rank_one(similarities: DataFrame, query: str, item: str, score: str) -> DataFrame:
    """``(share)`` of queries whose most similar item is their own."""
    best = similarities.groupBy(query).agg(F.min_by(item, F.struct(-F.col(score), F.col(item))).alias("_best"))
    return best.agg(F.avg((F.col("_best") == F.col(query)).cast("double")).alias("share"))


def trustworthiness(pairs: DataFrame, query: str, item: str, original: str, placed: str, k: int) -> DataFrame:
    """How few of the k neighbours in a layout are far in the original space: 1 at best.

    ``pairs`` has both distances from each query to every other item; the queries may be some of the items.
    """
    w = W.partitionBy(query)
    ranked = pairs.withColumn("_o", F.row_number().over(w.orderBy(original, item))).withColumn("_p", F.row_number().over(w.orderBy(placed, item)))
    n = pairs.agg(F.countDistinct(query).alias("_m"), (F.countDistinct(item) + F.when(F.countDistinct(query) == 1, 1).otherwise(0)).alias("_n"))
    sums = ranked.agg(F.sum(F.when((F.col("_p") <= k) & (F.col("_o") > k), F.col("_o") - k).otherwise(0)).alias("_s"))
    return sums.crossJoin(n).select((1 - F.col("_s") * 2 / (F.col("_m") * k * (2 * F.col("_n") - 3 * k - 1))).alias("trustworthiness"))


def trust(places: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """:func:`trustworthiness` from the original ``place`` of each query's k neighbours in the layout; ``sizes`` (m, n) has one row,
    the numbers of queries and items."""
    sums = places.agg(F.coalesce(F.sum(F.greatest(F.col("place") - k, F.lit(0))), F.lit(0)).alias("_s"))
    return sums.crossJoin(sizes).select((1 - F.col("_s") * 2 / (F.col("m") * k * (2 * F.col("n") - 3 * k - 1))).alias("trustworthiness"))


def poisson_steps(n: int = 8) -> list[float]:
    """The distribution function of Poisson(1) at 0 to n - 1."""
    steps, p, total = [], 0.36787944117144233, 0.0
    for k in range(n):
        total += p
        steps.append(total)
        p /= k + 1
    return steps


def bootstrap(values: DataFrame, key: str, value: str, draws: int = 1000, low: float = 0.05, high: float = 0.95, seed: str = "0") -> DataFrame:
    """``(mean, low, high)``: percentile interval of the mean over resamples.

    Each row joins each draw a Poisson(1) number of times, from a hash of row and draw: the resample sizes are random,
    but rows need not know each other, so draws are sums in the tasks.
    """
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    times = reduce(lambda a, b: a + b, [(draw >= s).cast("int") for s in poisson_steps()])
    rows = values.select(key, value, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("_t", times)
    means = rows.groupBy("draw").agg((F.sum(F.col(value) * F.col("_t")) / F.sum("_t")).alias("m"))
    edges = means.agg(F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(high)).alias("high"))
    return values.agg(F.avg(value).alias("mean")).crossJoin(edges)


def chance_level(items: DataFrame, query: str, item: str, relevant: Column, draws: int = 20, seed: str = "0") -> DataFrame:
    """``(ap)``: mean average precision over shuffled rankings, the level of chance."""
    rows = items.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    shuffled = F.md5(F.concat_ws(":", F.col(query).cast("string"), F.col(item).cast("string"), F.col("_draw").cast("string"), F.lit(seed)))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(query, "_draw").orderBy(shuffled, item)))
    rows = rows.withColumn("query", F.concat_ws(":", F.col(query).cast("string"), F.col("_draw").cast("string")))
    return average_precision(rows, relevant).agg(F.avg("ap").alias("ap"))


def category_agreement(rows: DataFrame, predicted: str, label: str) -> DataFrame:
    """``(labelled, exact, top_level)``: how often a predicted path is asserted by the hand label, or shares its top."""
    from tonelake.functions import labels

    own, guess = labels.written_paths(F.col(label)), labels.written_paths(F.col(predicted))
    top = F.size(F.array_intersect(labels.top_level(own), labels.top_level(guess))) > 0
    exact = labels.asserts(own, F.element_at(guess, 1))
    known = rows.where(F.col(label).isNotNull() & (F.size(own) > 0))
    return known.agg(F.count("*").alias("labelled"), F.sum(exact.cast("long")).alias("exact"), F.sum(top.cast("long")).alias("top_level"))
