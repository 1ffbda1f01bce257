"""Queries over ranks, time maps, step graphs, budgets, builds in parts and waveform variants; see queries.py for the analogies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.operators import aggregates as agg
from tonelake.operators import variants
from tonelake.plans import ranks, resumable, steps
from tonelake.queries import CLOSED, DAILY, _daily, _labelled, query, t
from tonelake.queries_vectors import COPIES, GAINS, wave_frames
from tonelake.sources.shared import new_path

# ---- ordered passes -------------------------------------------------------------------------------------------------

SHARES = f"SELECT user_id, day, epoch(day::TIMESTAMP) / 86400 AS moment, sum(n) OVER (PARTITION BY user_id ORDER BY day) / sum(n) OVER (PARTITION BY user_id) AS share FROM ({DAILY})"


@query(
    f"""WITH s AS ({SHARES}), k AS (SELECT user_id AS source, share, moment::DOUBLE AS y FROM s UNION ALL SELECT user_id, 0.0, min(moment) - 1 FROM s GROUP BY 1),
    p AS (SELECT user_id, day, share, CASE WHEN user_id % 2 = 0 THEN user_id + 1 ELSE user_id - 1 END AS source FROM s),
    a AS (SELECT p.*, k.share AS x0, k.y AS y0 FROM p ASOF LEFT JOIN k ON p.source = k.source AND p.share >= k.share),
    b AS (SELECT a.*, k.share AS x1, k.y AS y1 FROM a ASOF LEFT JOIN k ON a.source = k.source AND a.share <= k.share)
    SELECT user_id, day, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = share THEN y0 ELSE y0 + (share - x0) * (y1 - y0) / (x1 - x0) END, 6) AS source_time FROM b"""
)
def time_map(spark, d):
    """For every day of a user the time at which the user's neighbour had the same share of their events behind them."""
    shares = agg.quantile_map(_daily(spark, d), "user_id", "n", "day").withColumn("at", F.unix_date("day").cast("double"))
    start = shares.groupBy("user_id").agg((F.min("at") - 1).alias("at")).withColumn("share", F.lit(0.0))
    curves = shares.select("user_id", "share", "at").unionByName(start)
    other = F.when(F.col("user_id") % 2 == 0, F.col("user_id") + 1).otherwise(F.col("user_id") - 1)
    out = agg.time_map(shares.select("user_id", "day", "share", other.alias("source")), curves, "user_id", "source", "at", "share")
    return out.select("user_id", "day", F.round("source_time", 6).alias("source_time"))


@query(
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS sec, coalesce(value, 0) / 10 AS cost FROM events WHERE ts IS NOT NULL),
    w AS (SELECT *, sum(cost) OVER o AS spent, 50 - sec / 900 - cost + sum(cost) OVER o AS bound FROM e WINDOW o AS (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING)),
    b AS (SELECT *, min(bound) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) - spent + sec / 900 AS tokens FROM w)
    SELECT user_id, event_id, round(tokens, 4) + 0.0 AS tokens, CASE WHEN tokens < 10 THEN round((10 - tokens) * 900, 1) END AS wait FROM b"""
)
def token_budgets(spark, d):
    """What a budget of 50 that regains one token in 15 minutes holds after each event, and how long until it holds 10."""
    rows = t(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("value") / 10).alias("cost"))
    out = ranks.budgets(rows, "user_id", "at", "cost", "event_id", 50.0, 1 / 900)
    return out.select("user_id", "event_id", (F.round("tokens", 4) + 0.0).alias("tokens"), F.round(ranks.seconds_until(F.col("tokens"), 10.0, 1 / 900), 1).alias("wait"))


@query(
    f"""WITH c AS (SELECT path, string_split(path, ': ') AS st, count(*) AS n FROM ({CLOSED}) GROUP BY 1),
    u AS (SELECT path, i, array_to_string(st[1:i], ': ') AS upper FROM c, unnest(range(1, len(st) + 1)) AS r(i)),
    k AS (SELECT u.path, list({{'less': -c.n, 'name': list_last(c.st)}} ORDER BY i) AS key, max(i) AS depth FROM u JOIN c ON u.upper = c.path GROUP BY 1)
    SELECT row_number() OVER (ORDER BY key, path) AS place, repeat('    ', (depth - 1)::INT) || format('{{:5d}}  {{}}', -list_last(key).less, list_last(key).name) AS line FROM k"""
)
def vocabulary_tree(spark, d):
    return agg.vocabulary_tree(agg.closure_counts(_labelled(spark, d), "label").select("path", "n"))


# ---- steps that require one another ---------------------------------------------------------------------------------

EDGES = """SELECT o_orderkey AS step, unnest(list_distinct([before, first])) AS needs FROM (
    SELECT o_orderkey, lag(o_orderkey) OVER w AS before, first_value(o_orderkey) OVER w AS first, row_number() OVER w AS i FROM orders
    WINDOW w AS (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey)) WHERE i > 1"""


def _steps(spark, d):
    """Orders as steps: each needs its customer's last order before it and first order in the same year."""
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey", F.year("o_orderdate")).orderBy("o_orderdate", "o_orderkey")
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("step"), F.lag("o_orderkey").over(w).alias("before"), F.first("o_orderkey").over(w).alias("first"), "o_orderstatus", "o_orderpriority")
    edges = orders.where("before is not null").select("step", F.explode(F.array("before", "first")).alias("needs"))
    return orders, edges


@query(f"WITH RECURSIVE e AS ({EDGES}), r AS (SELECT o_orderkey AS step, 0 AS layer FROM orders UNION SELECT e.step, r.layer + 1 FROM r JOIN e ON e.needs = r.step) SELECT step, max(layer)::INT AS layer FROM r GROUP BY 1")
def step_layers(spark, d):
    return steps.layers(*_steps(spark, d))


@query(f"WITH RECURSIVE e AS ({EDGES}), r AS (SELECT o_orderkey AS step, 0 AS rounds FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT e.needs, r.rounds + 1 FROM r JOIN e ON e.step = r.step) SELECT step, min(rounds)::INT AS rounds FROM r GROUP BY 1")
def step_requirements(spark, d):
    orders, edges = _steps(spark, d)
    return steps.requirements(orders, edges, orders.where("o_orderpriority = '1-URGENT'"))


@query(f"WITH RECURSIVE e AS ({EDGES}), r AS (SELECT e.step, 1 AS rounds FROM e JOIN orders ON needs = o_orderkey WHERE o_orderstatus = 'F' UNION SELECT e.step, r.rounds + 1 FROM r JOIN e ON e.needs = r.step) SELECT step, min(rounds)::INT AS rounds FROM r GROUP BY 1")
def step_descendants(spark, d):
    orders, edges = _steps(spark, d)
    return steps.descendants(orders, edges, orders.where("o_orderstatus = 'F'"))


# ---- builds in parts ------------------------------------------------------------------------------------------------


@query("SELECT part, count(*) AS rows, sum(l_quantity) AS quantity, (1 + (part >= 3)::INT)::INT AS run FROM (SELECT *, (l_orderkey % 6)::INT AS part FROM lineitem) GROUP BY 1")
def resumed_build(spark, d):
    """A build of six parts that fails in the fourth and is taken up again: what stands in the parts, and which run wrote them."""
    path, lines = new_path(spark, "build"), t(spark, d, "lineitem").withColumn("part", (F.col("l_orderkey") % 6).cast("int"))

    def part(n, broken=False):
        if broken and n == 3:
            raise InterruptedError("stopped on purpose")
        return lines.where(F.col("part") == n)

    try:
        resumable.build(spark, path, "lines by six", 6, lambda n: part(n, True))
    except InterruptedError:
        pass
    rows = resumable.build(spark, path, "lines by six", 6, part)
    runs = resumable.manifest(spark, path).select("part", "rows", "run")
    return runs.join(rows.groupBy("part").agg(F.sum("l_quantity").alias("quantity")), "part").select("part", "rows", "quantity", "run")


# ---- waveforms ------------------------------------------------------------------------------------------------------


GAIN_WAVES = f"""WITH {COPIES},
    p AS (SELECT a.id AS a, b.id AS b, least(a.depth, b.depth) AS depth, a.v AS x, b.v AS y, least(len(a.v), len(b.v)) AS n FROM s a JOIN s b ON b.id IN (a.id + 1, a.id + 2) WHERE a.id % 2 = 0 AND abs(len(a.v) - len(b.v)) <= 32),
    {GAINS}
    SELECT a, b, round(gain, 6) AS gain, round(rms, 6) AS rms_error, round(list_max(list_transform(rest, lambda z: abs(z))), 6) AS max_abs_error, round(greatest(0.0, 1 - rms / (0.02 * pow(2.0, 8 - depth))), 6) AS confidence FROM q"""


@query(GAIN_WAVES)
def gain_scores(spark, d):
    """Waves against their copies at a quarter of the level in eight bits, and against the next wave."""
    loud = wave_frames(spark, d).select((F.col("user_id") * 2).alias("id"), "i", "x")
    soft = loud.select((F.col("id") + 1).alias("id"), "i", (F.bround(F.col("x") * 0.25 * 128) / 128).alias("x"))
    rows = loud.unionByName(soft)
    sizes = rows.groupBy("id").agg(F.count("*").alias("n")).withColumn("depth", F.when(F.col("id") % 2 == 0, 16).otherwise(8))
    pairs = sizes.where("id % 2 = 0").select(F.col("id").alias("a"), F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("b"))
    out = variants.gain_scores(pairs, rows, sizes)
    return out.select("a", "b", *[F.round(c, 6).alias(c) for c in ("gain", "rms_error", "max_abs_error", "confidence")])
