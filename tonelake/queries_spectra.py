"""Queries over spectra cut into groups and grains: users stand for frames, their days for bins, events for energy."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.operators import spectra
from tonelake.queries import DAILY, _daily, query

PROMINENCE_DB = 0.6

SPECTRA = f"""b AS (SELECT user_id AS frame, row_number() OVER w AS bin, greatest(n::DOUBLE, 1e-30) AS shape, avg(n) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS outline
        FROM ({DAILY}) WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY day)),
    x AS (SELECT *, bin - 1 AS i, 10 * log10(outline + 1e-10 * max(outline) OVER (PARTITION BY frame)) AS lev FROM b),
    g AS (SELECT a.frame, a.i, max(c.i) FILTER (c.i < a.i AND c.lev > a.lev) AS lg, min(c.i) FILTER (c.i > a.i AND c.lev > a.lev) AS rg FROM x a JOIN x c USING (frame) GROUP BY 1, 2),
    m AS (SELECT a.frame, a.i, any_value(lg) AS lg, any_value(rg) AS rg, min(c.lev) FILTER (c.i <= a.i AND c.i > coalesce(lg, -1)) AS lm, min(c.lev) FILTER (c.i >= a.i AND c.i < coalesce(rg, 1000000)) AS rm
        FROM g a JOIN x c USING (frame) GROUP BY 1, 2),
    t AS (SELECT x.*, (lg IS NULL OR lev - lm >= {PROMINENCE_DB}) AND (rg IS NULL OR lev - rm >= {PROMINENCE_DB}) AS top, (lev IS DISTINCT FROM lag(lev) OVER (PARTITION BY frame ORDER BY i))::INT AS turn FROM x JOIN m USING (frame, i)),
    r AS (SELECT *, sum(turn) OVER (PARTITION BY frame ORDER BY i) AS run FROM t),
    p AS (SELECT *, (top AND i = (min(i) OVER (PARTITION BY frame, run) + max(i) OVER (PARTITION BY frame, run)) // 2)::INT AS peak FROM r),
    a AS (SELECT *, sum(peak) OVER (PARTITION BY frame ORDER BY i) AS aft, sum(peak) OVER (PARTITION BY frame) AS peaks FROM p),
    l AS (SELECT *, first_value(i) OVER (PARTITION BY frame, aft ORDER BY lev, i) AS low, coalesce(shape <= lag(shape) OVER w AND shape < lead(shape) OVER w, false) AS valley FROM a WINDOW w AS (PARTITION BY frame ORDER BY i)),
    c AS (SELECT *, i = 0 OR (aft BETWEEN 1 AND peaks - 1 AND i = low) AS begins FROM l),
    s AS (SELECT frame, bin, shape, sum(begins::INT) OVER w - 1 AS grp, sum((begins OR valley)::INT) OVER w - 1 AS grain FROM c WINDOW w AS (PARTITION BY frame ORDER BY i)),
    k AS (SELECT frame, grp, grain, min(bin) AS start, max(bin) + 1 AS stop, sum(shape) AS energy, sum(shape * bin) / sum(shape) AS center FROM s GROUP BY 1, 2, 3)"""


def _segments(spark, d):
    w = W.partitionBy("user_id").orderBy("day")
    bins = _daily(spark, d).select("user_id", "n", F.row_number().over(w).alias("bin"), F.avg("n").over(w.rowsBetween(-1, 1)).alias("outline"))
    return spectra.segmented(bins, "user_id", "bin", "n", "outline", PROMINENCE_DB)


@query(f"WITH {SPECTRA} SELECT frame AS user_id, grp::BIGINT AS grp, grain::BIGINT AS grain, start, stop, energy, round(center, 6) AS center FROM k")
def spectral_grains(spark, d):
    """The days of each user cut where their events are fewest between busy times, and again in each valley."""
    out = spectra.grains(_segments(spark, d))
    return out.select(F.col("frame").alias("user_id"), "grp", "grain", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), "energy", F.round("center", 6).alias("center"))


@query(f"WITH {SPECTRA} SELECT frame AS user_id, grp::BIGINT AS grp, count(*) AS grains, sum(energy) AS energy, round(sum(energy * center) / sum(energy), 6) AS center FROM k GROUP BY 1, 2")
def spectral_groups(spark, d):
    out = spectra.groups(spectra.grains(_segments(spark, d)))
    return out.select(F.col("frame").alias("user_id"), "grp", "grains", "energy", F.round("center", 6).alias("center"))


@query(
    f"""WITH {SPECTRA}, v AS (SELECT k.*, scale, gain, center * (scale - 1) AS shift FROM k, (VALUES (1.25::DOUBLE, 0.5::DOUBLE), (0.8, 0.25)) AS z(scale, gain)),
    y AS (SELECT *, ceil(start - 0.5 + shift)::BIGINT + unnest(range(stop - start)) AS target FROM v),
    n AS (SELECT *, least(greatest(round_even(target - shift, 0)::BIGINT, start), stop - 1) AS nearest FROM y),
    q AS (SELECT n.*, target - shift - nearest AS off, ln(h.shape) AS here, ln(b.shape) AS below, ln(f.shape) AS above FROM n JOIN s h ON h.frame = n.frame AND h.bin = nearest
        JOIN s b ON b.frame = n.frame AND b.bin = greatest(nearest - 1, start) JOIN s f ON f.frame = n.frame AND f.bin = least(nearest + 1, stop - 1)),
    e AS (SELECT *, exp(here + off * (above - below) / 2 + off * off * (above - 2 * here + below) / 2) AS val FROM q),
    o AS (SELECT frame, target, val * gain * energy / greatest(sum(val) OVER (PARTITION BY frame, grain, scale), 1e-30) AS brought FROM e)
    SELECT frame AS user_id, target AS bin, round(sum(brought), 6) AS energy FROM o JOIN (SELECT frame, max(bin) AS last FROM s GROUP BY 1) USING (frame) WHERE target BETWEEN 1 AND last GROUP BY 1, 2"""
)
def grains_placed(spark, d):
    """Every group moved up by a quarter with half its energy, and down by a fifth with a quarter of it."""
    cut = _segments(spark, d)
    pieces = cut.select("frame", "grp").distinct()
    pieces = pieces.select("frame", "grp", F.explode(F.array(*[F.struct(F.lit(a).alias("scale"), F.lit(b).alias("gain")) for a, b in ((1.25, 0.5), (0.8, 0.25))])).alias("z"))
    out = spectra.placed(cut, pieces.select("frame", "grp", "z.scale", "z.gain"))
    return out.select(F.col("frame").alias("user_id"), "bin", F.round("energy", 6).alias("energy"))
