"""Queries over intervals by draws of whole units."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadline.sources import bindings as B
from threadline.stats import intervals
from threadline.stats.resample import drawn_times_sql

DRAWS = 200


def _sums(spark, d):
    """Quality over documents, by source as unit, for both values of the exposure and all."""
    rows = B.labelled(spark, d).withColumn("arm", F.explode(F.array(F.lit("all"), F.when(F.col("x") == 1, "exposed").otherwise("other"))))
    return rows.groupBy("arm", F.col("cluster").alias("unit")).agg(F.sum("y").alias("num"), F.count(F.lit(1)).cast("double").alias("den"))


def q_parts(spark, d):
    out = intervals.bca_parts(_sums(spark, d), ["arm"], DRAWS)
    return out.select("arm", "n", F.round("estimate", 9).alias("estimate"), F.round("acceleration", 7).alias("acceleration"), F.round("below", 9).alias("below"), F.size("drawn").cast("bigint").alias("n_draws"), F.round(F.element_at("drawn", 1), 9).alias("least"), F.round(F.element_at("drawn", -1), 9).alias("greatest"))


def q_bca(spark, d):
    return intervals.bca(_sums(spark, d), ["arm"], DRAWS)


def q_medians(spark, d):
    rows = B.labelled(spark, d).select("doc_id", (F.col("x") == 1).alias("arm"), F.inline(F.array(*(F.struct(F.lit(c).alias("moderator"), F.col(c).alias("value")) for c in ("y", "z")))))
    out = intervals.median_difference(rows, ["moderator"], "arm", "value", "doc_id", DRAWS)
    return out.select("moderator", "n_true", "n_false", *(F.round(c, 9).alias(c) for c in ("median_true", "median_false", "difference", "low", "high")), "apart")


QUERIES = {
    "bca_parts": (
        q_parts,
        f"""WITH {B.LABELLED_SQL}, s AS (SELECT arm, cluster AS unit, sum(y) AS num, CAST(count(*) AS DOUBLE) AS den FROM (SELECT *, unnest(['all', CASE WHEN x = 1 THEN 'exposed' ELSE 'other' END]) AS arm FROM frame) GROUP BY 1, 2),
t AS (SELECT *, (sum(num) OVER w - num) / nullif(sum(den) OVER w - den, 0) AS wo FROM s WINDOW w AS (PARTITION BY arm)),
m AS (SELECT arm, avg(wo) AS m FROM t GROUP BY 1),
b AS (SELECT arm, count(*) AS n, sum(num) / sum(den) AS estimate, coalesce(sum((m - wo) ** 3) / nullif(6 * sum((m - wo) ** 2) ** 1.5, 0), 0) AS acceleration FROM t JOIN m USING (arm) GROUP BY 1),
w AS (SELECT arm, draw, num, den, {drawn_times_sql("draw", "unit")} AS times FROM s, range({DRAWS}) r(draw)),
d AS (SELECT arm, draw, sum(times * num) / nullif(sum(times * den), 0) AS ratio FROM w WHERE times > 0 GROUP BY 1, 2)
SELECT arm, n, round(estimate, 9) AS estimate, round(acceleration, 7) AS acceleration, round(avg(CASE WHEN ratio < estimate THEN 1.0 WHEN ratio = estimate THEN 0.5 ELSE 0.0 END), 9) AS below,
  count(ratio) AS n_draws, round(min(ratio), 9) AS least, round(max(ratio), 9) AS greatest FROM b JOIN d USING (arm) GROUP BY arm, n, estimate, acceleration""",
    ),
    "bca_intervals": (q_bca, None),
    "median_differences": (
        q_medians,
        f"""WITH {B.LABELLED_SQL}, r AS (SELECT doc_id, x = 1 AS arm, unnest([{{'k': 'y', 'v': y}}, {{'k': 'z', 'v': z}}]) AS u FROM frame),
l AS (SELECT doc_id, arm, u.k AS moderator, u.v AS v FROM r WHERE u.v IS NOT NULL AND arm IS NOT NULL),
w AS (SELECT moderator, arm, v, draw, {drawn_times_sql("draw", "doc_id")} AS times FROM l, range({DRAWS}) r(draw)),
m AS (SELECT moderator, draw, arm, median(v) AS m FROM (SELECT moderator, draw, arm, v, unnest(range(times)) FROM w WHERE times > 0) GROUP BY 1, 2, 3),
d AS (SELECT moderator, draw, max(m) FILTER (WHERE arm) - max(m) FILTER (WHERE NOT arm) AS d FROM m GROUP BY 1, 2),
b AS (SELECT moderator, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM d GROUP BY 1),
p AS (SELECT moderator, count(*) FILTER (WHERE arm) AS n_true, count(*) FILTER (WHERE NOT arm) AS n_false, median(v) FILTER (WHERE arm) AS a, median(v) FILTER (WHERE NOT arm) AS o FROM l GROUP BY 1)
SELECT moderator, n_true, n_false, round(a, 9) AS median_true, round(o, 9) AS median_false, round(a - o, 9) AS difference, round(low, 9) AS low, round(high, 9) AS high, coalesce(low > 0 OR high < 0, false) AS apart FROM p LEFT JOIN b USING (moderator)""",
    ),
}
