"""Queries over null models, densities, ranks and footers."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadline.operators import textmatch
from threadline.plans.sequences import EPISODE_SQL, _episodes, _gaps
from threadline.sources import bindings as B
from threadline.sources import tables
from threadline.stats import density, nulls, ols

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
DRAWS = 50

_UNIT = "CAST('0x' || substr(md5(draw || ':' || {}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
_BETA = "round((covar_pop(p, y) - covar_pop(p, z) * covar_pop(z, y) / var_pop(z)) / (var_pop(p) - covar_pop(p, z) * covar_pop(p, z) / var_pop(z)), 7)"
_ANCHORS = f"""WITH {B.LABELLED_SQL},
e AS (SELECT *, x = 1 OR z > 7 AS able FROM frame WHERE y IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL),
s AS (SELECT cluster, CAST(sum(x) AS BIGINT) AS ones FROM e WHERE able GROUP BY 1),
d AS (SELECT e.*, draw, ones, able, row_number() OVER (PARTITION BY e.cluster, draw, able ORDER BY {_UNIT.format("doc_id")}, doc_id) AS k FROM e LEFT JOIN s ON s.cluster IS NOT DISTINCT FROM e.cluster, range({DRAWS + 1}) r(draw)),
q AS (SELECT draw, y, z, CASE WHEN draw = 0 OR NOT able THEN x WHEN k <= ones THEN 1.0 ELSE 0.0 END AS p FROM d)
SELECT draw, {_BETA} AS estimate FROM q GROUP BY 1"""
_SHIFTED = f"""WITH {B.LABELLED_SQL},
e AS (SELECT *, CASE WHEN x = 1 THEN z END <= 8 AS near FROM frame WHERE y IS NOT NULL AND z IS NOT NULL),
a AS (SELECT avg(CASE WHEN near THEN 1.0 ELSE 0.0 END) AS share FROM e),
q AS (SELECT draw, y, z, CASE WHEN draw = 0 THEN CASE WHEN near THEN 1.0 ELSE 0.0 END WHEN {_UNIT.format("doc_id")} < share THEN 1.0 ELSE 0.0 END AS p FROM e, a, range({DRAWS + 1}) r(draw))
SELECT draw, {_BETA} AS estimate FROM q GROUP BY 1"""
_FLIPS = f"""WITH {B.LABELLED_SQL}, f AS (SELECT draw, avg(CASE WHEN draw = 0 OR {_UNIT.format("doc_id")} < 0.5 THEN y - 0.5 ELSE 0.5 - y END) AS estimate FROM frame, range({DRAWS + 1}) r(draw) WHERE y IS NOT NULL GROUP BY 1)"""
_ORDER = f"""WITH {EPISODE_SQL},
d AS (SELECT pr_id, state, draw, episode, CASE WHEN draw > 0 THEN {_UNIT.format("pr_id || '/' || episode")} ELSE 0 END AS spot FROM es, range({DRAWS + 1}) r(draw)),
l AS (SELECT draw, state, coalesce(lead(state) OVER (PARTITION BY pr_id, draw ORDER BY spot, episode), 'end') AS next_state FROM d),
c AS (SELECT draw, state, next_state, count(*) / sum(count(*)) OVER (PARTITION BY draw, state) AS share FROM l GROUP BY 1, 2, 3),
k AS (SELECT DISTINCT state, next_state FROM c),
w AS (SELECT k.state, k.next_state, r.draw, coalesce(share, 0) AS share FROM k CROSS JOIN range({DRAWS + 1}) r(draw) LEFT JOIN c ON c.state = k.state AND c.next_state = k.next_state AND c.draw = r.draw)
SELECT state, next_state, round(max(share) FILTER (WHERE draw = 0), 9) AS observed, round(avg(share) FILTER (WHERE draw > 0), 9) AS placebo_mean,
  round(quantile_cont(share, 0.025) FILTER (WHERE draw > 0), 9) AS low, round(quantile_cont(share, 0.975) FILTER (WHERE draw > 0), 9) AS high,
  round(max(share) FILTER (WHERE draw = 0) - avg(share) FILTER (WHERE draw > 0), 9) + 0.0 AS difference FROM w GROUP BY 1, 2"""


def q_anchors(spark, d):
    able = (F.col("x") == 1) | (F.col("z") > 7)
    return nulls.permuted_anchors(B.labelled(spark, d), "y", "x", able, ["z"], "cluster", "doc_id", DRAWS).withColumn("estimate", F.round("estimate", 7))


def q_shifted(spark, d):
    timed = B.labelled(spark, d).withColumn("hours", F.when(F.col("x") == 1, F.col("z")))
    return nulls.shifted_times(timed, "y", "hours", 8.0, ["z"], "doc_id", DRAWS).withColumn("estimate", F.round("estimate", 7))


def q_flips(spark, d):
    out = nulls.null_summary(nulls.sign_flips(B.labelled(spark, d).withColumn("c", F.col("y") - 0.5), "c", "doc_id", DRAWS))
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


def q_reordered(spark, d):
    out = nulls.reordered_transitions(_episodes(spark, d), "pr_id", "episode", "state", DRAWS)
    return out.select("state", "next_state", *(F.round(c, 9).alias(c) for c in out.columns[2:]))


def q_antimode(spark, d):
    """Cut, bandwidths, modes and p of one mode of the log gaps."""
    b = density.binned(_gaps(spark, d), F.log10(F.greatest(F.col("gap_minutes"), F.lit(1 / 60))))
    if b is None:
        return spark.createDataFrame([], "n bigint, bandwidth double, n_modes int, cut double, critical double, p double")
    h = density.bandwidth(b)
    critical, p = density.unimodality_test(b, 100, 1)
    return spark.createDataFrame([(b.n, h, density.modes(b, h), density.antimode(b, 4.0), critical, p)], "n bigint, bandwidth double, n_modes int, cut double, critical double, p double")


def q_antimode_draws(spark, d):
    gaps = _gaps(spark, d)
    return density.cut_by_draws(gaps, "repo_id", F.log10(F.greatest(F.col("gap_minutes"), F.lit(1 / 60))), 4.0, DRAWS)


def q_two_way(spark, d):
    """An interaction beside two absorbed fixed effects, errors by cluster."""
    df = B.labelled(spark, d).join(tables.read_table(spark, d, "documents", ["doc_id", "lang"]), "doc_id").withColumn("xz", F.col("x") * F.col("z"))
    flat = ols.absorb(df.fillna("?", ["cluster", "lang"]), ["y", "x", "z", "xz"], ["cluster", "lang"])
    fit = ols.ols(flat, "y", {c: F.col(c) for c in ("x", "z", "xz")}, "cluster", intercept=False)
    return spark.createDataFrame([(k, round(b, 7), round(s, 7)) for k, b, s in fit.table()], "term string, estimate double, std_error double")


def q_ranking(spark, d):
    out = textmatch.average_precision(B.labelled(spark, d), "y", "x")
    return out.select("n", F.round("average_precision", 9).alias("average_precision"), F.round("brier", 9).alias("brier"))


def q_signed(spark, d):
    out = textmatch.signed_rank(B.labelled(spark, d).withColumn("c", F.round(F.col("y") - 0.5, 2)), "c")
    return out.select("n", F.round("w_plus", 3).alias("w_plus"), F.round("z", 6).alias("z"))


def q_footers(spark, d):
    return tables.footer_counts(spark, d, TABLES)


def q_beside(spark, d):
    read = tables.read_table
    return tables.beside(read(spark, d, "orders", ["o_orderkey"]).agg(F.count(F.lit(1)).alias("n_orders")), read(spark, d, "events", ["event_id"]).agg(F.max("event_id").alias("last_event")))


QUERIES = {
    "permuted_anchors": (q_anchors, _ANCHORS),
    "shifted_times": (q_shifted, _SHIFTED),
    "sign_flip_test": (
        q_flips,
        _FLIPS
        + """ SELECT round(max(o), 9) AS observed, round(avg(estimate), 9) AS null_mean, round(stddev_samp(estimate), 9) AS null_sd, round(quantile_cont(estimate, 0.025), 9) AS low,
  round(quantile_cont(estimate, 0.975), 9) AS high, round((count(*) FILTER (WHERE abs(estimate) >= abs(o)) + 1) / (count(*) + 1.0::DOUBLE), 9) AS p
FROM f, (SELECT estimate AS o FROM f WHERE draw = 0) WHERE draw > 0""",
    ),
    "reordered_transitions": (q_reordered, _ORDER),
    "gap_antimode": (q_antimode, None),
    "gap_antimode_draws": (q_antimode_draws, None),
    "two_way_interaction": (q_two_way, None),
    "ranking_scores": (
        q_ranking,
        f"""WITH {B.LABELLED_SQL}, s AS (SELECT y, count(*) FILTER (WHERE x = 1) AS pos, count(*) AS n FROM frame GROUP BY 1),
c AS (SELECT pos, sum(pos) OVER (ORDER BY y DESC) AS cp, sum(n) OVER (ORDER BY y DESC) AS cn, sum(pos) OVER () AS total FROM s)
SELECT (SELECT count(*) FROM frame) AS n, round(sum(pos / total::DOUBLE * cp / cn), 9) AS average_precision, round((SELECT avg((y - x) ** 2) FROM frame), 9) AS brier FROM c""",
    ),
    "signed_rank": (
        q_signed,
        f"""WITH {B.LABELLED_SQL}, a AS (SELECT round(y - 0.5, 2) AS c FROM frame), t AS (SELECT abs(c) AS a, count(*) AS t, count(*) FILTER (WHERE c > 0) AS up FROM a WHERE c <> 0 GROUP BY 1),
r AS (SELECT *, sum(t) OVER (ORDER BY a) - t + (t + 1) / 2.0::DOUBLE AS mean_rank FROM t),
w AS (SELECT CAST(sum(t) AS BIGINT) AS n, sum(up * mean_rank) AS w_plus, sum(t::DOUBLE ** 3 - t) AS tied FROM r)
SELECT n, round(w_plus, 3) AS w_plus, round((w_plus - n::DOUBLE * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - tied / 48), 6) AS z FROM w""",
    ),
    "footer_counts": (q_footers, " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES)),
    "rows_beside": (q_beside, "SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT max(event_id) FROM events) AS last_event"),
}
