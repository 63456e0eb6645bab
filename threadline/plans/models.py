"""Queries for models, resampling, matching and panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadline.functions import columns as X
from threadline.operators import ledger, matching, panel
from threadline.plans.cohorts import RESPONSE_SQL, chains, greedy_sql, triggers
from threadline.sources import bindings as B
from threadline.stats import design, ols, resample
from threadline.stats.resample import drawn_times_sql


def _terms(spark, fit):
    return spark.createDataFrame([(k, round(b, 7), round(s, 7)) for k, b, s in fit.table()], "term string, estimate double, std_error double")


def q_ols(spark, d):
    return _terms(spark, ols.ols(B.labelled(spark, d), "y", {"x": F.col("x")}, "cluster"))


def q_mean(spark, d):
    return _terms(spark, ols.ols(B.labelled(spark, d), "y", {}, "cluster"))


def q_fe(spark, d):
    flat = ols.demean(B.labelled(spark, d), ["y", "x"], "cluster")
    return _terms(spark, ols.ols(flat, "y", {"x": F.col("x")}, "cluster", intercept=False))


def q_control(spark, d):
    return _terms(spark, ols.ols(B.labelled(spark, d), "y", {"x": F.col("x"), "z": F.col("z")}, "cluster"))


def _gaps(spark, d):
    """The labelled frame with nulls in regressors and clusters."""
    i = F.col("doc_id")
    return B.labelled(spark, d).withColumns({"x": F.when(i % 7 != 0, F.col("x")), "z": F.when(i % 11 != 0, F.col("z")), "cluster": F.when(i % 13 != 0, F.col("cluster"))})


def q_complete(spark, d):
    return _terms(spark, ols.ols(_gaps(spark, d), "y", {"x": F.col("x"), "z": F.col("z")}, "cluster"))


def q_reestimates(spark, d):
    """The effect over all rows and without those that a rule flags."""
    z, x = F.col("z"), F.col("x")
    keep = {"all": F.lit(True), "without_short": z > 5.5, "without_long_exposed": ~((x == 1) & (z > 8.5)), "other_sources": F.col("cluster") != "src1"}
    fits = ols.reestimates(_gaps(spark, d), "y", {"x": x}, "cluster", keep)
    rows = [(name, t, round(b, 7) + 0.0, round(s, 7) + 0.0, f.n, f.clusters) for name, f in fits.items() for t, b, s in f.table()]
    return spark.createDataFrame(rows, "selection string, term string, estimate double, std_error double, n bigint, clusters bigint")


def q_fe_complete(spark, d):
    flat = ols.demean(_gaps(spark, d), ["y", "x"], "cluster")
    return _terms(spark, ols.ols(flat, "y", {"x": F.col("x")}, "cluster", intercept=False))


def q_logit_one(spark, d):
    return _terms(spark, ols.logit(_gaps(spark, d), "y", {"x": F.col("x")}, "cluster"))


def _crossed(spark, d):
    docs = B.read_table(spark, d, "documents", ["doc_id", "lang", "n_chars", "source"])
    df = docs.select(F.log1p(F.col("n_chars").cast("double")).alias("y"), F.col("source").alias("cluster"), F.when(F.col("doc_id") % 3 == 0, "yes").otherwise("no").alias("third"), "lang")
    terms = ["C(third)", "C(lang)", "C(third):C(lang)"]
    plan = design.design(df, terms)
    return plan, design.fit(df, "y", plan, "cluster")


def q_design(spark, d):
    return _terms(spark, _crossed(spark, d)[1])


def q_moderation(spark, d):
    """Whether two languages' lengths differ, and whether one source or third of the documents carries it."""
    docs = B.read_table(spark, d, "documents", ["doc_id", "lang", "n_chars", "source"]).filter("lang is not null")
    df = docs.select(F.log1p(F.col("n_chars").cast("double")).alias("y"), "lang", "source", (F.col("doc_id") % 3).alias("third"))
    out = ols.moderation(df, "y", F.col("lang") == "en", F.col("lang") == "fr", {}, "source", ["third", "source"])
    return out.select("check", "detail", *((F.round(c, 7) + 0.0).alias(c) for c in ("estimate", "low", "high")), "n")


def q_wald(spark, d):
    plan, fit = _crossed(spark, d)
    rows = [(t, *fit.wald(plan.joint(t)), fit.rank, fit.n) for t in plan.terms if t != "const"]
    return spark.createDataFrame(rows, "term string, statistic double, df int, p double, rank int, n bigint")


def q_dummies(spark, d):
    df = B.labelled(spark, d)
    fit = ols.ols(df, "y", {"x": F.col("x")} | ols.dummies(df, "cluster"), "doc_id")
    return spark.createDataFrame([("x", round(float(fit.beta[1]), 7))], "term string, estimate double")


def q_loo(spark, d):
    return ols.leave_one_out(B.labelled(spark, d), "y", {"x": F.col("x")}, "cluster").select("cluster", F.round("x", 7).alias("estimate"))


def q_logit(spark, d):
    return _terms(spark, ols.logit(B.labelled(spark, d), "y", {"x": F.col("x"), "z": F.col("z")}, "cluster"))


def q_overlap(spark, d):
    df = ols.overlap_weights(B.labelled(spark, d), "x", {"z": F.col("z")}, "cluster")
    out = matching.balance(df.withColumn("arm", F.col("x") == 1), "arm", ["z"], "overlap_weight")
    return out.select("covariate", F.round("mean0", 7).alias("mean0"), F.round("mean1", 7).alias("mean1"))


def q_balance(spark, d):
    out = matching.balance(B.labelled(spark, d).withColumn("arm", F.col("x") == 1), "arm", ["z", "y"])
    return out.select("covariate", *(F.round(c, 9).alias(c) for c in ("mean0", "mean1", "var0", "var1", "smd")))


def q_effective(spark, d):
    return matching.effective_size(B.labelled(spark, d), "z", "cluster").withColumn("effective_n", F.round("effective_n", 6))


def q_evalues(spark, d):
    df = B.labelled(spark, d)
    arms = df.agg(F.avg(F.when(F.col("x") == 1, F.col("y"))).alias("r1"), F.avg(F.when(F.col("x") == 0, F.col("y"))).alias("r0"))
    rr = X.risk_ratio(F.col("r1") - F.col("r0"), F.col("r0"))
    return arms.select(F.round(rr, 9).alias("risk_ratio"), F.round(X.e_value(rr), 9).alias("e_value"))


def q_tipping(spark, d):
    grid = spark.range(1, 17).select((1 + F.col("id") / 4).alias("a")).crossJoin(spark.range(1, 17).select((1 + F.col("id") / 4).alias("b")))
    bias = F.col("a") * F.col("b") / (F.col("a") + F.col("b") - 1)
    return grid.select("a", "b", F.round(bias, 9).alias("bias"), (bias >= 2.0).alias("explains"))


def q_bootstrap_md5(spark, d):
    df = B.labelled(spark, d)
    sums = resample.cluster_sums(df, "cluster", F.col("y"), F.lit(1.0))
    return resample.hashed_bootstrap(sums, "cluster", 200).withColumn("ratio", F.round("ratio", 9))


def q_bootstrap(spark, d):
    return resample.ratio_bootstrap(B.labelled(spark, d), "cluster", F.col("y"), F.lit(1.0), 300).select(*(F.round(c, 9).alias(c) for c in ("estimate", "low", "high")))


def q_difference(spark, d):
    out = resample.difference_bootstrap(B.labelled(spark, d), "cluster", F.col("x") == 1, F.col("y"), F.lit(1.0), 300)
    return out.select(*(F.round(c, 9).alias(c) for c in ("a", "b", "estimate", "low", "high")))


def q_gradient(spark, d):
    """Merges within the window by what was seen of a trigger, from an exact reply down to nothing."""
    c = chains(spark, d)
    kind = F.when(F.col("exact_replies") > 0, "exact_edge").when((F.col("later_clicks") + F.col("later_views")) > 0, "nonexact_discussion_only").when(F.col("movements") > 0, "movement_only").otherwise("no_visible_activity")
    df = c.select(F.col("merged_within_window").cast("double").alias("y"), kind.alias("seen"), "repo_id")
    nothing, levels = "no_visible_activity", design.levels_of(df, "seen", 4)
    plan = design.design(df, ["C(seen)"], {"seen": nothing if nothing in levels else levels[0]})
    fit = design.fit(df, "y", plan, "repo_id")
    return spark.createDataFrame([(n, *map(float, fit.contrast(w)), fit.n, fit.clusters) for n, w in design.against(plan, "seen", ["exact_edge", "nonexact_discussion_only", "movement_only"], [("exact_edge", "nonexact_discussion_only")])], "contrast string, estimate double, std_error double, n bigint, clusters bigint").withColumns({"estimate": F.round("estimate", 7), "std_error": F.round("std_error", 7)})


def q_poisson(spark, d):
    return resample.poisson_bootstrap(B.labelled(spark, d), "cluster", F.col("y"), F.lit(1.0), 200, 7)


def q_permutation(spark, d):
    flat = ols.demean(B.labelled(spark, d).withColumn("raw", F.col("x")), ["y"], "cluster")
    return resample.permutation_test(flat, "cluster", F.col("raw"), F.col("y"), 200, 5, "doc_id")


def q_route_model(spark, d):
    c = chains(spark, d).withColumn("late", F.col("movements") > 0)
    return _terms(spark, ols.ols(c.withColumn("y", F.col("any_response").cast("double")), "y", {"late": F.col("late").cast("double"), "log1p_clicks": F.log1p(F.col("later_clicks").cast("double"))}, "repo_id"))


_SCALED = ["z_mean_log", "z_slope", "z_mean_rate"]


def _arms(spark, d):
    """Entrants' scaled features: odd repositories stand for treated ones."""
    z = matching.standardise(_features(spark, d), ["mean_log", "slope", "mean_rate"], ["onset_month"])
    odd = F.col("repo_id") % 2 == 1
    return z.filter(odd), z.filter(~odd)


def _caliper_pairs(spark, d):
    return matching.nearest_in_caliper(*_arms(spark, d), ["onset_month"], _SCALED, "repo_id", 1.5)


def q_caliper(spark, d):
    return _caliper_pairs(spark, d).select("onset_month", "exposed_id", "control_id", F.round("distance", 7).alias("distance"))


def q_caliper_once(spark, d):
    out = matching.match_in_caliper(*_arms(spark, d), ["onset_month"], _SCALED, "repo_id", 1.5)
    return out.select("onset_month", "exposed_id", "control_id", F.round("distance", 7).alias("distance"))


def _trigger_pairs(spark, d):
    """Triggers by one product beside those by the other in the same group of repositories, nearest in time, each once."""
    frame = triggers(spark, d).select("pr_id", F.floor(F.col("repo_id") / 5).alias("group"), (F.col("trigger_agent") == "A").alias("arm"), "trigger_dt")
    return matching.nearest_without_replacement(frame, ["group"], "arm", "trigger_dt", "pr_id")


def _features(spark, d):
    pr = B.pull_requests(spark, d)
    late = ledger.second_agent_onset(pr).select("repo_id", F.add_months(F.to_date("onset_dt"), 18).cast("timestamp_ntz").alias("onset_dt"))
    return panel.pre_features(panel.monthly_panel(pr), late)


def q_panel(spark, d):
    return panel.monthly_panel(B.pull_requests(spark, d)).withColumn("merge_rate", F.round("merge_rate", 9))


def q_features(spark, d):
    return _features(spark, d).select("repo_id", "onset_month", *((F.round(c, 9) + 0.0).alias(c) for c in ("mean_log", "slope", "mean_rate")))


def q_contrasts(spark, d):
    out = panel.event_contrasts(_caliper_pairs(spark, d), panel.monthly_panel(B.pull_requests(spark, d)), 3, "n_items")
    return out.groupBy("event_month").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gap"), 9).alias("gap"), F.round(F.avg("did"), 9).alias("did"))


def q_shares(spark, d):
    return panel.task_shares(B.interactions(spark, d), "pr_id", "source").withColumn("share", F.round("share", 9))


def q_available(spark, d):
    return panel.available_before(B.pull_requests(spark, d)).select("pr_id", "n_available")


def q_advantage(spark, d):
    out = panel.shrunken_advantage(B.pull_requests(spark, d).withColumn("task", F.col("repo_id") % 7), "agent", "task", F.col("merged_dt").isNotNull())
    return out.select("agent", "task", "n", F.round("task_rate", 9).alias("task_rate"), F.round("score", 9).alias("score"))


def q_concordance(spark, d):
    c = chains(spark, d).select("pr_id", (F.col("later_clicks") > 3).alias("y"))
    a, b = (c.select(F.col("pr_id").alias(k), F.col("y").alias(y)) for k, y in (("exposed_id", "a"), ("control_id", "b")))
    return matching.concordance(_trigger_pairs(spark, d).join(a, "exposed_id").join(b, "control_id"), "a", "b")


def q_paired(spark, d):
    out = matching.paired_differences(_trigger_pairs(spark, d), chains(spark, d), "pr_id", ["any_response", "later_clicks"])
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("difference"), 9).alias("difference"))


_OLS = f"WITH {B.LABELLED_SQL}, g AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, count(DISTINCT cluster) AS k FROM frame), b AS (SELECT *, n * sxx - sx * sx AS det, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS b0 FROM g)"
_GAPS = "gaps AS (SELECT doc_id, y, CASE WHEN doc_id % 7 <> 0 THEN x END AS x, CASE WHEN doc_id % 11 <> 0 THEN z END AS z, CASE WHEN doc_id % 13 <> 0 THEN cluster END AS cluster FROM frame)"


def _two_sql(frame: str) -> str:
    """An intercept and two regressors over complete cases: what each cluster adds to each estimate, squared and summed."""
    return f"""WITH {B.LABELLED_SQL}, {_GAPS}, f AS (SELECT * FROM {frame} WHERE y IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL AND cluster IS NOT NULL),
m AS (SELECT avg(y) AS my, avg(x) AS mx, avg(z) AS mz, CAST(count(*) AS DOUBLE) AS n, count(DISTINCT cluster) AS k FROM f),
c AS (SELECT sum((x - mx) ** 2) AS sxx, sum((z - mz) ** 2) AS szz, sum((x - mx) * (z - mz)) AS sxz, sum((x - mx) * (y - my)) AS sxy, sum((z - mz) * (y - my)) AS szy FROM f, m),
b AS (SELECT *, sxx * szz - sxz * sxz AS det, (szz * sxy - sxz * szy) / (sxx * szz - sxz * sxz) AS bx, (sxx * szy - sxz * sxy) / (sxx * szz - sxz * sxz) AS bz FROM c, m),
e AS (SELECT cluster, x - mx AS x, z - mz AS z, y - my - bx * (x - mx) - bz * (z - mz) AS r FROM f, b),
g AS (SELECT cluster, sum(r) AS u, sum(x * r) AS sx, sum(z * r) AS sz FROM e GROUP BY 1),
i AS (SELECT (szz * sx - sxz * sz) / det AS ix, (sxx * sz - sxz * sx) / det AS iz, u / n - mx * (szz * sx - sxz * sz) / det - mz * (sxx * sz - sxz * sx) / det AS ic FROM g, b),
v AS (SELECT sum(ic * ic) AS vc, sum(ix * ix) AS vx, sum(iz * iz) AS vz FROM i), s AS (SELECT k / (k - 1.0::DOUBLE) * (n - 1) / (n - 3) AS scale FROM m)
SELECT 'const' AS term, round(my - bx * mx - bz * mz, 7) AS estimate, round(sqrt(vc * scale), 7) AS std_error FROM b, v, s UNION ALL SELECT 'x', round(bx, 7), round(sqrt(vx * scale), 7) FROM b, v, s UNION ALL SELECT 'z', round(bz, 7), round(sqrt(vz * scale), 7) FROM b, v, s"""


_LOGIT_ONE = f"""WITH {B.LABELLED_SQL}, {_GAPS}, f AS (SELECT * FROM gaps WHERE y IS NOT NULL AND x IS NOT NULL AND cluster IS NOT NULL),
p AS (SELECT avg(y) FILTER (WHERE x = 0) AS p0, avg(y) FILTER (WHERE x = 1) AS p1, CAST(count(*) FILTER (WHERE x = 0) AS DOUBLE) AS n0, CAST(count(*) FILTER (WHERE x = 1) AS DOUBLE) AS n1, count(DISTINCT cluster) AS k FROM f),
g AS (SELECT cluster, coalesce(sum(y - p0) FILTER (WHERE x = 0), 0) / any_value(n0 * p0 * (1 - p0)) AS i0, coalesce(sum(y - p1) FILTER (WHERE x = 1), 0) / any_value(n1 * p1 * (1 - p1)) AS i1 FROM f, p GROUP BY 1),
v AS (SELECT sum(i0 ** 2) AS v0, sum((i1 - i0) ** 2) AS v1 FROM g)
SELECT 'const' AS term, round(ln(p0 / (1 - p0)), 7) AS estimate, round(sqrt(v0 * k / (k - 1.0::DOUBLE)), 7) AS std_error FROM p, v UNION ALL SELECT 'x', round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 7), round(sqrt(v1 * k / (k - 1.0::DOUBLE)), 7) FROM p, v"""
#: A saturated model's estimates are combinations of the means of cells.
_CELLS = """WITH f AS (SELECT ln(1 + CAST(n_chars AS DOUBLE)) AS y, source AS cluster, CASE WHEN doc_id % 3 = 0 THEN 'yes' ELSE 'no' END AS third, lang FROM documents WHERE n_chars IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL),
c AS (SELECT third, lang, avg(y) AS m, CAST(count(*) AS DOUBLE) AS n FROM f GROUP BY 1, 2), r AS (SELECT min(lang) AS ref FROM f),
t AS (SELECT 'const' AS term, 'no' AS third, ref AS lang, 1 AS w FROM r UNION ALL SELECT 'third=yes', v.l, ref, v.w FROM r, (VALUES ('yes', 1), ('no', -1)) v(l, w)
  UNION ALL SELECT 'lang=' || k.lang, 'no', u.lang, u.w FROM (SELECT DISTINCT lang FROM f) k, r, LATERAL (VALUES (k.lang, 1), (ref, -1)) u(lang, w) WHERE k.lang <> ref
  UNION ALL SELECT 'third=yes:lang=' || k.lang, v.l, u.lang, u.w * v.w FROM (SELECT DISTINCT lang FROM f) k, r, (VALUES ('yes', 1), ('no', -1)) v(l, w), LATERAL (VALUES (k.lang, 1), (ref, -1)) u(lang, w) WHERE k.lang <> ref),
q AS (SELECT term, sum(w * m) AS estimate FROM t JOIN c USING (third, lang) GROUP BY 1),
g AS (SELECT cluster, third, lang, sum(y - m) / any_value(n) AS s FROM f JOIN c USING (third, lang) GROUP BY 1, 2, 3),
i AS (SELECT term, cluster, sum(w * s) AS s FROM t JOIN g USING (third, lang) GROUP BY 1, 2), z AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(DISTINCT cluster) AS k, (SELECT count(*) FROM c) AS p FROM f)
SELECT term, round(any_value(estimate), 7) AS estimate, round(sqrt(sum(s * s) * any_value(k / (k - 1.0::DOUBLE) * (n - 1) / (n - p))), 7) AS std_error FROM q JOIN i USING (term), z GROUP BY term"""
_FE_GAPS = f"""WITH {B.LABELLED_SQL}, {_GAPS}, f AS (SELECT * FROM gaps WHERE y IS NOT NULL AND x IS NOT NULL AND cluster IS NOT NULL), m AS (SELECT cluster, y - avg(y) OVER (PARTITION BY cluster) AS y, x - avg(x) OVER (PARTITION BY cluster) AS x FROM f),
b AS (SELECT sum(x * y) / sum(x * x) AS b1, sum(x * x) AS sxx, CAST(count(*) AS DOUBLE) AS n, count(DISTINCT cluster) AS k FROM m), s AS (SELECT cluster, sum(x * (y - b1 * x)) AS s FROM m, b GROUP BY 1)
SELECT 'x' AS term, round(any_value(b1), 7) AS estimate, round(sqrt(sum(s * s) / any_value(sxx * sxx) * any_value(k / (k - 1.0::DOUBLE) * (n - 1) / (n - 1))), 7) AS std_error FROM s, b"""
_PANEL = B.PR_SQL + """,
pa AS (SELECT repo_id, CAST(date_trunc('month', created_dt) AS TIMESTAMP) AS month, count(*) AS n_items, count(DISTINCT agent) AS n_agents, avg(CASE WHEN merged_dt IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS merge_rate FROM pr GROUP BY 1, 2),
seen AS (SELECT repo_id, agent, min(created_dt) AS seen_dt FROM pr GROUP BY 1, 2),
onset AS (SELECT repo_id, CAST(date_trunc('month', seen_dt + INTERVAL 18 MONTH) AS TIMESTAMP) AS onset_month FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY seen_dt, agent) AS k FROM seen) WHERE k = 2),
em AS (SELECT repo_id, onset_month, (year(month) - year(onset_month)) * 12 + month(month) - month(onset_month) AS m, ln(1 + CAST(n_items AS DOUBLE)) AS v, merge_rate FROM pa JOIN onset USING (repo_id)),
ft AS (SELECT repo_id, onset_month, avg(v) AS mean_log, regr_slope(v, CAST(m AS DOUBLE)) AS slope, avg(merge_rate) AS mean_rate FROM em WHERE m BETWEEN -3 AND -1 GROUP BY 1, 2 HAVING count(*) = 3)"""
_CALIPER = _PANEL + """,
z AS (SELECT *, coalesce((mean_log - avg(mean_log) OVER w) / nullif(stddev_pop(mean_log) OVER w, 0), 0) AS a, coalesce((slope - avg(slope) OVER w) / nullif(stddev_pop(slope) OVER w, 0), 0) AS b,
  coalesce((mean_rate - avg(mean_rate) OVER w) / nullif(stddev_pop(mean_rate) OVER w, 0), 0) AS c FROM ft WINDOW w AS (PARTITION BY onset_month)),
cq AS (SELECT * FROM (SELECT e.onset_month, e.repo_id AS exposed_id, o.repo_id AS control_id, sqrt((e.a - o.a) ** 2 + (e.b - o.b) ** 2 + (e.c - o.c) ** 2) AS distance FROM z e JOIN z o ON e.onset_month = o.onset_month AND e.repo_id % 2 = 1 AND o.repo_id % 2 = 0) WHERE distance <= 1.5),
cp AS (SELECT onset_month, exposed_id, control_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY exposed_id ORDER BY distance, control_id) AS k FROM cq) WHERE k = 1)"""
_TURNS = _CALIPER + """,
ce AS (SELECT onset_month, exposed_id, list({'d': distance, 'c': control_id}) AS near, row_number() OVER (ORDER BY onset_month, exposed_id) AS k FROM cq GROUP BY 1, 2),
ct AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS TIMESTAMP) AS onset_month, CAST(NULL AS BIGINT) AS exposed_id, CAST(NULL AS STRUCT(d DOUBLE, c BIGINT)) AS pick
  UNION ALL
  SELECT k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.c) END, onset_month, exposed_id, pick FROM (
    SELECT ce.k, ct.used, ce.onset_month, ce.exposed_id, list_min(list_filter(ce.near, lambda x: NOT list_contains(ct.used, x.c))) AS pick FROM ct JOIN ce ON ce.k = ct.k + 1))"""
_CH = RESPONSE_SQL + ", ch AS (SELECT tr.pr_id, coalesce(n, 0) > 0 AS any_response, coalesce(c, 0) AS later_clicks FROM tr LEFT JOIN (SELECT pr_id, count(*) AS n, count(*) FILTER (WHERE source = 'click') AS c FROM rs GROUP BY 1) k USING (pr_id))"
_PAIRS = f"WITH RECURSIVE {_CH}, " + greedy_sql("SELECT repo_id // 5 AS stratum, pr_id AS id, trigger_agent = 'A' AS arm, epoch_us(trigger_dt) AS t FROM tr") + ", p AS (SELECT a.any_response AS ra, b.any_response AS rb, a.later_clicks AS ca, b.later_clicks AS cb FROM mt JOIN ch a ON a.pr_id = CAST(exposed_id AS BIGINT) JOIN ch b ON b.pr_id = CAST(control_id AS BIGINT))"

QUERIES = {
    "ols_clustered": (
        q_ols,
        _OLS
        + """, s AS (SELECT cluster, sum(y - b0 - b1 * x) AS s0, sum(x * (y - b0 - b1 * x)) AS s1 FROM frame, b GROUP BY 1),
v AS (SELECT sum(((sxx * s0 - sx * s1) / det) ** 2) AS v0, sum(((n * s1 - sx * s0) / det) ** 2) AS v1, any_value(k / (k - 1.0::DOUBLE) * (n - 1) / (n - 2)) AS scale FROM s, b)
SELECT 'const' AS term, round(b0, 7) AS estimate, round(sqrt(v0 * scale), 7) AS std_error FROM b, v UNION ALL SELECT 'x', round(b1, 7), round(sqrt(v1 * scale), 7) FROM b, v""",
    ),
    "clustered_mean": (
        q_mean,
        f"WITH {B.LABELLED_SQL}, g AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(y) AS m, count(DISTINCT cluster) AS k FROM frame), s AS (SELECT cluster, sum(y - m) AS s FROM frame, g GROUP BY 1) SELECT 'const' AS term, round(any_value(m), 7) AS estimate, round(sqrt(sum(s * s) / any_value(n * n) * any_value(k / (k - 1.0::DOUBLE))), 7) AS std_error FROM s, g",
    ),
    "fixed_effects_lpm": (
        q_fe,
        f"""WITH {B.LABELLED_SQL}, m AS (SELECT cluster, y - avg(y) OVER (PARTITION BY cluster) AS y, x - avg(x) OVER (PARTITION BY cluster) AS x FROM frame),
b AS (SELECT sum(x * y) / sum(x * x) AS b1, sum(x * x) AS sxx, CAST(count(*) AS DOUBLE) AS n, count(DISTINCT cluster) AS k FROM m), s AS (SELECT cluster, sum(x * (y - b1 * x)) AS s FROM m, b GROUP BY 1)
SELECT 'x' AS term, round(any_value(b1), 7) AS estimate, round(sqrt(sum(s * s) / any_value(sxx * sxx) * any_value(k / (k - 1.0::DOUBLE) * (n - 1) / (n - 1))), 7) AS std_error FROM s, b""",
    ),
    "fixed_effects_by_dummies": (q_dummies, f"WITH {B.LABELLED_SQL}, m AS (SELECT y - avg(y) OVER (PARTITION BY cluster) AS y, x - avg(x) OVER (PARTITION BY cluster) AS x FROM frame) SELECT 'x' AS term, round(sum(x * y) / sum(x * x), 7) AS estimate FROM m"),
    "ols_with_control": (q_control, _two_sql("frame")),
    "ols_complete_cases": (q_complete, _two_sql("gaps")),
    "reestimates": (
        q_reestimates,
        f"""WITH {B.LABELLED_SQL}, {_GAPS}, f AS (SELECT y, x, cluster, s.selection FROM gaps, (VALUES ('all'), ('without_short'), ('without_long_exposed'), ('other_sources')) s(selection) WHERE y IS NOT NULL AND x IS NOT NULL AND cluster IS NOT NULL
  AND CASE s.selection WHEN 'all' THEN true WHEN 'without_short' THEN z > 5.5 WHEN 'without_long_exposed' THEN NOT (x = 1 AND z > 8.5) ELSE cluster <> 'src1' END),
g AS (SELECT selection, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, count(DISTINCT cluster) AS k FROM f GROUP BY 1), b AS (SELECT *, n * sxx - sx * sx AS det, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS b0 FROM g),
s AS (SELECT selection, cluster, sum(y - b0 - b1 * x) AS s0, sum(x * (y - b0 - b1 * x)) AS s1 FROM f JOIN b USING (selection) GROUP BY 1, 2),
v AS (SELECT selection, sum(((sxx * s0 - sx * s1) / det) ** 2) AS v0, sum(((n * s1 - sx * s0) / det) ** 2) AS v1, any_value(k / (k - 1.0::DOUBLE) * (n - 1) / (n - 2)) AS scale FROM s JOIN b USING (selection) GROUP BY 1)
SELECT selection, 'const' AS term, round(b0, 7) + 0.0 AS estimate, round(sqrt(v0 * scale), 7) + 0.0 AS std_error, CAST(n AS BIGINT) AS n, k AS clusters FROM b JOIN v USING (selection) UNION ALL SELECT selection, 'x', round(b1, 7) + 0.0, round(sqrt(v1 * scale), 7) + 0.0, CAST(n AS BIGINT), k FROM b JOIN v USING (selection)""",
    ),
    "fixed_effects_complete_cases": (q_fe_complete, _FE_GAPS),
    "logit_one_exposure": (q_logit_one, _LOGIT_ONE),
    "design_interactions": (q_design, _CELLS),
    "wald_terms": (q_wald, None),
    "moderation_robustness": (
        q_moderation,
        """WITH f AS (SELECT ln(1 + CAST(n_chars AS DOUBLE)) AS y, CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS a, CASE WHEN lang = 'fr' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b, source, doc_id % 3 AS third FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL AND source IS NOT NULL AND doc_id IS NOT NULL),
z AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(DISTINCT source) AS k, sum(a * y) / sum(a) AS ma, sum(b * y) / sum(b) AS mb, sum((1 - a - b) * y) / sum(1 - a - b) AS m0, sum(a) AS na, sum(b) AS nb FROM f),
i AS (SELECT source, sum(a * (y - ma)) / any_value(na) - sum(b * (y - mb)) / any_value(nb) AS i FROM f, z GROUP BY 1),
pr AS (SELECT ma - mb AS e, sqrt((SELECT sum(i * i) FROM i) * k / (k - 1.0::DOUBLE) * (n - 1) / (n - 3)) AS se FROM z),
d AS (SELECT source, y - avg(y) OVER w AS y, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b FROM f WINDOW w AS (PARTITION BY source)),
s AS (SELECT sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS by_ FROM d), c AS (SELECT *, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS ea, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS eb, aa * bb - ab * ab AS det FROM s),
g AS (SELECT source, sum(a * (y - ea * a - eb * b)) AS sa, sum(b * (y - ea * a - eb * b)) AS sb FROM d, c GROUP BY 1), j AS (SELECT sum((((bb + ab) * sa - (aa + ab) * sb) / det) ** 2) AS v FROM g, c),
fe AS (SELECT ea - eb AS e, sqrt(v * k / (k - 1.0::DOUBLE) * (n - 1) / (n - 2)) AS se FROM c, j, z),
lo AS (SELECT detail, (ta - ya) / (tn - na) - (tb - yb) / (tm - nb) AS d FROM (SELECT *, sum(ya) OVER w AS ta, sum(na) OVER w AS tn, sum(yb) OVER w AS tb, sum(nb) OVER w AS tm FROM (
  SELECT u.k AS detail, u.v AS grp, sum(a * y) AS ya, sum(a) AS na, sum(b * y) AS yb, sum(b) AS nb FROM (SELECT *, unnest([{'k': 'third', 'v': CAST(third AS VARCHAR)}, {'k': 'source', 'v': source}]) AS u FROM f) GROUP BY 1, 2) WINDOW w AS (PARTITION BY detail)) WHERE tn > na AND tm > nb)
SELECT 'primary' AS "check", 'source' AS detail, round(e, 7) + 0.0 AS estimate, round(e - 1.959963984540054 * se, 7) + 0.0 AS low, round(e + 1.959963984540054 * se, 7) + 0.0 AS high, CAST(n AS BIGINT) AS n FROM pr, z
UNION ALL SELECT 'fixed_effects', 'source', round(e, 7) + 0.0, round(e - 1.959963984540054 * se, 7) + 0.0, round(e + 1.959963984540054 * se, 7) + 0.0, CAST(n AS BIGINT) FROM fe, z
UNION ALL SELECT 'leave_one_out', detail, round(median(d), 7) + 0.0, round(min(d), 7) + 0.0, round(max(d), 7) + 0.0, CAST(any_value(n) AS BIGINT) FROM lo, z GROUP BY detail""",
    ),
    "leave_one_cluster_out_ols": (q_loo, f"WITH {B.LABELLED_SQL} SELECT c.cluster, round(regr_slope(f.y, f.x), 7) AS estimate FROM (SELECT DISTINCT cluster FROM frame) c JOIN frame f ON f.cluster <> c.cluster GROUP BY 1"),
    "logit_clustered": (q_logit, None),
    "overlap_weighting": (q_overlap, None),
    "covariate_balance": (
        q_balance,
        f"""WITH {B.LABELLED_SQL}, l AS (SELECT x, unnest([{{'c': 'z', 'v': z}}, {{'c': 'y', 'v': y}}]) AS u FROM frame), a AS (SELECT u.c AS covariate, avg(u.v) FILTER (WHERE x = 0) AS m0, avg(u.v) FILTER (WHERE x = 1) AS m1, var_samp(u.v) FILTER (WHERE x = 0) AS v0, var_samp(u.v) FILTER (WHERE x = 1) AS v1 FROM l GROUP BY 1)
SELECT covariate, round(m0, 9) AS mean0, round(m1, 9) AS mean1, round(v0, 9) AS var0, round(v1, 9) AS var1, round((m1 - m0) / sqrt((v0 + v1) / 2), 9) AS smd FROM a""",
    ),
    "effective_sample_size": (q_effective, f"WITH {B.LABELLED_SQL} SELECT cluster, round(sum(z) * sum(z) / sum(z * z), 6) AS effective_n FROM frame GROUP BY 1"),
    "e_values": (q_evalues, f"WITH {B.LABELLED_SQL}, a AS (SELECT avg(y) FILTER (WHERE x = 1) / avg(y) FILTER (WHERE x = 0) AS rr FROM frame), r AS (SELECT rr, CASE WHEN rr < 1 THEN 1 / rr ELSE rr END AS q FROM a) SELECT round(rr, 9) AS risk_ratio, round(q + sqrt(q * (q - 1)), 9) AS e_value FROM r"),
    "tipping_grid": (q_tipping, "SELECT 1 + i / 4.0::DOUBLE AS a, 1 + j / 4.0::DOUBLE AS b, round((1 + i / 4.0::DOUBLE) * (1 + j / 4.0::DOUBLE) / (1 + i / 4.0::DOUBLE + j / 4.0::DOUBLE), 9) AS bias, (1 + i / 4.0::DOUBLE) * (1 + j / 4.0::DOUBLE) / (1 + i / 4.0::DOUBLE + j / 4.0::DOUBLE) >= 2.0 AS explains FROM range(1, 17) x(i), range(1, 17) y(j)"),
    "hashed_bootstrap": (
        q_bootstrap_md5,
        f"""WITH {B.LABELLED_SQL}, c AS (SELECT row_number() OVER (ORDER BY cluster) - 1 AS k, sum(y) AS num, CAST(count(*) AS DOUBLE) AS den FROM frame GROUP BY cluster), z AS (SELECT count(*) AS n FROM c),
p AS (SELECT draw, CAST(('0x' || substr(md5(draw || ':' || place), 1, 8)) AS BIGINT) % n AS k FROM range(200) a(draw), z, range(1000) b(place) WHERE place < n)
SELECT draw, round(sum(num) / sum(den), 9) AS ratio FROM p JOIN c USING (k) GROUP BY 1""",
    ),
    "cluster_bootstrap": (
        q_bootstrap,
        f"""WITH {B.LABELLED_SQL}, s AS (SELECT cluster, sum(y) AS num, CAST(count(*) AS DOUBLE) AS den FROM frame GROUP BY 1), w AS (SELECT s.*, draw, {drawn_times_sql("draw", "cluster")} AS t FROM s, range(300) r(draw)),
b AS (SELECT draw, sum(t * num) / nullif(sum(t * den), 0) AS ratio FROM w WHERE t > 0 GROUP BY 1) SELECT (SELECT round(sum(num) / sum(den), 9) FROM s) AS estimate, round(quantile_cont(ratio, 0.025), 9) AS low, round(quantile_cont(ratio, 0.975), 9) AS high FROM b""",
    ),
    "difference_bootstrap": (
        q_difference,
        f"""WITH {B.LABELLED_SQL}, s AS (SELECT cluster, coalesce(sum(y) FILTER (WHERE x = 1), 0) AS an, CAST(count(*) FILTER (WHERE x = 1) AS DOUBLE) AS ad, coalesce(sum(y) FILTER (WHERE x <> 1), 0) AS bn, CAST(count(*) FILTER (WHERE x <> 1) AS DOUBLE) AS bd FROM frame GROUP BY 1),
w AS (SELECT s.*, draw, {drawn_times_sql("draw", "cluster")} AS t FROM s, range(300) r(draw)), b AS (SELECT draw, sum(t * an) / nullif(sum(t * ad), 0) - sum(t * bn) / nullif(sum(t * bd), 0) AS d FROM w WHERE t > 0 GROUP BY 1),
e AS (SELECT sum(an) / nullif(sum(ad), 0) AS a, sum(bn) / nullif(sum(bd), 0) AS b FROM s)
SELECT round(any_value(a), 9) AS a, round(any_value(e.b), 9) AS b, round(any_value(a - e.b), 9) AS estimate, round(quantile_cont(d, 0.025), 9) AS low, round(quantile_cont(d, 0.975), 9) AS high FROM b, e""",
    ),
    "response_gradient": (
        q_gradient,
        f"""WITH {RESPONSE_SQL}, k AS (SELECT pr_id, count(*) FILTER (WHERE exact_reply) AS a, count(*) FILTER (WHERE source IN ('click', 'view')) AS b, count(*) FILTER (WHERE source = 'purchase') AS c FROM rs GROUP BY 1),
f AS (SELECT repo_id, CASE WHEN merged_dt > trigger_dt AND merged_dt <= trigger_dt + INTERVAL 7 DAY THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, CASE WHEN a > 0 THEN 'exact_edge' WHEN b > 0 THEN 'nonexact_discussion_only' WHEN c > 0 THEN 'movement_only' ELSE 'no_visible_activity' END AS seen FROM tr LEFT JOIN k USING (pr_id)),
m AS (SELECT seen, avg(y) AS m, CAST(count(*) AS DOUBLE) AS n FROM f GROUP BY 1), r AS (SELECT coalesce(max(seen) FILTER (WHERE seen = 'no_visible_activity'), min(seen)) AS base FROM f),
t AS (SELECT seen || ' vs ' || base AS contrast, seen AS hi, base AS lo FROM m, r WHERE seen <> base AND seen <> 'no_visible_activity' UNION ALL SELECT 'exact_edge vs nonexact_discussion_only', 'exact_edge', 'nonexact_discussion_only' FROM r WHERE base NOT IN ('exact_edge', 'nonexact_discussion_only') AND (SELECT count(*) FROM m WHERE seen IN ('exact_edge', 'nonexact_discussion_only')) = 2),
g AS (SELECT repo_id, seen, sum(y - m) / any_value(n) AS s FROM f JOIN m USING (seen) GROUP BY 1, 2),
i AS (SELECT contrast, repo_id, sum(CASE WHEN seen = hi THEN s WHEN seen = lo THEN -s ELSE 0 END) AS s FROM t CROSS JOIN g GROUP BY 1, 2), z AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(DISTINCT repo_id) AS k, (SELECT count(*) FROM m) AS p FROM f)
SELECT t.contrast, round(any_value(h.m - l.m), 7) AS estimate, round(sqrt(sum(s * s) * any_value(k / (k - 1.0::DOUBLE) * (z.n - 1) / (z.n - p))), 7) AS std_error, CAST(any_value(z.n) AS BIGINT) AS n, any_value(k) AS clusters
FROM t JOIN m h ON h.seen = hi JOIN m l ON l.seen = lo JOIN i USING (contrast), z GROUP BY 1""",
    ),
    "poisson_bootstrap": (q_poisson, None),
    "permutation_null": (q_permutation, None),
    "response_model": (q_route_model, None),
    "monthly_panel": (q_panel, f"WITH {_PANEL} SELECT repo_id, month, n_items, n_agents, round(merge_rate, 9) AS merge_rate FROM pa"),
    "pre_onset_features": (q_features, f"WITH {_PANEL} SELECT repo_id, onset_month, round(mean_log, 9) AS mean_log, round(slope, 9) + 0.0 AS slope, round(mean_rate, 9) AS mean_rate FROM ft"),
    "caliper_matching": (q_caliper, f"WITH {_CALIPER}\nSELECT onset_month, exposed_id, control_id, round(distance, 7) AS distance FROM cp"),
    "caliper_matching_once": (q_caliper_once, f"WITH RECURSIVE {_TURNS}\nSELECT onset_month, exposed_id, pick.c AS control_id, round(pick.d, 7) AS distance FROM ct WHERE pick IS NOT NULL"),
    "event_month_contrasts": (
        q_contrasts,
        f"""WITH {_CALIPER}, g AS (SELECT exposed_id AS e, control_id AS c, onset_month, CAST(k - 3 AS INTEGER) AS event_month, onset_month + to_months(CAST(k - 3 AS INTEGER)) AS month FROM cp, range(7) r(k)),
d AS (SELECT e, event_month, CAST(coalesce(a.n_items, 0) - coalesce(b.n_items, 0) AS DOUBLE) AS gap FROM g LEFT JOIN pa a ON a.repo_id = e AND a.month = g.month LEFT JOIN pa b ON b.repo_id = c AND b.month = g.month),
f AS (SELECT *, gap - max(CASE WHEN event_month = -1 THEN gap END) OVER (PARTITION BY e) AS did FROM d) SELECT event_month, count(*) AS n, round(avg(gap), 9) AS gap, round(avg(did), 9) AS did FROM f GROUP BY 1""",
    ),
    "task_shares": (q_shares, f"WITH {B.IX_SQL} SELECT pr_id, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY pr_id), 9) AS share FROM ix GROUP BY 1, 2"),
    "available_agents": (
        q_available,
        f"WITH {B.PR_SQL}, f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY repo_id, agent ORDER BY created_dt, pr_id) = 1 THEN 1 ELSE 0 END AS fresh FROM pr) SELECT pr_id, CAST(coalesce(sum(fresh) OVER (PARTITION BY repo_id ORDER BY created_dt, pr_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_available FROM f",
    ),
    "shrunken_advantage": (
        q_advantage,
        f"WITH {B.PR_SQL}, b AS (SELECT agent, repo_id % 7 AS task, count(*) AS n, CAST(count(merged_dt) AS DOUBLE) AS wins FROM pr GROUP BY 1, 2), r AS (SELECT *, sum(wins) OVER (PARTITION BY task) / sum(n) OVER (PARTITION BY task) AS task_rate FROM b) SELECT agent, task, n, round(task_rate, 9) AS task_rate, round((wins + 10 * task_rate) / (n + 10), 9) AS score FROM r",
    ),
    "pair_concordance": (
        q_concordance,
        _PAIRS + " SELECT count(*) FILTER (WHERE ca > 3 AND cb > 3) AS \"both\", count(*) FILTER (WHERE ca > 3 AND cb <= 3) AS only_exposed, count(*) FILTER (WHERE ca <= 3 AND cb > 3) AS only_control, count(*) FILTER (WHERE ca <= 3 AND cb <= 3) AS neither FROM p",
    ),
    "paired_differences": (
        q_paired,
        _PAIRS + " SELECT 'any_response' AS outcome, count(*) AS n, round(avg(CAST(ra AS DOUBLE) - CAST(rb AS DOUBLE)), 9) AS difference FROM p UNION ALL SELECT 'later_clicks', count(*), round(avg(CAST(ca - cb AS DOUBLE)), 9) FROM p",
    ),
}
