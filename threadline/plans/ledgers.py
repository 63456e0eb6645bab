"""Queries over transition ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.functions import columns as X
from threadline.operators import asof, ledger
from threadline.sources import bindings as B

MATURE = "1998-06-01"

_ONSET_SQL = """,
seen AS (SELECT repo_id, agent, min(created_dt) AS seen_dt FROM pr GROUP BY 1, 2),
onset AS (SELECT repo_id, seen_dt AS onset_dt FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY seen_dt, agent) AS k FROM seen) WHERE k = 2)"""
_VALID = "closed_dt IS NOT NULL AND closed_dt >= created_dt AND (merged_dt IS NULL OR merged_dt >= created_dt)"
LEDGER_SQL = (
    B.PR_SQL
    + _ONSET_SQL
    + f""",
cur AS (SELECT pr.* FROM pr JOIN onset USING (repo_id) WHERE created_dt <= TIMESTAMP '{MATURE}' AND created_dt >= onset_dt),
prior AS (SELECT *, count(*) OVER (PARTITION BY repo_id, closed_dt) AS tie_n, max(pr_id) OVER (PARTITION BY repo_id, closed_dt) AS last_id FROM pr WHERE {_VALID}),
j AS (SELECT c.*, p.pr_id AS prior_pr_id, p.agent AS prior_agent, p.user_id AS prior_user_id, p.closed_dt AS prior_closed_dt, p.merged_dt AS prior_merged_dt, p.tie_n
  FROM cur c ASOF JOIN (SELECT * FROM prior WHERE pr_id = last_id) p ON c.repo_id = p.repo_id AND c.created_dt > p.closed_dt),
led AS (SELECT *, agent <> prior_agent AS switched, user_id = prior_user_id AS same_user, datesub('second', prior_closed_dt, created_dt) / 3600.0 AS gap_hours,
    coalesce(merged_dt <= created_dt + INTERVAL 30 DAY, false) AS merged_in_time, strftime(created_dt, '%Y-%m') AS calendar_month
  FROM (SELECT *, row_number() OVER (PARTITION BY prior_pr_id ORDER BY created_dt, pr_id) AS k FROM j
    WHERE prior_pr_id <> pr_id AND tie_n = 1 AND (prior_merged_dt IS NULL OR prior_merged_dt < created_dt)) WHERE k = 1)"""
)


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    return ledger.transitions(B.pull_requests(spark, d), F.lit(MATURE).cast("timestamp_ntz"))


def q_summary(spark, d):
    out = ledger.group_summary(B.pull_requests(spark, d))
    return out.withColumn("merge_rate", F.round("merge_rate", 9))


def q_onset(spark, d):
    return ledger.second_agent_onset(B.pull_requests(spark, d))


def q_ledger(spark, d):
    return _ledger(spark, d).select("pr_id", "repo_id", "prior_pr_id", "prior_agent", "switched", "same_user", F.round("gap_hours", 6).alias("gap_hours"), "merged_in_time", "calendar_month")


def _effects(rows, by):
    out = ledger.switch_effects(rows, by)
    return out.select(by, "stay_n", "switch_n", *((F.round(c, 7) + 0.0).alias(c) for c in ("stay_rate", "switch_rate", "effect_pp", "low_pp", "high_pp")))


def q_effects_agent(spark, d):
    return _effects(_ledger(spark, d), "agent")


def q_effects_stars(spark, d):
    r = F.col("repo_id")
    return _effects(_ledger(spark, d).withColumn("star_bin", ledger.star_bin(F.when(r % 13 != 0, r * r % 211 * (r % 2)))), "star_bin")


def q_asof(spark, d):
    pr = B.pull_requests(spark, d)
    out = asof.asof_join(pr, pr.filter(X.valid_resolution()), "created_dt", "closed_dt", ["repo_id"], ["pr_id", "closed_dt"], tie=["pr_id"])
    return out.select("pr_id", "prior_pr_id", "prior_closed_dt")


def q_asof_ranges(spark, d):
    """The same by ranges of time, for keys that are too busy for one task."""
    pr = B.pull_requests(spark, d).withColumn("half", F.col("repo_id") % 2)
    out = asof.asof_join(pr, pr.filter(X.valid_resolution()), "created_dt", "closed_dt", ["half"], ["pr_id", "closed_dt"], tie=["pr_id"], ranges=32)
    return out.select("pr_id", "prior_pr_id", "prior_closed_dt")


def q_asof_loose(spark, d):
    pr = B.pull_requests(spark, d)
    out = asof.asof_join(pr, pr.filter(X.valid_resolution()), "created_dt", "closed_dt", ["repo_id"], ["pr_id", "closed_dt"], strict=False, tie=["pr_id"])
    return out.select("pr_id", "prior_pr_id", "prior_closed_dt")


def q_matrix(spark, d):
    out = ledger.transition_matrix(_ledger(spark, d))
    return out.select("prior_agent", "agent", "n", F.round("rate", 9).alias("rate"), F.round("share", 9).alias("share"))


def q_rates(spark, d):
    p = F.col("merged_in_time")
    return _ledger(spark, d).groupBy(F.col("prior_merged_dt").isNotNull().alias("prior_merged"), "switched").agg(F.count(F.lit(1)).alias("n"), F.round(X.rate(p), 9).alias("rate"), F.round(X.half_width(p), 9).alias("half_width"))


def q_types(spark, d):
    n = F.count(F.lit(1))
    from pyspark.sql.window import Window

    return _ledger(spark, d).groupBy("transition_type").agg(n.alias("n"), F.round(n / F.sum(n).over(Window.partitionBy(F.lit(0))), 9).alias("share"))


def q_paired(spark, d):
    out = ledger.paired_by_group(_ledger(spark, d), "repo_id", "switched", "merged_in_time")
    return out.select("repo_id", "n0", "n1", *(F.round(c, 9).alias(c) for c in ("rate0", "rate1", "difference")))


def q_strata(spark, d):
    out = ledger.within_strata(_ledger(spark, d), ["repo_id", "agent"], "switched", "merged_in_time")
    return out.select("repo_id", "agent", "n0", "n1", *(F.round(c, 9).alias(c) for c in ("rate0", "rate1", "difference", "weight")))


def q_event_study(spark, d):
    out = ledger.event_study(B.pull_requests(spark, d))
    return out.select(F.col("event_index").cast("bigint").alias("event_index"), "n", F.round("rate", 9).alias("rate"), F.round("half_width", 9).alias("half_width"))


def q_resolved(spark, d):
    return ledger.resolved_events(B.pull_requests(spark, d)).select("pr_id", "repo_id", "known_dt")


def q_streaks(spark, d):
    out = ledger.streaks(ledger.decision_chains(B.pull_requests(spark, d)))
    return out.select("pr_id", "p1_pr_id", "p2_pr_id", "p3_pr_id", "streak")


def q_streak_rates(spark, d):
    out = ledger.streaks(ledger.decision_chains(B.pull_requests(spark, d))).join(B.pull_requests(spark, d).select("pr_id", "merged_dt"), "pr_id")
    return out.groupBy("streak").agg(F.count(F.lit(1)).alias("n"), F.round(X.rate(F.col("merged_dt").isNotNull()), 9).alias("rate"))


def _successors(spark, d):
    mature, generic = F.lit(MATURE).cast("timestamp_ntz"), F.col("filename") % 10 == 0
    return ledger.file_successors(B.pull_requests(spark, d), B.changed_files(spark, d), cutoff=mature, generic=generic)


def _issues(spark, d):
    pairs = _ledger(spark, d).select("pr_id", "prior_pr_id", "repo_id", "agent", "prior_agent", "user_id", "prior_user_id", "merged_in_time")
    return ledger.link_continuity(pairs, B.linked_issues(spark, d), "pr_id", "prior_pr_id", "pr_id", "issue_id")


def q_issues(spark, d):
    return _issues(spark, d).select("pr_id", "prior_pr_id", "left_linked", "right_linked", "both_linked", "shared_links", "same_link")


def q_issue_rates(spark, d):
    known = _issues(spark, d).filter("both_linked")
    kinds = known.withColumn("transition", X.transition_type(F.col("user_id") == F.col("prior_user_id"), F.col("agent") != F.col("prior_agent")))
    return kinds.groupBy("transition", "same_link").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("repo_id").alias("n_repos"), F.round(X.rate(F.col("merged_in_time")), 9).alias("merge_rate"))


def q_successors(spark, d):
    out = _successors(spark, d)
    return out.select("failed_id", "next_pr_id", "shared_files", "shared_telling_files", "example_file", "successor_tie_n", "mode", "recovered", F.round("gap_hours", 6).alias("gap_hours"))


def q_composition(spark, d):
    out = _successors(spark, d)
    return out.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("repo_id").alias("n_repos"), F.count_if("recovered").alias("recovered"), F.round(F.median("gap_hours"), 6).alias("median_gap"))


def q_continuity(spark, d):
    pairs = _ledger(spark, d).select("pr_id", "prior_pr_id")
    out = ledger.set_continuity(pairs, B.changed_files(spark, d), "pr_id", "prior_pr_id", "pr_id", "filename")
    return out.select("pr_id", "prior_pr_id", "covered", "shared", F.round("jaccard", 9).alias("jaccard"), F.round("containment", 9).alias("containment"))


def q_thresholds(spark, d):
    out = ledger.thresholds(_ledger(spark, d), [0, 24, 72, 168, 336, 720], F.col("gap_hours"), F.col("switched"), F.col("merged_in_time"))
    return out.select("threshold", "n", *(F.round(c, 9).alias(c) for c in ("rate0", "rate1", "difference")))


def q_invariants(spark, d):
    rules = {
        "prior_closed_before": F.col("prior_closed_dt") < F.col("created_dt"),
        "no_self": F.col("prior_pr_id") != F.col("pr_id"),
        "gap_positive": F.col("gap_hours") > 0,
        "one_user": F.col("same_user"),
    }
    return ledger.invariants(_ledger(spark, d), rules)


def q_bins(spark, d):
    out = B.pull_requests(spark, d).groupBy("repo_id").agg(F.count(F.lit(1)).alias("k"))
    return out.groupBy(X.count_bin("k").alias("size_bin")).agg(F.count(F.lit(1)).alias("n"))


def _s(body: str, prefix: str = LEDGER_SQL) -> str:
    return f"WITH {prefix}\n{body}"


_STREAK_SQL = (
    B.PR_SQL
    + f""",
res AS (SELECT * FROM (SELECT *, greatest(closed_dt, merged_dt) AS known_dt, count(*) OVER (PARTITION BY repo_id, greatest(closed_dt, merged_dt)) AS tie_n FROM pr WHERE {_VALID}) WHERE tie_n = 1),
c1 AS (SELECT a.repo_id, a.pr_id, a.created_dt, b.pr_id AS p1, b.created_dt AS t1, b.merged_dt IS NOT NULL AS m1 FROM pr a ASOF JOIN res b ON a.repo_id = b.repo_id AND a.created_dt > b.known_dt),
c2 AS (SELECT a.*, b.pr_id AS p2, b.created_dt AS t2, CASE WHEN b.pr_id IS NOT NULL THEN b.merged_dt IS NOT NULL END AS m2 FROM c1 a ASOF LEFT JOIN res b ON a.repo_id = b.repo_id AND a.t1 > b.known_dt),
c3 AS (SELECT a.*, NULL AS p3, NULL::BOOLEAN AS m3 FROM c2 a WHERE t2 IS NULL UNION ALL
  SELECT a.*, b.pr_id AS p3, CASE WHEN b.pr_id IS NOT NULL THEN b.merged_dt IS NOT NULL END AS m3 FROM (SELECT * FROM c2 WHERE t2 IS NOT NULL) a ASOF LEFT JOIN res b ON a.repo_id = b.repo_id AND a.t2 > b.known_dt),
st AS (SELECT pr_id, p1 AS p1_pr_id, p2 AS p2_pr_id, p3 AS p3_pr_id, CASE WHEN m1 THEN '0' WHEN m2 IS NULL THEN 'left-censored-1+' WHEN m2 THEN '1' WHEN m3 IS NULL THEN 'left-censored-2+' WHEN m3 THEN '2' ELSE '3+' END AS streak
  FROM (SELECT *, row_number() OVER (PARTITION BY p1 ORDER BY created_dt, pr_id) AS k FROM c3) WHERE k = 1)"""
)
_ISSUE_SQL = (
    LEDGER_SQL
    + ",\n"
    + B.ISSUES_SQL
    + """,
ic AS (SELECT led.*, pr_id IN (SELECT pr_id FROM issues) AS left_linked, prior_pr_id IN (SELECT pr_id FROM issues) AS right_linked,
    (SELECT count(*) FROM issues a JOIN issues b USING (issue_id) WHERE a.pr_id = led.pr_id AND b.pr_id = led.prior_pr_id) AS shared_links,
    CASE WHEN user_id = prior_user_id AND agent = prior_agent THEN 'persistence' WHEN user_id = prior_user_id THEN 'brand_change_same_contributor' WHEN agent = prior_agent THEN 'contributor_change_stable_agent' ELSE 'joint_reconfiguration' END AS transition
  FROM led)"""
)
_SUCC_SQL = (
    B.PR_SQL
    + ",\n"
    + B.FILES_SQL
    + """,
f AS (SELECT repo_id, filename, pr_id AS failed_id, closed_dt AS failed_dt, agent AS fa, user_id AS fu FROM pr JOIN files USING (pr_id) WHERE closed_dt >= created_dt AND closed_dt <= TIMESTAMP '1998-06-01' AND merged_dt IS NULL),
l AS (SELECT repo_id, filename, pr_id, created_dt, agent, user_id, merged_dt, path_n FROM (SELECT pr.*, filename, row_number() OVER (PARTITION BY repo_id, filename, created_dt ORDER BY pr_id) AS k, count(*) OVER (PARTITION BY repo_id, filename, created_dt) AS path_n FROM pr JOIN files USING (pr_id)) WHERE k = 1),
m AS (SELECT f.*, l.pr_id AS next_id, l.created_dt AS next_dt, l.agent AS na, l.user_id AS nu, l.merged_dt AS nm, l.path_n FROM f ASOF JOIN l ON f.repo_id = l.repo_id AND f.filename = l.filename AND f.failed_dt < l.created_dt),
g AS (SELECT repo_id, failed_id, failed_dt, fa, fu, next_id, next_dt, na, nu, nm, count(*) AS shared_files, count(*) FILTER (WHERE filename % 10 <> 0) AS shared_telling_files, max(path_n) AS path_n, min(filename) AS example_file FROM m WHERE next_dt <= failed_dt + INTERVAL 30 DAY GROUP BY ALL),
sc AS (SELECT repo_id, failed_id, next_id AS next_pr_id, shared_files, shared_telling_files, example_file, greatest(path_n, candidate_n) AS successor_tie_n, CASE WHEN fu = nu AND fa = na THEN 'persistence' WHEN fu = nu THEN 'brand_change_same_contributor' WHEN fa = na THEN 'contributor_change_stable_agent' ELSE 'joint_reconfiguration' END AS mode,
    coalesce(nm <= next_dt + INTERVAL 30 DAY, false) AS recovered, datesub('second', failed_dt, next_dt) / 3600.0 AS gap_hours
  FROM (SELECT *, row_number() OVER (PARTITION BY failed_id ORDER BY next_dt, next_id) AS k, count(*) OVER (PARTITION BY failed_id, next_dt) AS candidate_n FROM g) WHERE k = 1)"""
)
_EFFECTS = """SELECT {0}, a AS stay_n, b AS switch_n, round(p, 7) + 0.0 AS stay_rate, round(q, 7) + 0.0 AS switch_rate, round((q - p) * 100, 7) + 0.0 AS effect_pp, round((q - p - 1.96::DOUBLE * se) * 100, 7) + 0.0 AS low_pp, round((q - p + 1.96::DOUBLE * se) * 100, 7) + 0.0 AS high_pp
FROM (SELECT *, sqrt(p * (1 - p) / a + q * (1 - q) / b) AS se FROM (SELECT {1} AS {0}, count(*) FILTER (WHERE NOT switched) AS a, count(*) FILTER (WHERE switched) AS b, avg(CAST(merged_in_time AS DOUBLE)) FILTER (WHERE NOT switched) AS p, avg(CAST(merged_in_time AS DOUBLE)) FILTER (WHERE switched) AS q
  FROM led WHERE prior_merged_dt IS NULL GROUP BY 1) WHERE a > 0 AND b > 0)"""
_ASOF_SQL = B.PR_SQL + f", r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, closed_dt ORDER BY pr_id DESC) AS k FROM pr WHERE {_VALID}) WHERE k = 1)"

QUERIES = {
    "repo_summary": (q_summary, _s("SELECT repo_id, count(*) AS n_items, count(DISTINCT agent) AS n_agents, min(created_dt) AS first_dt, max(created_dt) AS last_dt, round(avg(CASE WHEN merged_dt IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 9) AS merge_rate FROM pr GROUP BY 1", B.PR_SQL)),
    "multi_agent_onset": (q_onset, _s("SELECT * FROM onset", B.PR_SQL + _ONSET_SQL)),
    "transition_ledger": (q_ledger, _s("SELECT pr_id, repo_id, prior_pr_id, prior_agent, switched, same_user, round(gap_hours, 6) AS gap_hours, merged_in_time, calendar_month FROM led")),
    "asof_backward_strict": (q_asof, _s("SELECT pr.pr_id, r.pr_id AS prior_pr_id, r.closed_dt AS prior_closed_dt FROM pr ASOF LEFT JOIN r ON pr.repo_id = r.repo_id AND pr.created_dt > r.closed_dt", _ASOF_SQL)),
    "switch_effects_by_agent": (q_effects_agent, _s(_EFFECTS.format("agent", "agent"))),
    "switch_effects_by_stars": (q_effects_stars, _s(_EFFECTS.format("star_bin", "CASE WHEN repo_id % 13 = 0 THEN 'Missing' WHEN repo_id * repo_id % 211 * (repo_id % 2) < 1 THEN '0' WHEN repo_id * repo_id % 211 * (repo_id % 2) < 10 THEN '1–9' WHEN repo_id * repo_id % 211 * (repo_id % 2) < 100 THEN '10–99' ELSE '100+' END"))),
    "asof_busy_keys": (q_asof_ranges, _s("SELECT pr.pr_id, r.pr_id AS prior_pr_id, r.closed_dt AS prior_closed_dt FROM pr ASOF LEFT JOIN r2 r ON pr.repo_id % 2 = r.half AND pr.created_dt > r.closed_dt", _ASOF_SQL + ", r2 AS (SELECT repo_id % 2 AS half, max(pr_id) AS pr_id, closed_dt FROM pr WHERE closed_dt >= created_dt AND (merged_dt IS NULL OR merged_dt >= created_dt) GROUP BY 1, 3)")),
    "asof_backward_loose": (q_asof_loose, _s("SELECT pr.pr_id, r.pr_id AS prior_pr_id, r.closed_dt AS prior_closed_dt FROM pr ASOF LEFT JOIN r ON pr.repo_id = r.repo_id AND pr.created_dt >= r.closed_dt", _ASOF_SQL)),
    "transition_matrix": (q_matrix, _s("SELECT prior_agent, agent, count(*) AS n, round(avg(CAST(merged_in_time AS DOUBLE)), 9) AS rate, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM led GROUP BY 1, 2")),
    "transition_rates": (q_rates, _s("SELECT prior_merged_dt IS NOT NULL AS prior_merged, switched, count(*) AS n, round(avg(CAST(merged_in_time AS DOUBLE)), 9) AS rate, round(1.96::DOUBLE * sqrt(avg(CAST(merged_in_time AS DOUBLE)) * (1 - avg(CAST(merged_in_time AS DOUBLE))) / count(*)), 9) AS half_width FROM led GROUP BY 1, 2")),
    "transition_types": (q_types, _s("SELECT CASE WHEN same_user AND NOT switched THEN 'persistence' WHEN same_user THEN 'brand_change_same_contributor' WHEN NOT switched THEN 'contributor_change_stable_agent' ELSE 'joint_reconfiguration' END AS transition_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM led GROUP BY 1")),
    "paired_repo_recovery": (
        q_paired,
        _s("""SELECT repo_id, n0, n1, round(rate0, 9) AS rate0, round(rate1, 9) AS rate1, round(rate1 - rate0, 9) AS difference FROM (
  SELECT repo_id, count(*) FILTER (WHERE NOT switched) AS n0, count(*) FILTER (WHERE switched) AS n1, avg(CAST(merged_in_time AS DOUBLE)) FILTER (WHERE NOT switched) AS rate0, avg(CAST(merged_in_time AS DOUBLE)) FILTER (WHERE switched) AS rate1 FROM led GROUP BY 1) WHERE n0 >= 2 AND n1 >= 2"""),
    ),
    "within_context": (
        q_strata,
        _s("""SELECT repo_id, agent, n0, n1, round(rate0, 9) AS rate0, round(rate1, 9) AS rate1, round(rate1 - rate0, 9) AS difference, round(2.0::DOUBLE / (1.0::DOUBLE / n0 + 1.0::DOUBLE / n1), 9) AS weight FROM (
  SELECT repo_id, agent, count(*) FILTER (WHERE NOT switched) AS n0, count(*) FILTER (WHERE switched) AS n1, avg(CAST(merged_in_time AS DOUBLE)) FILTER (WHERE NOT switched) AS rate0, avg(CAST(merged_in_time AS DOUBLE)) FILTER (WHERE switched) AS rate1 FROM led GROUP BY 1, 2) WHERE n0 > 0 AND n1 > 0"""),
    ),
    "event_study": (
        q_event_study,
        _s(
            """, r AS (SELECT pr.*, onset_dt, row_number() OVER (PARTITION BY pr.repo_id ORDER BY created_dt, pr_id) - 1 AS place FROM pr JOIN onset USING (repo_id)),
e AS (SELECT *, place - min(CASE WHEN created_dt >= onset_dt THEN place END) OVER (PARTITION BY repo_id) AS event_index, CASE WHEN merged_dt IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS y FROM r)
SELECT event_index, count(*) AS n, round(avg(y), 9) AS rate, round(1.96::DOUBLE * sqrt(avg(y) * (1 - avg(y)) / count(*)), 9) AS half_width FROM e WHERE event_index BETWEEN -10 AND 10 GROUP BY 1""",
            B.PR_SQL + _ONSET_SQL,
        ),
    ),
    "resolved_events": (q_resolved, _s(f"SELECT pr_id, repo_id, known_dt FROM (SELECT *, greatest(closed_dt, merged_dt) AS known_dt, count(*) OVER (PARTITION BY repo_id, greatest(closed_dt, merged_dt)) AS k FROM pr WHERE {_VALID}) WHERE k = 1", B.PR_SQL)),
    "decision_streaks": (q_streaks, _s("SELECT * FROM st", _STREAK_SQL)),
    "streak_rates": (q_streak_rates, _s("SELECT streak, count(*) AS n, round(avg(CASE WHEN merged_dt IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 9) AS rate FROM st JOIN pr USING (pr_id) GROUP BY 1", _STREAK_SQL)),
    "issue_continuity": (q_issues, _s("SELECT pr_id, prior_pr_id, left_linked, right_linked, left_linked AND right_linked AS both_linked, shared_links, shared_links > 0 AS same_link FROM ic", _ISSUE_SQL)),
    "issue_continuity_rates": (
        q_issue_rates,
        _s("SELECT transition, shared_links > 0 AS same_link, count(*) AS n, count(DISTINCT repo_id) AS n_repos, round(avg(CAST(merged_in_time AS DOUBLE)), 9) AS merge_rate FROM ic WHERE left_linked AND right_linked GROUP BY 1, 2", _ISSUE_SQL),
    ),
    "file_successors": (q_successors, _s("SELECT failed_id, next_pr_id, shared_files, shared_telling_files, example_file, successor_tie_n, mode, recovered, round(gap_hours, 6) AS gap_hours FROM sc", _SUCC_SQL)),
    "successor_composition": (q_composition, _s("SELECT mode, count(*) AS n, count(DISTINCT repo_id) AS n_repos, count(*) FILTER (WHERE recovered) AS recovered, round(median(gap_hours), 6) AS median_gap FROM sc GROUP BY 1", _SUCC_SQL)),
    "file_continuity": (
        q_continuity,
        _s(
            """, s AS (SELECT pr_id, list(DISTINCT filename) AS fs FROM files GROUP BY 1),
z AS (SELECT led.pr_id, prior_pr_id, a.fs AS a, b.fs AS b FROM led LEFT JOIN s a ON a.pr_id = led.pr_id LEFT JOIN s b ON b.pr_id = prior_pr_id)
SELECT pr_id, prior_pr_id, a IS NOT NULL AND b IS NOT NULL AS covered, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN len(list_intersect(a, b)) END AS shared,
  round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END, 9) AS jaccard,
  round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CAST(len(list_intersect(a, b)) AS DOUBLE) / least(len(a), len(b)) END, 9) AS containment FROM z""",
            LEDGER_SQL + ",\n" + B.FILES_SQL,
        ),
    ),
    "gap_thresholds": (
        q_thresholds,
        _s("""SELECT threshold, count(*) AS n, round(avg(CAST(merged_in_time AS DOUBLE)) FILTER (WHERE NOT switched), 9) AS rate0, round(avg(CAST(merged_in_time AS DOUBLE)) FILTER (WHERE switched), 9) AS rate1,
  round(avg(CAST(merged_in_time AS DOUBLE)) FILTER (WHERE switched) - avg(CAST(merged_in_time AS DOUBLE)) FILTER (WHERE NOT switched), 9) AS difference
FROM led, (VALUES (0.0::DOUBLE), (24.0), (72.0), (168.0), (336.0), (720.0)) t(threshold) WHERE gap_hours >= threshold GROUP BY 1"""),
    ),
    "ledger_invariants": (
        q_invariants,
        _s("""SELECT rule, violations FROM (SELECT count(*) FILTER (WHERE NOT prior_closed_dt < created_dt) AS a, count(*) FILTER (WHERE prior_pr_id = pr_id) AS b, count(*) FILTER (WHERE NOT gap_hours > 0) AS c, count(*) FILTER (WHERE NOT same_user) AS d FROM led),
  LATERAL (VALUES ('prior_closed_before', a), ('no_self', b), ('gap_positive', c), ('one_user', d)) v(rule, violations)"""),
    ),
    "group_size_bins": (q_bins, _s("SELECT CASE WHEN k = 0 THEN '0' WHEN k < 10 THEN '1-9' WHEN k < 100 THEN '10-99' ELSE '100+' END AS size_bin, count(*) AS n FROM (SELECT repo_id, count(*) AS k FROM pr GROUP BY 1) GROUP BY 1", B.PR_SQL)),
}
