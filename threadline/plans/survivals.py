"""Queries over risk sets, person-periods and incidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadline.functions import columns as X
from threadline.operators import survival
from threadline.plans.cohorts import CUTOFF, RESPONSE_SQL, responses, triggers
from threadline.stats.resample import drawn_times_sql

END = "2024-12-31 00:00:00"

#: Eighths of a day for two days, then half days up to a month.
GRID = [i / 8 for i in range(16)] + [2 + i / 2 for i in range(57)]
#: Arms in order: no reply, a reply to another event, a reply to the trigger; states are unions of them.
STATES = {"no_edge": (0, 1), "with_edge": (2,), "no_reply": (0,), "off_target": (1,), "on_target": (2,)}
DRAWS = 200


def _cohort(spark, d):
    reply = responses(spark, d).filter("exact_reply").groupBy("pr_id").agg((F.min("hours_after") / 24.0).alias("reply_days"))
    base = triggers(spark, d).join(reply, "pr_id", "left")
    base = base.withColumn("merge_days", F.when(F.col("merged_dt") > F.col("trigger_dt"), X.seconds("trigger_dt", "merged_dt") / 86400.0))
    return survival.follow_up(base, "trigger_dt", F.lit(END).cast("timestamp_ntz"))


def _periods(spark, d):
    return survival.person_periods(_cohort(spark, d), "reply_days", "merge_days")


def q_follow(spark, d):
    return _cohort(spark, d).select("pr_id", F.round("follow_days", 6).alias("follow_days"), F.round("reply_days", 6).alias("reply_days"), F.round("merge_days", 6).alias("merge_days"))


def q_periods(spark, d):
    return _periods(spark, d).select("pr_id", "bin", "exposed", "event")


def q_hazards(spark, d):
    return survival.hazards(_periods(spark, d), "exposed").withColumn("hazard", F.round("hazard", 9))


def q_incidence(spark, d):
    return survival.cumulative_incidence(survival.hazards(_periods(spark, d))).select("bin", "at_risk", "events", F.round("incidence", 9).alias("incidence"))


def q_grid(spark, d):
    out = survival.incidence_on_grid(_cohort(spark, d), "reply_days", "merge_days", GRID)
    return out.select("exposed", "bin", "at_risk", "events", F.round("incidence", 9).alias("incidence"))


def q_risk(spark, d):
    return survival.standardised_risk(survival.hazards(_periods(spark, d), "exposed")).withColumn("risk", F.round("risk", 9))


def q_sequential(spark, d):
    out = survival.sequential_exposures(triggers(spark, d), responses(spark, d), [(0, 48), (48, 96)], X.is_type("user"))
    return out.select("pr_id", "in_0_48h", "in_48_96h")


def _changes(spark, d):
    answered = responses(spark, d).filter("parent_id is not null and hours_after > 0").groupBy("pr_id")
    first = answered.agg((F.min(F.when(F.col("exact_reply"), F.col("hours_after"))) / 24.0).alias("on_days"), (F.min(F.when(~F.col("exact_reply"), F.col("hours_after"))) / 24.0).alias("off_days"))
    base = survival.merge_follow_up(triggers(spark, d), F.lit(CUTOFF).cast("timestamp_ntz")).join(first, "pr_id", "left")
    return survival.risk_changes(base, ["off_days", "on_days"], GRID)


def q_states(spark, d):
    return survival.incidence_states(_changes(spark, d), STATES, GRID).withColumn("incidence", F.round("incidence", 9))


def _bands(spark, d):
    return survival.incidence_bands(_changes(spark, d), STATES, GRID, DRAWS)


def q_bands(spark, d):
    return _bands(spark, d).select("state", "cell", "days", *(F.round(x, 9).alias(x) for x in ("incidence", "low", "high")))


def q_overlap(spark, d):
    rounded = _bands(spark, d).select("state", "cell", "days", *(F.round(x, 9).alias(x) for x in ("incidence", "low", "high")))
    out = survival.band_overlap(rounded, "off_target", "on_target", "no_reply")
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


_COHORT_SQL = (
    RESPONSE_SQL
    + f""",
rp AS (SELECT pr_id, min(hours_after) / 24.0 AS reply_days FROM rs WHERE exact_reply GROUP BY 1),
co AS (SELECT tr.pr_id, reply_days, CASE WHEN merged_dt > trigger_dt THEN datesub('second', trigger_dt, merged_dt) / 86400.0 END AS merge_days,
    greatest(0.0::DOUBLE, least(coalesce(datesub('second', trigger_dt, least(TIMESTAMP '{END}', closed_dt)) / 86400.0, 30.0::DOUBLE), 30.0::DOUBLE)) AS follow_days FROM tr LEFT JOIN rp USING (pr_id))"""
)


_GRID_SQL = "gr AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {0.0 if not i else GRID[i - 1]!r}::DOUBLE, {x!r}::DOUBLE)" for i, x in enumerate(GRID)) + ") g(cell, low, days))"
#: Who is at risk in which state at each cell's begin, told row by row: items by cells.
_STATES_SQL = (
    RESPONSE_SQL
    + f""",
an AS (SELECT pr_id, min(hours_after) FILTER (WHERE exact_reply) / 24.0 AS on_days, min(hours_after) FILTER (WHERE NOT exact_reply) / 24.0 AS off_days FROM rs WHERE parent_id IS NOT NULL AND hours_after > 0 GROUP BY 1),
sc AS (SELECT tr.pr_id, tr.repo_id, on_days, off_days, coalesce(merged_dt > trigger_dt AND merged_dt <= trigger_dt + INTERVAL 30 DAY, false) AS merged,
  least(coalesce(closed_dt, trigger_dt + INTERVAL 30 DAY), trigger_dt + INTERVAL 30 DAY, TIMESTAMP '{CUTOFF}') AS exit_dt, trigger_dt, merged_dt FROM tr LEFT JOIN an USING (pr_id)),
sf AS (SELECT *, greatest(0.0::DOUBLE, least(30.0::DOUBLE, datesub('second', trigger_dt, CASE WHEN merged THEN merged_dt ELSE exit_dt END) / 86400.0)) AS follow_days FROM sc),
{_GRID_SQL},
ar AS (SELECT repo_id, cell, days, follow_days <= days AND merged AS event, CASE WHEN on_days <= low THEN 'on_target' WHEN off_days <= low THEN 'off_target' ELSE 'no_reply' END AS arm FROM sf JOIN gr ON follow_days > low),
st AS (SELECT repo_id, cell, event, arm AS state FROM ar UNION ALL SELECT repo_id, cell, event, CASE WHEN arm = 'on_target' THEN 'with_edge' ELSE 'no_edge' END FROM ar),
sg AS (SELECT state, cell, days FROM gr, (VALUES ('no_edge'), ('with_edge'), ('no_reply'), ('off_target'), ('on_target')) v(state)),
ci AS (SELECT sg.state, sg.cell, any_value(sg.days) AS days, count(repo_id) AS at_risk, count(*) FILTER (WHERE event) AS events FROM sg LEFT JOIN st ON st.state = sg.state AND st.cell = sg.cell GROUP BY 1, 2),
cu AS (SELECT *, 1 - product(1 - coalesce(events / nullif(at_risk, 0), 0.0)) OVER (PARTITION BY state ORDER BY cell) AS incidence FROM ci)"""
)
_BANDS_SQL = (
    _STATES_SQL
    + f""",
dr AS (SELECT CAST(range AS INTEGER) AS draw FROM range({DRAWS})),
wt AS (SELECT draw, repo_id, {drawn_times_sql("draw", "repo_id")} AS times FROM dr, (SELECT DISTINCT repo_id FROM st)),
bs AS (SELECT draw, state, cell, sum(times) AS at_risk, coalesce(sum(times) FILTER (WHERE event), 0) AS events FROM wt JOIN st USING (repo_id) GROUP BY 1, 2, 3),
bc AS (SELECT draw, sg.state, sg.cell, 1 - product(1 - coalesce(events / nullif(at_risk, 0), 0.0)) OVER (PARTITION BY draw, sg.state ORDER BY sg.cell) AS incidence FROM dr CROSS JOIN sg LEFT JOIN bs USING (draw, state, cell)),
bq AS (SELECT state, cell, quantile_cont(incidence, 0.025) AS low, quantile_cont(incidence, 0.975) AS high FROM bc GROUP BY 1, 2),
bd AS (SELECT state, cell, days, round(incidence, 9) AS incidence, round(low, 9) AS low, round(high, 9) AS high FROM cu JOIN bq USING (state, cell))"""
)
_OVERLAP_SQL = (
    _BANDS_SQL
    + """,
w AS (SELECT cell, f.days, f.incidence AS x, f.low AS xl, f.high AS xh, o.incidence AS y, o.low AS yl, o.high AS yh, n.incidence AS z, n.high AS zh, (f.incidence - o.incidence) * 100.0 AS gap
  FROM bd f JOIN bd o USING (cell) JOIN bd n USING (cell) WHERE f.state = 'off_target' AND o.state = 'on_target' AND n.state = 'no_reply'),
l AS (SELECT * FROM w ORDER BY cell DESC LIMIT 1)
SELECT count(*) AS cells, round(min(gap), 6) AS min_gap, round(max(gap), 6) AS max_gap, count(*) FILTER (WHERE gap > 0) AS cells_above, count(*) FILTER (WHERE gap < 0) AS cells_below,
  count(*) FILTER (WHERE xl <= yh AND yl <= xh) AS overlapping, min(days) FILTER (WHERE NOT (xl <= yh AND yl <= xh)) AS first_parted_days, min(days) FILTER (WHERE NOT (z >= x AND z >= y)) AS base_leads_until_days,
  round(max(abs(gap)), 6) AS max_abs_gap, round(avg(abs(gap)), 6) AS mean_abs_gap, round(max(abs(gap)) FILTER (WHERE days <= 7), 6) AS max_abs_gap_early,
  (SELECT days FROM w ORDER BY abs(gap) DESC, days LIMIT 1) AS max_abs_gap_days, (SELECT round((y - x) * 100.0, 6) FROM l) AS end_gap, (SELECT round((x - z) * 100.0, 6) FROM l) AS end_gap_base_a,
  (SELECT round((y - z) * 100.0, 6) FROM l) AS end_gap_base_b, (SELECT zh < xl FROM l) AS base_below_a, (SELECT zh < yl FROM l) AS base_below_b FROM w"""
)

def _bins(days: list[float]) -> str:
    return ", ".join(f"({i}, {lo}::DOUBLE, {hi}::DOUBLE)" for i, (lo, hi) in enumerate(zip(days, days[1:], strict=False)))


def _periods_sql(days: list[float]) -> str:
    return (
        _COHORT_SQL
        + f""",
pp AS (SELECT pr_id, CAST(bin AS INTEGER) AS bin, coalesce(reply_days <= low, false) AS exposed, coalesce(merge_days > low AND merge_days <= high AND merge_days <= follow_days, false) AS event
  FROM co JOIN (VALUES {_bins(days)}) b(bin, low, high) ON low < follow_days)"""
    )


_PP = _periods_sql(list(X.HAZARD_DAYS))
_GRID = _periods_sql(GRID)

QUERIES = {
    "follow_up": (q_follow, f"WITH {_COHORT_SQL}\nSELECT pr_id, round(follow_days, 6) AS follow_days, round(reply_days, 6) AS reply_days, round(merge_days, 6) AS merge_days FROM co"),
    "person_period": (q_periods, f"WITH {_PP}\nSELECT * FROM pp"),
    "hazard_by_bin": (q_hazards, f"WITH {_PP}\nSELECT bin, exposed, count(*) AS at_risk, count(*) FILTER (WHERE event) AS events, round(avg(CAST(event AS DOUBLE)), 9) AS hazard FROM pp GROUP BY 1, 2"),
    "cumulative_incidence": (q_incidence, f"WITH {_PP}, h AS (SELECT bin, count(*) AS at_risk, count(*) FILTER (WHERE event) AS events, avg(CAST(event AS DOUBLE)) AS hazard FROM pp GROUP BY 1)\nSELECT bin, at_risk, events, round(1 - product(1 - hazard) OVER (ORDER BY bin), 9) AS incidence FROM h"),
    "incidence_grid": (q_grid, f"WITH {_GRID}, h AS (SELECT exposed, bin, count(*) AS at_risk, count(*) FILTER (WHERE event) AS events, avg(CAST(event AS DOUBLE)) AS hazard FROM pp GROUP BY 1, 2)\nSELECT exposed, bin, at_risk, events, round(1 - product(1 - hazard) OVER (PARTITION BY exposed ORDER BY bin), 9) AS incidence FROM h"),
    "incidence_states": (q_states, f"WITH {_STATES_SQL}\nSELECT state, cell, days, at_risk, events, round(incidence, 9) AS incidence FROM cu"),
    "incidence_bands": (q_bands, f"WITH {_BANDS_SQL}\nSELECT * FROM bd"),
    "incidence_overlap": (q_overlap, f"WITH {_OVERLAP_SQL}"),
    "g_computation": (q_risk, f"WITH {_PP}, h AS (SELECT exposed, bin, avg(CAST(event AS DOUBLE)) AS hazard FROM pp GROUP BY 1, 2)\nSELECT exposed, round(1 - product(1 - hazard), 9) AS risk FROM h GROUP BY 1"),
    "sequential_exposures": (q_sequential, f"WITH {RESPONSE_SQL}, k AS (SELECT pr_id, bool_or(lower(user_type) = 'user' AND hours_after > 0 AND hours_after <= 48) AS a, bool_or(lower(user_type) = 'user' AND hours_after > 48 AND hours_after <= 96) AS b FROM rs GROUP BY 1)\nSELECT tr.pr_id, coalesce(a, false) AS in_0_48h, coalesce(b, false) AS in_48_96h FROM tr LEFT JOIN k USING (pr_id)"),
}

