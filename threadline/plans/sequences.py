"""Queries over bursts, sessions and state sequences. Thresholds are in hours' scale, as the test events are."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadline.functions import columns as X
from threadline.operators import sequence
from threadline.plans.cohorts import RESPONSE_SQL, TRIGGER_SQL, responses, triggers
from threadline.sources import bindings as B

THRESHOLDS = [0, 60, 180, 600]
_PRIORITY = "CASE state WHEN 'user_account' THEN 0 WHEN 'mapped_product' THEN 1 WHEN 'other_bot' THEN 2 ELSE 3 END"
_NAME = "CASE {} WHEN 0 THEN 'user_account' WHEN 1 THEN 'mapped_product' WHEN 2 THEN 'other_bot' WHEN 3 THEN 'branch_movement_untyped' END"

STATES_SQL = (
    RESPONSE_SQL
    + f""",
th AS (SELECT unnest([0, 60, 180, 600]) AS threshold_minutes),
fa AS (SELECT pr_id, threshold_minutes, interaction_dt, min({_PRIORITY}) AS p, count(*) AS n_events, count(DISTINCT state) AS n_states,
    row_number() OVER (PARTITION BY pr_id, threshold_minutes ORDER BY interaction_dt) AS k
  FROM rs, th WHERE interaction_dt > trigger_dt + to_minutes(threshold_minutes) GROUP BY 1, 2, 3),
fs AS (SELECT th.threshold_minutes, tr.pr_id, tr.repo_id, coalesce({_NAME.format("p")}, 'no_action_within_7d') AS first_state,
    datesub('second', trigger_dt, interaction_dt) / 60.0 AS minutes_from_trigger, coalesce(n_events, 0) AS n_events, coalesce(n_states, 0) AS n_states
  FROM tr CROSS JOIN th LEFT JOIN fa ON fa.pr_id = tr.pr_id AND fa.threshold_minutes = th.threshold_minutes AND k = 1)"""
)
EPISODE_SQL = (
    B.IX_SQL
    + f""",
st AS (SELECT *, CASE WHEN lower(user_type) = 'user' THEN 'user_account' WHEN actor_agent IS NOT NULL THEN 'mapped_product' WHEN lower(user_type) = 'bot' THEN 'other_bot' ELSE 'branch_movement_untyped' END AS state FROM ix),
g AS (SELECT *, CASE WHEN coalesce(datesub('second', lag(interaction_dt) OVER (PARTITION BY pr_id ORDER BY interaction_dt, event_id), interaction_dt) > 10800, true) THEN 1 ELSE 0 END AS fresh FROM st),
ep AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY pr_id ORDER BY interaction_dt, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM g),
es AS (SELECT pr_id, episode, min(interaction_dt) AS start_dt, max(interaction_dt) AS end_dt, count(*) AS n_events, {_NAME.format("min(" + _PRIORITY + ")")} AS state FROM ep GROUP BY 1, 2),
nx AS (SELECT *, coalesce(lead(state) OVER (PARTITION BY pr_id ORDER BY start_dt), 'end') AS next_state FROM es)"""
)
ACTION_SQL = (
    RESPONSE_SQL
    + """,
ac AS (SELECT pr_id, coalesce('review:' || review_id, source || ':' || event_id, 'movement:' || epoch_us(interaction_dt) || ':' || coalesce(lower(trim(actor_login)), '')) AS action, min(interaction_dt) AS action_dt, arg_min(owner, (interaction_dt, event_id)) AS owner, count(*) AS n_rows, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM rs GROUP BY 1, 2),
ts AS (SELECT pr_id, date_trunc('second', action_dt) AS at_dt, count(*) AS n_actions, CASE WHEN min(owner) = max(owner) THEN min(owner) ELSE 'simultaneous' END AS owner, min(owner) <> max(owner) AS ambiguous FROM ac GROUP BY 1, 2)"""
)


def _states(spark, d):
    return sequence.first_states(triggers(spark, d), responses(spark, d), THRESHOLDS)


def _events(spark, d):
    return B.interactions(spark, d).withColumn("state", X.atomic_state(F.col("actor_agent"), F.col("user_type")))


def _episodes(spark, d):
    return sequence.episode_states(sequence.episodes(_events(spark, d), 180))


def _actions(spark, d):
    return sequence.debatch(responses(spark, d), sequence.action_key())


def _bounce(spark, d):
    return sequence.bounces(sequence.timestamp_states(_actions(spark, d)))


def _gaps(spark, d):
    first = responses(spark, d).groupBy("pr_id", "repo_id").agg((F.min("hours_after") * 60).alias("gap_minutes"))
    return first


def q_first(spark, d):
    return _states(spark, d).withColumn("minutes_from_trigger", F.round("minutes_from_trigger", 6))


def q_shares(spark, d):
    return sequence.state_shares(_states(spark, d)).select("threshold_minutes", "first_state", "n", F.round("share", 9).alias("share"))


def q_migration(spark, d):
    return sequence.migration(_states(spark, d), 0, 180)


def q_loo(spark, d):
    out = sequence.leave_one_group_out(_states(spark, d).filter("threshold_minutes = 0"), "repo_id", "first_state")
    return out.withColumn("share_without", F.round("share_without", 9))


def q_loo_range(spark, d):
    out = sequence.leave_one_out_range(sequence.leave_one_group_out(_states(spark, d).filter("threshold_minutes = 0"), "repo_id", "first_state").withColumn("share_without", F.round("share_without", 9)), "repo_id", "first_state")
    return out


def q_episodes(spark, d):
    return sequence.episodes(_events(spark, d), 180).select("pr_id", "event_id", "episode")


def q_episode_states(spark, d):
    return _episodes(spark, d)


def q_next(spark, d):
    return sequence.next_shares(sequence.next_states(_episodes(spark, d))).withColumn("share", F.round("share", 9))


def q_walks(spark, d):
    out = sequence.automation_walks(_episodes(spark, d))
    return out.groupBy("step", "state", "next_state").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.col("step").cast("bigint"))


def q_next_owner(spark, d):
    anchors = triggers(spark, d).select("pr_id", F.col("trigger_dt").alias("anchor_dt"))
    out = sequence.next_owner(_events(spark, d), anchors, [0, 60, 600])
    return out.select("pr_id", F.col("washout_minutes").cast("bigint").alias("washout_minutes"), "next_state")


def q_debatch(spark, d):
    return _actions(spark, d)


def q_timestamp(spark, d):
    return sequence.timestamp_states(_actions(spark, d))


def q_bounce(spark, d):
    return _bounce(spark, d)


def q_bounce_summary(spark, d):
    b = _bounce(spark, d)
    return b.groupBy("first_owner").agg(F.count(F.lit(1)).alias("n"), F.count_if("returns").alias("returns"), F.count_if("leaves").alias("leaves"), F.round(F.avg("n_states"), 6).alias("mean_states"))


def q_histogram(spark, d):
    out = sequence.gap_histogram(_gaps(spark, d), 0.0, 4.0, 20)
    return out.select(F.col("bin").cast("bigint").alias("bin"), "n", F.round("share", 9).alias("share"), F.round("cumulative", 9).alias("cumulative"))


def q_hazard(spark, d):
    out = sequence.hazard_by_bin(sequence.gap_histogram(_gaps(spark, d), 0.0, 4.0, 20))
    return out.select(F.col("bin").cast("bigint").alias("bin"), "n", "at_risk", F.round("hazard", 9).alias("hazard"))


def q_split(spark, d):
    out = sequence.best_split(sequence.hazard_by_bin(sequence.gap_histogram(_gaps(spark, d), 0.0, 4.0, 20)).withColumn("log_hazard", F.log("hazard")), "log_hazard")
    return out.select(F.col("split").cast("bigint").alias("split"), F.round("sse", 6).alias("sse"))


_HIST_SQL = (
    RESPONSE_SQL
    + """,
gp AS (SELECT pr_id, min(hours_after) * 60 AS gap FROM rs GROUP BY 1),
hi AS (SELECT CAST(greatest(0, least(19, floor((log10(gap) - 0.0) / ((4.0::DOUBLE - 0.0) / 20)))) AS BIGINT) AS bin, count(*) AS n FROM gp WHERE gap > 0 GROUP BY 1),
hz AS (SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS at_risk, n / sum(n) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hazard FROM hi)"""
)
_LOO_SQL = (
    STATES_SQL
    + """,
z AS (SELECT repo_id, first_state FROM fs WHERE threshold_minutes = 0), n AS (SELECT repo_id, first_state, count(*) AS n FROM z GROUP BY 1, 2),
gr AS (SELECT repo_id, count(*) AS gn FROM z GROUP BY 1), lb AS (SELECT first_state, count(*) AS ln FROM z GROUP BY 1),
lo AS (SELECT gr.repo_id, lb.first_state, round(CAST(ln - coalesce(n, 0) AS DOUBLE) / nullif((SELECT count(*) FROM z) - gn, 0), 9) AS share_without FROM gr CROSS JOIN lb LEFT JOIN n ON n.repo_id = gr.repo_id AND n.first_state = lb.first_state)"""
)


def _s(prefix: str, body: str) -> str:
    return f"WITH {prefix}\n{body}"


QUERIES = {
    "burst_first_state": (q_first, _s(STATES_SQL, "SELECT CAST(threshold_minutes AS INTEGER) AS threshold_minutes, pr_id, repo_id, first_state, round(minutes_from_trigger, 6) AS minutes_from_trigger, n_events, n_states FROM fs")),
    "burst_state_shares": (
        q_shares,
        _s(
            STATES_SQL,
            """, dm AS (SELECT threshold_minutes, unnest(['user_account', 'mapped_product', 'other_bot', 'branch_movement_untyped', 'no_action_within_7d']) AS first_state FROM th),
c AS (SELECT dm.threshold_minutes, dm.first_state, count(fs.pr_id) AS n FROM dm LEFT JOIN fs ON fs.threshold_minutes = dm.threshold_minutes AND fs.first_state = dm.first_state GROUP BY 1, 2)
SELECT CAST(threshold_minutes AS INTEGER) AS threshold_minutes, first_state, n, round(n / sum(n) OVER (PARTITION BY threshold_minutes), 9) AS share FROM c""",
        ),
    ),
    "burst_migration": (q_migration, _s(STATES_SQL, "SELECT a.first_state AS from_state, b.first_state AS to_state, count(*) AS n FROM fs a JOIN fs b USING (pr_id) WHERE a.threshold_minutes = 0 AND b.threshold_minutes = 180 GROUP BY 1, 2")),
    "leave_one_group_out": (q_loo, _s(_LOO_SQL, "SELECT * FROM lo")),
    "leave_one_out_range": (q_loo_range, _s(_LOO_SQL, "SELECT first_state, min(share_without) AS low, max(share_without) AS high, arg_min(repo_id, (share_without, repo_id)) AS low_without, arg_max(repo_id, (share_without, repo_id)) AS high_without FROM lo GROUP BY 1")),
    "episodes_gap": (q_episodes, _s(EPISODE_SQL, "SELECT pr_id, event_id, episode FROM ep")),
    "episode_states": (q_episode_states, _s(EPISODE_SQL, "SELECT * FROM es")),
    "next_state_shares": (q_next, _s(EPISODE_SQL, "SELECT state, next_state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY state), 9) AS share FROM nx GROUP BY 1, 2")),
    "dynamic_transitions": (
        q_walks,
        _s(EPISODE_SQL, """, w AS (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY start_dt) AS step, bool_or(state = 'user_account') OVER (PARTITION BY pr_id ORDER BY start_dt ROWS UNBOUNDED PRECEDING) AS seen FROM nx)
SELECT step, state, next_state, count(*) AS n FROM w WHERE NOT seen AND step <= 4 GROUP BY 1, 2, 3"""),
    ),
    "next_owner": (
        q_next_owner,
        _s(
            TRIGGER_SQL,
            f""", st AS (SELECT pr_id, interaction_dt, CASE WHEN lower(user_type) = 'user' THEN 'user_account' WHEN actor_agent IS NOT NULL THEN 'mapped_product' WHEN lower(user_type) = 'bot' THEN 'other_bot' ELSE 'branch_movement_untyped' END AS state FROM ix),
wo AS (SELECT unnest([0, 60, 600]) AS washout_minutes),
na AS (SELECT tr.pr_id, washout_minutes, interaction_dt, min({_PRIORITY}) AS p, row_number() OVER (PARTITION BY tr.pr_id, washout_minutes ORDER BY interaction_dt) AS k
  FROM tr CROSS JOIN wo JOIN st ON st.pr_id = tr.pr_id AND datesub('second', trigger_dt, interaction_dt) > washout_minutes * 60 GROUP BY 1, 2, 3)
SELECT tr.pr_id, CAST(wo.washout_minutes AS BIGINT) AS washout_minutes, coalesce({_NAME.format("p")}, 'none') AS next_state FROM tr CROSS JOIN wo LEFT JOIN na ON na.pr_id = tr.pr_id AND na.washout_minutes = wo.washout_minutes AND k = 1""",
        ),
    ),
    "debatched_actions": (q_debatch, _s(ACTION_SQL, "SELECT * FROM ac")),
    "timestamp_states": (q_timestamp, _s(ACTION_SQL, "SELECT * FROM ts")),
    "bounce_persistence": (
        q_bounce,
        _s(ACTION_SQL, """, p AS (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY at_dt) AS k, first(owner) OVER (PARTITION BY pr_id ORDER BY at_dt) AS first_owner FROM ts)
SELECT pr_id, first_owner, max(CASE WHEN k = 2 THEN owner END) AS second_owner, bool_or(k > 1 AND owner = first_owner) AS returns, bool_or(owner <> first_owner) AS leaves, count(*) AS n_states FROM p GROUP BY 1, 2"""),
    ),
    "bounce_summary": (
        q_bounce_summary,
        _s(ACTION_SQL, """, p AS (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY at_dt) AS k, first(owner) OVER (PARTITION BY pr_id ORDER BY at_dt) AS first_owner FROM ts),
b AS (SELECT pr_id, first_owner, bool_or(k > 1 AND owner = first_owner) AS returns, bool_or(owner <> first_owner) AS leaves, count(*) AS n_states FROM p GROUP BY 1, 2)
SELECT first_owner, count(*) AS n, count(*) FILTER (WHERE returns) AS returns, count(*) FILTER (WHERE leaves) AS leaves, round(avg(n_states), 6) AS mean_states FROM b GROUP BY 1"""),
    ),
    "gap_histogram": (q_histogram, _s(_HIST_SQL, "SELECT bin, n, round(n / sum(n) OVER (), 9) AS share, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 9) AS cumulative FROM hi")),
    "gap_hazard": (q_hazard, _s(_HIST_SQL, "SELECT bin, n, at_risk, round(hazard, 9) AS hazard FROM hz")),
    "hazard_change_point": (
        q_split,
        _s(_HIST_SQL, """, v AS (SELECT bin, ln(hazard) AS y FROM hz),
c AS (SELECT a.bin AS split, (SELECT sum((y - m) ** 2) FROM v, (SELECT avg(y) AS m FROM v WHERE bin <= a.bin) WHERE bin <= a.bin) + (SELECT sum((y - m) ** 2) FROM v, (SELECT avg(y) AS m FROM v WHERE bin > a.bin) WHERE bin > a.bin) AS sse FROM v a WHERE a.bin < (SELECT max(bin) FROM v))
SELECT split, round(sse, 6) AS sse FROM c ORDER BY sse, split LIMIT 1"""),
    ),
}
