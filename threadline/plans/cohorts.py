"""Queries over event cohorts: feedback, triggers, responses, funnels, routes, landmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.functions import columns as X
from threadline.operators import asof, cohort, history, matching
from threadline.sources import bindings as B

#: The last time of the test events; a trigger is mature a week before it.
CUTOFF = "2024-01-31 00:00:00"

FEEDBACK_SQL = (
    B.IX_SQL
    + """,
fb AS (
  SELECT ix.*, item.created_dt, item.closed_dt, item.merged_dt, actor_agent <> author_agent AS cross_agent,
    datesub('second', created_dt, interaction_dt) / 3600.0 AS hours_since_open
  FROM ix JOIN item USING (pr_id)
  WHERE actor_agent IS NOT NULL AND interaction_dt >= created_dt AND (closed_dt IS NULL OR interaction_dt <= closed_dt))"""
)
TRIGGER_SQL = (
    FEEDBACK_SQL
    + """,
tr AS (
  SELECT pr_id, repo_id, author_agent, author_login, closed_dt, merged_dt, event_id AS trigger_event_id, review_id AS trigger_review_id,
    source AS trigger_source, actor_agent AS trigger_agent, interaction_dt AS trigger_dt
  FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY interaction_dt, source, event_id) AS n FROM fb WHERE cross_agent)
  WHERE n = 1 AND interaction_dt <= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY)"""
)
RESPONSE_SQL = (
    TRIGGER_SQL
    + """,
rs0 AS (
  SELECT tr.*, e.event_id, e.review_id, e.parent_id, e.source, e.interaction_dt, e.actor_login, e.actor_agent, e.user_type,
    e.source = 'purchase' AS moved, coalesce(e.parent_id = trigger_event_id, false) AS exact_reply,
    datesub('second', trigger_dt, e.interaction_dt) / 3600.0 AS hours_after,
    CASE WHEN lower(e.user_type) = 'user' AND lower(e.actor_login) = lower(tr.author_login) THEN 'author_account' WHEN e.actor_agent = tr.author_agent THEN 'author_agent_brand'
      WHEN e.actor_agent = trigger_agent THEN 'triggering_reviewer_brand' WHEN e.actor_agent IS NOT NULL THEN 'other_agent_brand'
      WHEN lower(e.user_type) = 'bot' THEN 'other_bot' WHEN lower(e.user_type) = 'user' THEN 'other_human' ELSE 'unknown_actor' END AS role
  FROM tr JOIN ix e ON e.pr_id = tr.pr_id
  WHERE e.interaction_dt > trigger_dt AND e.interaction_dt <= trigger_dt + INTERVAL 7 DAY AND (closed_dt IS NULL OR e.interaction_dt <= closed_dt)
    AND (e.review_id IS NULL OR trigger_review_id IS NULL OR e.review_id <> trigger_review_id)),
rs AS (
  SELECT *, CASE WHEN coalesce(lower(user_type), '') = 'user' AND lower(actor_login) = lower(author_login) THEN 'author_human' WHEN lower(user_type) = 'user' THEN 'other_human'
      WHEN actor_agent = author_agent THEN 'author_agent' WHEN actor_agent = trigger_agent THEN 'triggering_reviewer' WHEN actor_agent IS NOT NULL THEN 'other_agent'
      WHEN lower(user_type) = 'bot' THEN 'other_bot' WHEN moved AND lower(actor_login) = lower(author_login) THEN 'author_account_untyped'
      WHEN moved THEN 'branch_actor_untyped' ELSE 'unknown' END AS owner,
    CASE WHEN lower(user_type) = 'user' THEN 'user_account' WHEN actor_agent IS NOT NULL THEN 'mapped_product'
      WHEN lower(user_type) = 'bot' THEN 'other_bot' ELSE 'branch_movement_untyped' END AS state
  FROM rs0)"""
)


def greedy_sql(frame: str) -> str:
    """mt: the pairs of taking turns one by one, from a select of stratum, id, arm, t; a step gives each stratum's next turn."""
    return f"""mf AS ({frame}),
mc AS (SELECT stratum, list({{'t': t, 'id': id}}) AS free FROM mf WHERE NOT arm GROUP BY 1),
me AS (SELECT stratum, id, t, row_number() OVER (PARTITION BY stratum ORDER BY t, id) AS k FROM mf WHERE arm),
ms AS (SELECT stratum, CAST(0 AS BIGINT) AS k, free, CAST(NULL AS VARCHAR) AS exposed_id, CAST(NULL AS VARCHAR) AS control_id, CAST(NULL AS BIGINT) AS gap FROM mc
  UNION ALL
  SELECT stratum, k, list_filter(free, lambda f: f.id <> pick.id), CAST(id AS VARCHAR), CAST(pick.id AS VARCHAR), abs(pick.t - t) FROM (
    SELECT stratum, k, free, id, t, CASE WHEN low IS NULL OR (high IS NOT NULL AND high.t - t <= t - low.t) THEN high ELSE low END AS pick FROM (
      SELECT ms.stratum, me.k, ms.free, me.id, me.t, list_max(list_filter(ms.free, lambda f: f.t < me.t)) AS low, list_min(list_filter(ms.free, lambda f: f.t >= me.t)) AS high
      FROM ms JOIN me ON me.stratum = ms.stratum AND me.k = ms.k + 1 WHERE len(ms.free) > 0))),
mt AS (SELECT exposed_id, control_id, gap / 3.6e9 AS gap_hours FROM ms WHERE exposed_id IS NOT NULL)"""


def moved() -> Column:
    """The test events' stand-in for a branch movement."""
    return F.col("source") == "purchase"


def feedback(spark: SparkSession, d: str) -> DataFrame:
    return cohort.feedback_events(B.interactions(spark, d), B.items(spark, d))


def triggers(spark: SparkSession, d: str) -> DataFrame:
    mature = X.after(F.lit(CUTOFF).cast("timestamp_ntz"), days=-7)
    return cohort.first_triggers(feedback(spark, d), mature_until=mature).drop("cross_agent")


def responses(spark: SparkSession, d: str) -> DataFrame:
    out = cohort.response_events(triggers(spark, d), B.interactions(spark, d), movement=moved())
    return out.withColumn("state", X.atomic_state(F.col("actor_agent"), F.col("user_type")))


def counters() -> dict[str, Column]:
    return {
        "exact_replies": F.col("exact_reply"),
        "later_views": F.col("source") == "view",
        "later_clicks": F.col("source") == "click",
        "movements": F.col("source") == "purchase",
    }


def chains(spark: SparkSession, d: str) -> DataFrame:
    return cohort.response_chains(triggers(spark, d), responses(spark, d), counters())


def q_feedback(spark, d):
    return feedback(spark, d).select("pr_id", "event_id", "source", "cross_agent", F.round("hours_since_open", 6).alias("hours_since_open"))


def q_coverage(spark, d):
    f = feedback(spark, d)
    return f.groupBy("author_agent", "actor_agent").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("pr_id").alias("n_items"), F.count_distinct("repo_id").alias("n_repos"), F.round(X.rate(F.col("cross_agent")), 6).alias("cross_rate"))


def q_first_trigger(spark, d):
    return triggers(spark, d).select("pr_id", "repo_id", "trigger_event_id", "trigger_source", "trigger_agent", "trigger_dt")


def q_first_by_relation(spark, d):
    first = cohort.first_triggers(feedback(spark, d), F.lit(True), ("pr_id", "cross_agent"))
    return first.groupBy("cross_agent", "trigger_source").agg(F.count(F.lit(1)).alias("n"))


def q_response_events(spark, d):
    return responses(spark, d).select("pr_id", "event_id", "role", "owner", "state", "exact_reply", F.round("hours_after", 6).alias("hours_after"))


def q_actor_roles(spark, d):
    n = F.count(F.lit(1))
    return responses(spark, d).groupBy("role").agg(n.alias("n"), F.count_distinct("pr_id").alias("n_items"), F.round(F.median("hours_after"), 6).alias("median_hours"))


def q_chains(spark, d):
    return chains(spark, d).select("pr_id", *counters(), "n_responses", "any_response", "merged_within_window")


def q_funnel(spark, d):
    stages = {"triggers": F.lit(True), "any_response": F.col("any_response"), "exact_reply": F.col("exact_replies") > 0, "reply_and_merge": (F.col("exact_replies") > 0) & F.col("merged_within_window")}
    return cohort.funnel(chains(spark, d), stages).withColumn("share", F.round("share", 9))


def q_thread_continuity(spark, d):
    return chains(spark, d).groupBy("any_response").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_responses"), 6).alias("mean_responses"), F.round(F.median("n_responses"), 6).alias("median_responses"))


def q_first_owner(spark, d):
    r = responses(spark, d)
    owners = cohort.first_actions(triggers(spark, d), r)
    channels = cohort.first_actions(triggers(spark, d), r.withColumnRenamed("source", "channel"), "channel", several="simultaneous_channels")
    return owners.select("pr_id", "first_owner", "first_dt").join(channels.select("pr_id", "first_channel"), "pr_id")


def q_routes(spark, d):
    return cohort.routes(triggers(spark, d), responses(spark, d), movement=moved()).select("pr_id", "route")


def q_route_speed(spark, d):
    r = cohort.routes(triggers(spark, d), responses(spark, d), movement=moved())
    return r.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.round(F.median(X.hours("trigger_dt", "person_dt")), 6).alias("median_person_hours"), F.round(F.median(X.hours("trigger_dt", "machine_dt")), 6).alias("median_machine_hours"))


def kinds() -> dict[str, Column]:
    return {"all": F.lit(True), "user": X.is_type("user"), "bot": X.is_type("bot"), "movement": F.col("source") == "purchase"}


def q_pretrigger(spark, d):
    out = cohort.pretrigger_features(triggers(spark, d), B.interactions(spark, d), kinds())
    return out.select("pr_id", *(f"pre_{k}" for k in kinds()), F.round("log1p_all", 9).alias("log1p_all"), "pre_last_dt")


def q_exposures(spark, d):
    out = cohort.nested_exposures(triggers(spark, d), responses(spark, d))
    return out.select("pr_id", F.round("reply_hours", 6).alias("reply_hours"), "reply_by_1h", "reply_by_6h", "reply_by_24h", "reply_by_48h")


def q_landmark(spark, d):
    return cohort.landmark_cohort(B.items(spark, d), feedback(spark, d)).select("pr_id", "cross", "same", "n_cross_products", "merged_after")


def q_landmark_rates(spark, d):
    c = cohort.landmark_cohort(B.items(spark, d), feedback(spark, d))
    return c.groupBy("cross", "same").agg(F.count(F.lit(1)).alias("n"), F.count_if("merged_after").alias("merged"), F.round(X.rate(F.col("merged_after")), 9).alias("rate"))


def q_prior_history(spark, d):
    ix = B.interactions(spark, d)
    target = responses(spark, d).filter(X.is_type("user")).select("pr_id", "event_id", "repo_id", "actor_login", "trigger_dt")
    out = history.strict_prior_history(target, ix.filter(X.is_type("user")).select("repo_id", "actor_login", "pr_id", "interaction_dt"), ["repo_id", "actor_login"])
    return out.select("pr_id", "event_id", "n_prior", "n_prior_items", F.round("hours_since_prior", 6).alias("hours_since_prior"), X.depth_bin("n_prior").alias("depth"))


def q_responders(spark, d):
    out = history.first_responders(responses(spark, d))
    return out.select("pr_id", "actor_login", "first_dt", "source", F.col("responder_rank").cast("bigint").alias("responder_rank"), "is_first", "n_first")


def q_role_totals(spark, d):
    return history.with_total(responses(spark, d), ["role"], [F.count(F.lit(1)).alias("n"), F.count_distinct("pr_id").alias("n_items"), F.round(F.avg("hours_after"), 6).alias("mean_hours")])


def q_channel_trigger_match(spark, d):
    """Triggers of one relation beside the nearest of the other: every input of the greedy matcher."""
    first = cohort.first_triggers(feedback(spark, d), F.lit(True), ("pr_id", "cross_agent"))
    frame = first.select(F.concat_ws(":", "pr_id", "cross_agent").alias("row"), "repo_id", F.col("cross_agent").alias("arm"), "trigger_dt")
    out = matching.nearest_without_replacement(frame, ["repo_id"], "arm", "trigger_dt", "row")
    return out.select("exposed_id", "control_id", F.round("gap_hours", 6).alias("gap_hours"))


def q_asof_forward(spark, d):
    ix = B.interactions(spark, d)
    errors = ix.filter("source = 'error'").select("pr_id", "event_id", "interaction_dt")
    buys = ix.filter("source = 'purchase'").select("pr_id", "event_id", "interaction_dt")
    out = asof.asof_join(errors, buys, "interaction_dt", "interaction_dt", ["pr_id"], ["event_id", "interaction_dt"], direction="forward", prefix="next_")
    return out.select("pr_id", "event_id", "next_event_id", X.seconds("interaction_dt", "next_interaction_dt").alias("gap_seconds"))


def _sql(prefix: str, body: str) -> str:
    return f"WITH {prefix}\n{body}"


_CHAIN_SQL = (
    RESPONSE_SQL
    + """,
ch AS (
  SELECT tr.*, coalesce(k.exact_replies, 0) AS exact_replies, coalesce(later_views, 0) AS later_views, coalesce(later_clicks, 0) AS later_clicks,
    coalesce(movements, 0) AS movements, coalesce(n_responses, 0) AS n_responses, coalesce(n_responses, 0) > 0 AS any_response,
    coalesce(merged_dt > trigger_dt AND merged_dt <= trigger_dt + INTERVAL 7 DAY, false) AS merged_within_window
  FROM tr LEFT JOIN (SELECT pr_id, count(*) FILTER (WHERE exact_reply) AS exact_replies, count(*) FILTER (WHERE source = 'view') AS later_views,
    count(*) FILTER (WHERE source = 'click') AS later_clicks, count(*) FILTER (WHERE source = 'purchase') AS movements, count(*) AS n_responses
    FROM rs GROUP BY pr_id) k USING (pr_id))"""
)
_ROUTE_SQL = (
    RESPONSE_SQL
    + """,
near AS (
  SELECT pr_id, min(interaction_dt) FILTER (WHERE owner IN ('author_human', 'other_human')) AS person_dt,
    min(interaction_dt) FILTER (WHERE owner IN ('author_agent', 'triggering_reviewer', 'other_agent', 'other_bot')) AS machine_dt,
    min(interaction_dt) FILTER (WHERE moved) AS moved_dt, count(*) AS n FROM rs WHERE hours_after <= 48 GROUP BY pr_id),
rt AS (
  SELECT tr.*, person_dt, machine_dt, CASE WHEN person_dt IS NOT NULL AND (machine_dt IS NULL OR person_dt <= machine_dt) THEN 'human_first'
    WHEN person_dt IS NOT NULL THEN 'automation_then_human' WHEN machine_dt IS NOT NULL THEN 'automation_no_human'
    WHEN moved_dt IS NOT NULL THEN 'movement_only' WHEN n > 0 THEN 'other_activity' ELSE 'no_observed_action' END AS route
  FROM tr LEFT JOIN near USING (pr_id))"""
)
_LANDMARK_SQL = (
    FEEDBACK_SQL
    + """,
seen AS (
  SELECT pr_id, bool_or(cross_agent) AS cross_, bool_or(NOT cross_agent) AS same_, count(DISTINCT actor_agent) FILTER (WHERE cross_agent) AS k
  FROM fb WHERE interaction_dt <= created_dt + INTERVAL 24 HOUR GROUP BY pr_id),
lm AS (
  SELECT pr_id, coalesce(cross_, false) AS "cross", coalesce(same_, false) AS same, coalesce(k, 0) AS n_cross_products,
    coalesce(merged_dt > created_dt + INTERVAL 24 HOUR AND merged_dt <= created_dt + INTERVAL 30 DAY, false) AS merged_after
  FROM item LEFT JOIN seen USING (pr_id) WHERE closed_dt IS NULL OR closed_dt > created_dt + INTERVAL 24 HOUR)"""
)

QUERIES = {
    "participation_funnel": (
        q_funnel,
        _sql(
            _CHAIN_SQL,
            """, s AS (SELECT count(*) AS a, count(*) FILTER (WHERE any_response) AS b, count(*) FILTER (WHERE exact_replies > 0) AS c,
  count(*) FILTER (WHERE exact_replies > 0 AND merged_within_window) AS d FROM ch)
SELECT step, stage, n, round(CAST(n AS DOUBLE) / nullif(a, 0), 9) AS share FROM s,
  LATERAL (VALUES (0, 'triggers', a), (1, 'any_response', b), (2, 'exact_reply', c), (3, 'reply_and_merge', d)) v(step, stage, n)""",
        ),
    ),
    "feedback_events": (q_feedback, _sql(FEEDBACK_SQL, "SELECT pr_id, event_id, source, cross_agent, round(hours_since_open, 6) AS hours_since_open FROM fb")),
    "feedback_coverage": (q_coverage, _sql(FEEDBACK_SQL, "SELECT author_agent, actor_agent, count(*) AS n_events, count(DISTINCT pr_id) AS n_items, count(DISTINCT repo_id) AS n_repos, round(avg(CAST(cross_agent AS DOUBLE)), 6) AS cross_rate FROM fb GROUP BY 1, 2")),
    "first_trigger": (q_first_trigger, _sql(TRIGGER_SQL, "SELECT pr_id, repo_id, trigger_event_id, trigger_source, trigger_agent, trigger_dt FROM tr")),
    "first_by_relation": (
        q_first_by_relation,
        _sql(FEEDBACK_SQL, "SELECT cross_agent, source AS trigger_source, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY pr_id, cross_agent ORDER BY interaction_dt, source, event_id) AS k FROM fb) WHERE k = 1 GROUP BY 1, 2"),
    ),
    "response_events": (q_response_events, _sql(RESPONSE_SQL, "SELECT pr_id, event_id, role, owner, state, exact_reply, round(hours_after, 6) AS hours_after FROM rs")),
    "actor_roles": (q_actor_roles, _sql(RESPONSE_SQL, "SELECT role, count(*) AS n, count(DISTINCT pr_id) AS n_items, round(median(hours_after), 6) AS median_hours FROM rs GROUP BY role")),
    "response_chains": (q_chains, _sql(_CHAIN_SQL, "SELECT pr_id, exact_replies, later_views, later_clicks, movements, n_responses, any_response, merged_within_window FROM ch")),
    "thread_continuity": (q_thread_continuity, _sql(_CHAIN_SQL, "SELECT any_response, count(*) AS n, round(avg(n_responses), 6) AS mean_responses, round(median(n_responses), 6) AS median_responses FROM ch GROUP BY 1")),
    "first_action_owner": (
        q_first_owner,
        _sql(
            RESPONSE_SQL,
            """, fa AS (SELECT pr_id, interaction_dt, min(owner) AS low, max(owner) AS high, min(source) AS clow, max(source) AS chigh, row_number() OVER (PARTITION BY pr_id ORDER BY interaction_dt) AS k FROM rs GROUP BY 1, 2)
SELECT tr.pr_id, CASE WHEN low IS NULL THEN 'no_observed_action' WHEN low = high THEN low ELSE 'simultaneous_owners' END AS first_owner, interaction_dt AS first_dt,
  CASE WHEN low IS NULL THEN 'no_observed_action' WHEN clow = chigh THEN clow ELSE 'simultaneous_channels' END AS first_channel
FROM tr LEFT JOIN fa ON fa.pr_id = tr.pr_id AND k = 1""",
        ),
    ),
    "ownership_route": (q_routes, _sql(_ROUTE_SQL, "SELECT pr_id, route FROM rt")),
    "route_speed": (
        q_route_speed,
        _sql(_ROUTE_SQL, "SELECT route, count(*) AS n, round(median(datesub('second', trigger_dt, person_dt) / 3600.0), 6) AS median_person_hours, round(median(datesub('second', trigger_dt, machine_dt) / 3600.0), 6) AS median_machine_hours FROM rt GROUP BY route"),
    ),
    "pretrigger_features": (
        q_pretrigger,
        _sql(
            TRIGGER_SQL,
            """, b AS (SELECT tr.pr_id, count(*) AS a, count(*) FILTER (WHERE lower(user_type) = 'user') AS u, count(*) FILTER (WHERE lower(user_type) = 'bot') AS o,
  count(*) FILTER (WHERE source = 'purchase') AS m, max(interaction_dt) AS l FROM tr JOIN ix ON ix.pr_id = tr.pr_id AND interaction_dt < trigger_dt GROUP BY 1)
SELECT tr.pr_id, coalesce(a, 0) AS pre_all, coalesce(u, 0) AS pre_user, coalesce(o, 0) AS pre_bot, coalesce(m, 0) AS pre_movement,
  round(ln(1 + CAST(coalesce(a, 0) AS DOUBLE)), 9) AS log1p_all, l AS pre_last_dt FROM tr LEFT JOIN b USING (pr_id)""",
        ),
    ),
    "exposure_flags": (
        q_exposures,
        _sql(
            RESPONSE_SQL,
            """, e AS (SELECT pr_id, min(hours_after) AS h FROM rs WHERE exact_reply GROUP BY 1)
SELECT tr.pr_id, round(h, 6) AS reply_hours, coalesce(h <= 1, false) AS reply_by_1h, coalesce(h <= 6, false) AS reply_by_6h, coalesce(h <= 24, false) AS reply_by_24h, coalesce(h <= 48, false) AS reply_by_48h FROM tr LEFT JOIN e USING (pr_id)""",
        ),
    ),
    "landmark_cohort": (q_landmark, _sql(_LANDMARK_SQL, "SELECT * FROM lm")),
    "landmark_rates": (q_landmark_rates, _sql(_LANDMARK_SQL, 'SELECT "cross", same, count(*) AS n, count(*) FILTER (WHERE merged_after) AS merged, round(avg(CAST(merged_after AS DOUBLE)), 9) AS rate FROM lm GROUP BY 1, 2')),
    "prior_history": (
        q_prior_history,
        _sql(
            RESPONSE_SQL,
            """, t AS (SELECT pr_id, event_id, repo_id, actor_login, trigger_dt FROM rs WHERE lower(user_type) = 'user'),
h AS (SELECT t.pr_id, t.event_id, count(x.pr_id) AS n, count(DISTINCT x.pr_id) AS k, max(x.interaction_dt) AS l, any_value(t.trigger_dt) AS dt
  FROM t LEFT JOIN ix x ON lower(x.user_type) = 'user' AND x.repo_id = t.repo_id AND x.actor_login = t.actor_login AND x.pr_id <> t.pr_id AND x.interaction_dt < t.trigger_dt GROUP BY 1, 2)
SELECT pr_id, event_id, n AS n_prior, k AS n_prior_items, round(datesub('second', l, dt) / 3600.0, 6) AS hours_since_prior,
  CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 4 THEN '2-4' WHEN n <= 9 THEN '5-9' ELSE '10+' END AS depth FROM h""",
        ),
    ),
    "first_responders": (
        q_responders,
        _sql(
            RESPONSE_SQL,
            """, f AS (SELECT pr_id, actor_login, min(interaction_dt) AS first_dt, arg_min(source, (interaction_dt, event_id)) AS source FROM rs WHERE hours_after <= 48 AND lower(user_type) = 'user' GROUP BY 1, 2),
g AS (SELECT *, min(first_dt) OVER (PARTITION BY pr_id) AS at_dt FROM f)
SELECT pr_id, actor_login, first_dt, source, rank() OVER (PARTITION BY pr_id ORDER BY first_dt) AS responder_rank, first_dt = at_dt AS is_first,
  CAST(sum(CASE WHEN first_dt = at_dt THEN 1 ELSE 0 END) OVER (PARTITION BY pr_id) AS BIGINT) AS n_first FROM g""",
        ),
    ),
    "role_totals": (q_role_totals, _sql(RESPONSE_SQL, "SELECT CASE WHEN grouping(role) = 1 THEN 'all' ELSE role END AS role, count(*) AS n, count(DISTINCT pr_id) AS n_items, round(avg(hours_after), 6) AS mean_hours FROM rs GROUP BY GROUPING SETS ((role), ())")),
    "matched_triggers": (
        q_channel_trigger_match,
        "WITH RECURSIVE "
        + FEEDBACK_SQL
        + ", "
        + greedy_sql("SELECT repo_id AS stratum, concat(pr_id, ':', cross_agent) AS id, cross_agent AS arm, epoch_us(interaction_dt) AS t FROM (SELECT *, row_number() OVER (PARTITION BY pr_id, cross_agent ORDER BY interaction_dt, source, event_id) AS n FROM fb) WHERE n = 1")
        + "\nSELECT exposed_id, control_id, round(gap_hours, 6) AS gap_hours FROM mt",
    ),
    "asof_forward_events": (
        q_asof_forward,
        _sql(
            B.IX_SQL,
            """, e AS (SELECT pr_id, event_id, interaction_dt FROM ix WHERE source = 'error'), p AS (SELECT pr_id, event_id, interaction_dt FROM ix WHERE source = 'purchase')
SELECT e.pr_id, e.event_id, p.event_id AS next_event_id, datesub('second', e.interaction_dt, p.interaction_dt) AS gap_seconds FROM e ASOF LEFT JOIN p ON e.pr_id = p.pr_id AND e.interaction_dt < p.interaction_dt""",
        ),
    ),
}
