"""Queries over a corpus loaded by its own columns: interactions, and what follows triggers by channel."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadline.functions import columns as X
from threadline.operators import channels, cohort, matching
from threadline.plans.cohorts import CUTOFF, greedy_sql
from threadline.sources import bindings as B
from threadline.sources import loaders

_RULES = """direct AS (SELECT t.*, 'direct_inline_reply' AS response_source, e.event_id, e.review_id, e.actor_login, e.user_type, e.dt FROM ct t JOIN li e ON e.pr_id = t.pr_id AND e.parent_id = t.trigger_event_id WHERE t.trigger_source = 'inline_review_comment'),
review AS (SELECT t.*, 'subsequent_review' AS response_source, e.event_id, e.review_id, e.actor_login, e.user_type, e.dt FROM ct t JOIN lv e ON e.pr_id = t.pr_id WHERE t.trigger_review_id IS NULL OR e.review_id <> t.trigger_review_id),
comment AS (SELECT t.*, 'subsequent_pr_comment' AS response_source, e.event_id, NULL::BIGINT, e.actor_login, e.user_type, e.dt FROM ct t JOIN lc e ON e.pr_id = t.pr_id),
push AS (SELECT t.*, 'force_push' AS response_source, NULL::BIGINT, NULL::BIGINT, e.actor_login, NULL::VARCHAR, e.dt FROM ct t JOIN lt e ON e.pr_id = t.pr_id)"""
_SQL = f"""WITH {B.CORPUS_SQL},
cf AS (SELECT lx.*, repo_id, author_agent, author_login, created_dt, closed_dt, merged_dt FROM lx JOIN bb USING (pr_id) WHERE actor_agent IS NOT NULL AND dt >= created_dt AND (closed_dt IS NULL OR dt <= closed_dt)),
ct AS (SELECT pr_id, repo_id, author_agent, author_login, closed_dt, merged_dt, event_id AS trigger_event_id, review_id AS trigger_review_id, source AS trigger_source, actor_agent AS trigger_agent, dt AS trigger_dt
  FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY dt, source, event_id) AS k FROM cf WHERE actor_agent <> author_agent) WHERE k = 1 AND dt <= TIMESTAMP '{CUTOFF}' - INTERVAL 7 DAY),
{_RULES},
cr0 AS (SELECT * FROM direct UNION ALL SELECT * FROM review UNION ALL SELECT * FROM comment UNION ALL SELECT * FROM push),
cr AS (SELECT *, datesub('second', trigger_dt, dt) / 3600.0 AS hours_after, CASE lower(actor_login) WHEN 'a-bot' THEN 'A' WHEN 'b-bot' THEN 'B' END AS actor_agent FROM cr0
  WHERE dt > trigger_dt AND dt <= trigger_dt + INTERVAL 7 DAY AND (closed_dt IS NULL OR dt <= closed_dt)),
ch AS (SELECT ct.pr_id, any_value(ct.trigger_dt) AS trigger_dt, count(*) FILTER (WHERE response_source = 'direct_inline_reply') AS direct_inline_replies, count(*) FILTER (WHERE response_source = 'subsequent_review') AS subsequent_reviews,
  count(*) FILTER (WHERE response_source = 'subsequent_pr_comment') AS subsequent_pr_comments, count(*) FILTER (WHERE response_source = 'force_push') AS force_push_events,
  min(dt) FILTER (WHERE response_source = 'direct_inline_reply') AS d1, min(dt) FILTER (WHERE response_source = 'subsequent_review') AS d2, min(dt) FILTER (WHERE response_source = 'subsequent_pr_comment') AS d3,
  min(dt) FILTER (WHERE response_source = 'force_push') AS d4, min(dt) AS d0, coalesce(bool_or(ct.merged_dt > ct.trigger_dt AND ct.merged_dt <= ct.trigger_dt + INTERVAL 7 DAY), false) AS merged FROM ct LEFT JOIN cr ON cr.pr_id = ct.pr_id GROUP BY 1)"""


def _tables(spark, d):
    return B.corpus(spark, d)


def _interactions(spark, d):
    return loaders.interactions(_tables(spark, d), B.ALIASES)


def _triggers(spark, d):
    items = loaders.backbone(_tables(spark, d))
    known = _interactions(spark, d).join(items.select("pr_id", "repo_id", "author_agent", "author_login"), "pr_id")
    return cohort.first_triggers(cohort.feedback_events(known, items), mature_until=X.after(F.lit(CUTOFF).cast("timestamp_ntz"), days=-7)).drop("cross_agent")


def _responses(spark, d):
    t = _tables(spark, d)
    return channels.channel_responses(_triggers(spark, d), loaders.inline_comments(t), loaders.reviews(t), loaders.comments(t), loaders.rewrites(t), B.ALIASES)


def _chains(spark, d):
    return channels.channel_chains(_triggers(spark, d), _responses(spark, d))


def q_loaded(spark, d):
    return _interactions(spark, d).select("pr_id", "event_id", "review_id", "parent_id", "source", "actor_login", "actor_agent", "interaction_dt")


def q_backbone(spark, d):
    return loaders.backbone(_tables(spark, d)).select("pr_id", "repo_id", "author_agent", "author_login", "created_dt", "closed_dt", "merged_dt")


def q_responses(spark, d):
    return _responses(spark, d).select("pr_id", "trigger_event_id", "response_source", "event_id", "review_id", "role", F.round("hours_after", 6).alias("hours_after"))


def q_chains(spark, d):
    names = {"direct_inline_reply": "d1", "subsequent_review": "d2", "subsequent_pr_comment": "d3", "force_push": "d4"}
    return _chains(spark, d).select("pr_id", *channels.CHANNELS.values(), *(F.col(f"first_{k}_dt").alias(v) for k, v in names.items()), "any_observable_response", "merged_within_response_window")


def q_funnel(spark, d):
    return channels.channel_funnel(_chains(spark, d)).withColumns({"share": F.round("share", 9), "median_hours": F.round("median_hours", 6)})


def q_labelled(spark, d):
    return loaders.labelled_items(_tables(spark, d)).select("id", "task_type", "merged_30d")


def q_training(spark, d):
    return loaders.training_items(_tables(spark, d)).select("id", "title", "task_type", "confidence", "created_dt")


def q_predicted(spark, d):
    t = _tables(spark, d)
    return loaders.predicted_items(t, t("predictions"), 0.4).select("id", "task_type", "margin", "merged_30d")


def q_overlap(spark, d):
    t = _tables(spark, d)
    triggers = _triggers(spark, d).select("pr_id", "author_agent", "trigger_agent", "trigger_dt")
    return loaders.overlap(triggers, loaders.item_map(t), loaders.cross_pairs(t("other_pairs"))).select("pr_id", "repo_name", "pr_number", "exact_pair", "any_pair", F.round("hours_later", 6).alias("hours_later"))


def _matched(spark, d):
    """Chains of triggers by one product beside the nearest in time by the other, with counters a_ and b_."""
    c = _chains(spark, d).withColumn("not_inline", F.col("trigger_source") != loaders.INLINE)
    frame = c.select("pr_id", F.floor(F.col("repo_id") / 5).alias("group"), (F.col("trigger_agent") == "A").alias("arm"), "trigger_dt")
    pairs = matching.nearest_without_replacement(frame, ["group"], "arm", "trigger_dt", "pr_id")
    kept = ("trigger_source", "not_inline", *channels.CHANNELS.values())
    a, b = (c.select(F.col("pr_id").alias(i), *(F.col(k).alias(f"{s}_{k}") for k in kept)) for i, s in (("exposed_id", "a"), ("control_id", "b")))
    return pairs.join(a, "exposed_id").join(b, "control_id")


def q_reachability(spark, d):
    out = matching.reachability(_matched(spark, d), "a_trigger_source", "b_trigger_source", loaders.INLINE)
    return out.withColumn("share", F.round("share", 9))


def q_safety(spark, d):
    names = list(channels.CHANNELS.values())
    return matching.outcome_safety(_matched(spark, d), {n: n for n in names}, "not_inline", names[0], names[1:])


_MATCHED = _SQL.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + greedy_sql("SELECT repo_id // 5 AS stratum, pr_id AS id, trigger_agent = 'A' AS arm, epoch_us(trigger_dt) AS t FROM ct") + """,
cx AS (SELECT ch.*, trigger_source FROM ch JOIN ct USING (pr_id)),
mp AS (SELECT a.trigger_source AS sa, b.trigger_source AS sb, a.direct_inline_replies AS a1, a.subsequent_reviews AS a2, a.subsequent_pr_comments AS a3, a.force_push_events AS a4, b.direct_inline_replies AS b1, b.subsequent_reviews AS b2, b.subsequent_pr_comments AS b3, b.force_push_events AS b4
  FROM mt JOIN cx a ON a.pr_id = CAST(exposed_id AS BIGINT) JOIN cx b ON b.pr_id = CAST(control_id AS BIGINT))"""
_SAFETY = " UNION ALL ".join(
    f"SELECT '{name}' AS outcome, count(*) FILTER (WHERE a{k} > 0 AND sa <> 'inline_review_comment') AS blind_positives_a, count(*) FILTER (WHERE b{k} > 0 AND sb <> 'inline_review_comment') AS blind_positives_b, count(*) FILTER (WHERE a1 > 0 AND a2 + a3 + a4 = 0) AS only_anchored_a, count(*) FILTER (WHERE b1 > 0 AND b2 + b3 + b4 = 0) AS only_anchored_b FROM mp"
    for k, name in enumerate(channels.CHANNELS.values(), 1)
)
_TITLED = B.CORPUS_SQL + """, ti AS (SELECT pr_id AS id, CASE pr_id % 5 WHEN 0 THEN 'feat: x' WHEN 1 THEN 'Fix(core)!: y' WHEN 2 THEN 'docs z' WHEN 3 THEN 'perf: q' END AS title, created_dt, coalesce(merged_dt >= created_dt AND merged_dt <= created_dt + INTERVAL 30 DAY, false) AS merged_30d FROM bb)"""
_ROLE = """CASE WHEN lower(user_type) = 'user' AND lower(actor_login) = lower(author_login) THEN 'author_account' WHEN actor_agent = author_agent THEN 'author_agent_brand' WHEN actor_agent = trigger_agent THEN 'triggering_reviewer_brand'
  WHEN actor_agent IS NOT NULL THEN 'other_agent_brand' WHEN lower(user_type) = 'bot' THEN 'other_bot' WHEN lower(user_type) = 'user' THEN 'other_human' ELSE 'unknown_actor' END"""
_EACH = " UNION ALL ".join(
    f"SELECT '{name}' AS channel, trigger_dt, {dt} AS dt, {n} AS n FROM ch"
    for name, dt, n in (
        ("any", "d0", "direct_inline_replies + subsequent_reviews + subsequent_pr_comments + force_push_events"), ("direct_inline_reply", "d1", "direct_inline_replies"), ("subsequent_review", "d2", "subsequent_reviews"),
        ("subsequent_pr_comment", "d3", "subsequent_pr_comments"), ("force_push", "d4", "force_push_events"),
    )
)

QUERIES = {
    "loaded_interactions": (q_loaded, f"WITH {B.CORPUS_SQL} SELECT pr_id, event_id, review_id, parent_id, source, actor_login, actor_agent, dt AS interaction_dt FROM lx"),
    "loaded_backbone": (q_backbone, f"WITH {B.CORPUS_SQL} SELECT pr_id, repo_id, author_agent, author_login, created_dt, closed_dt, merged_dt FROM bb"),
    "channel_responses": (q_responses, f"{_SQL} SELECT pr_id, trigger_event_id, response_source, event_id, review_id, {_ROLE} AS role, round(hours_after, 6) AS hours_after FROM cr"),
    "channel_chains": (q_chains, f"{_SQL} SELECT pr_id, direct_inline_replies, subsequent_reviews, subsequent_pr_comments, force_push_events, d1, d2, d3, d4, d0 IS NOT NULL AS any_observable_response, merged AS merged_within_response_window FROM ch"),
    "channel_funnel": (q_funnel, f"{_SQL}, e AS ({_EACH}) SELECT channel, count(*) AS n_triggers, count(dt) AS n_answered, round(count(dt) / count(*), 9) AS share, CAST(sum(n) AS BIGINT) AS n_responses, round(median(datesub('second', trigger_dt, dt) / 3600.0), 6) AS median_hours FROM e GROUP BY 1"),
    "pair_reachability": (q_reachability, f"{_MATCHED} SELECT sa AS a_trigger_source, sb AS b_trigger_source, count(*) AS pairs, sa = 'inline_review_comment' AND sb = 'inline_review_comment' AS both_can_ever_fire, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS share FROM mp GROUP BY 1, 2"),
    "outcome_safety": (q_safety, f"{_MATCHED} {_SAFETY}"),
    "labelled_items": (q_labelled, f"WITH {_TITLED} SELECT id, CASE id % 5 WHEN 0 THEN 'feat' WHEN 1 THEN 'fix' WHEN 3 THEN 'perf' END AS task_type, merged_30d FROM ti"),
    "training_items": (q_training, f"WITH {_TITLED} SELECT id, coalesce(title, '') AS title, CASE id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'maintenance' ELSE 'fix' END AS task_type, id % 10 AS confidence, created_dt FROM ti WHERE id % 4 <> 0"),
    "predicted_items": (q_predicted, f"WITH {_TITLED} SELECT id, CASE WHEN id % 7 <> 0 AND id % 10 >= 4 THEN CASE WHEN id % 2 = 0 THEN 'docs' ELSE 'fix' END END AS task_type, CASE WHEN id % 7 <> 0 THEN CAST(id % 10 AS DOUBLE) / 10 END AS margin, merged_30d FROM ti"),
    "corpus_overlap": (
        q_overlap,
        f"""{_SQL}, ot AS (SELECT pr_id, min(dt) AS seen_dt FROM ev WHERE event_type IN ('error', 'signup') AND pr_id % 3 <> 0 GROUP BY 1)
SELECT ct.pr_id, 'own/r' || ct.pr_id % 20 AS repo_name, ct.pr_id * 3 AS pr_number, ot.pr_id IS NOT NULL AND trigger_agent <> author_agent AS exact_pair, ot.pr_id IS NOT NULL AS any_pair, round(datesub('second', trigger_dt, seen_dt) / 3600.0, 6) AS hours_later FROM ct LEFT JOIN ot USING (pr_id)""",
    ),
}
