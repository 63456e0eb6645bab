"""What follows a trigger, by channel: each has a rule of its own for what counts as a response.

1. ``direct_inline_reply``: an inline comment whose parent is the trigger, which is an inline comment itself.
2. ``subsequent_review``: another review than the trigger's.
3. ``subsequent_pr_comment``: any comment.
4. ``force_push``: a rewritten branch.

All lie in (trigger, end] and not after the close. Channels keep their own rows,
so an inline comment and the review it was sent with both count, as they are both seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.functions.columns import actor_role, after, hours, product_of
from threadline.operators.cohort import within
from threadline.sources.loaders import INLINE

#: The channels in order, and the counters that a chain has for them.
CHANNELS = {"direct_inline_reply": "direct_inline_replies", "subsequent_review": "subsequent_reviews", "subsequent_pr_comment": "subsequent_pr_comments", "force_push": "force_push_events"}
_COLUMNS = ("pr_id", "event_id", "review_id", "actor_login", "user_type", "interaction_dt")


def _whole(df: DataFrame, source: str) -> DataFrame:
    kinds = {"event_id": "bigint", "review_id": "bigint", "user_type": "string"}
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in _COLUMNS), F.lit(source).alias("response_source"))


def channel_responses(triggers: DataFrame, inline: DataFrame, reviews: DataFrame, comments: DataFrame, rewrites: DataFrame, aliases: dict[str, str], days: int = 7) -> DataFrame:
    """Every response with its channel, actor's product and role, and hours after the trigger.

    The channels are stacked first: one equi-join on the item, whose residual has each channel's rule. A reply's parent
    is the trigger, so what the rule asks of the parent (its time, its product, its item) is what the trigger has.
    """
    parents = inline.filter("parent_id is not null").select(*_COLUMNS, "parent_id", F.lit("direct_inline_reply").alias("response_source"))
    events = parents
    for df, source in ((reviews, "subsequent_review"), (comments, "subsequent_pr_comment"), (rewrites, "force_push")):
        events = events.unionByName(_whole(df, source), allowMissingColumns=True)
    t = triggers.select("pr_id", "repo_id", "author_login", "author_agent", "closed_dt", "merged_dt", "trigger_dt", "trigger_agent", "trigger_source", "trigger_event_id", "trigger_review_id")
    source = F.col("response_source")
    direct = (F.col("trigger_source") == INLINE) & (F.col("parent_id") == F.col("trigger_event_id"))
    other = F.col("trigger_review_id").isNull() | (F.col("review_id") != F.col("trigger_review_id"))
    rule = F.when(source == "direct_inline_reply", direct).when(source == "subsequent_review", other).otherwise(True)
    met = t.join(events, "pr_id").filter(within("interaction_dt", "trigger_dt", after("trigger_dt", days=days)) & F.coalesce(rule, F.lit(False)))
    known = met.withColumn("actor_agent", product_of("actor_login", aliases))
    return known.withColumns({"role": actor_role("actor_login", "actor_agent", "user_type", "author_login", "author_agent", "trigger_agent"), "hours_after": hours("trigger_dt", "interaction_dt")})


def channel_chains(triggers: DataFrame, responses: DataFrame, days: int = 7) -> DataFrame:
    """One row per trigger: for each channel how many responses and when the first, whether any, and whether merged within the window."""
    source = F.col("response_source")
    counted = responses.groupBy("pr_id").agg(
        *(F.count_if(source == k).alias(v) for k, v in CHANNELS.items()), *(F.min(F.when(source == k, F.col("interaction_dt"))).alias(f"first_{k}_dt") for k in CHANNELS), F.min("interaction_dt").alias("first_response_dt")
    )
    zero = F.lit(0).cast("bigint")
    out = triggers.join(counted, "pr_id", "left").withColumns({v: F.coalesce(v, zero) for v in CHANNELS.values()})
    merged = (F.col("merged_dt") > F.col("trigger_dt")) & (F.col("merged_dt") <= after("trigger_dt", days=days))
    return out.withColumns({"any_observable_response": F.col("first_response_dt").isNotNull(), "merged_within_response_window": F.coalesce(merged, F.lit(False))})


def channel_funnel(chains: DataFrame) -> DataFrame:
    """channel, n_triggers, n_answered, share, n_responses, median hours to the first: all channels and each, in one pass over the chains."""
    rows = F.array(
        F.struct(F.lit("any").alias("channel"), F.col("first_response_dt").alias("dt"), sum((F.col(v) for v in CHANNELS.values()), F.lit(0).cast("bigint")).alias("n")),
        *(F.struct(F.lit(k).alias("channel"), F.col(f"first_{k}_dt").alias("dt"), F.col(v).alias("n")) for k, v in CHANNELS.items()),
    )
    each = chains.select("trigger_dt", F.inline(rows))
    return each.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n_triggers"), F.count("dt").alias("n_answered"), (F.count("dt") / F.count(F.lit(1))).alias("share"), F.sum("n").alias("n_responses"),
        F.percentile(hours("trigger_dt", "dt"), F.lit(0.5)).alias("median_hours"),
    )
