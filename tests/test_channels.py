"""Each channel's own rule, and loaders of a corpus' tables."""

from datetime import datetime as dt

from threadline.operators import channels
from threadline.sources import loaders

T0 = "2024-03-01T00:00:00Z"
ALIASES = {"A-Bot": "A", "b-bot": "B"}


def tables(spark):
    def at(h):
        return f"2024-03-{1 + h // 24:02d}T{h % 24:02d}:00:00Z"

    frames = {
        "pull_request": spark.createDataFrame([(1, 11, 7, "u", "A", "Ann", T0, at(100), at(100)), (2, 12, 7, "u", "A", "Bob", T0, None, None), (3, 13, 8, "u", "A", "Cy", "bad", None, None)], "id long, number long, repo_id long, repo_url string, agent string, user string, created_at string, closed_at string, merged_at string"),
        # review 50 has two rows and so the least item; the inline comments of review 99 have no item
        "pr_reviews": spark.createDataFrame([(500, 1, 50, "B-bot", "Bot", "COMMENTED", at(10)), (501, 2, 50, "x", "User", None, at(500)), (502, 1, 51, "ann", "User", "APPROVED", at(12)), (503, 1, None, "z", "User", None, at(13)), (504, 2, 60, "b-bot", "Bot", None, at(20))], "id long, pr_id long, pull_request_review_id long, user string, user_type string, state string, submitted_at string"),
        "pr_comments": spark.createDataFrame([(600, 1, "a-bot", "Bot", at(11)), (601, 1, "dan", None, at(101)), (602, 2, "b-bot", "bot", at(20)), (603, 1, "eve", "User", at(10))], "id long, pr_id long, user string, user_type string, created_at string"),
        "pr_review_comments": spark.createDataFrame(
            [(700, 50, "B-BOT", "Bot", None, at(9)), (701, 50, "Ann", "User", "700.0", at(10)), (702, 51, "dan", "User", "700", at(99)), (703, 51, "dan", "User", "701", at(14)), (704, 51, "dan", "User", "700", at(9)), (705, 51, "dan", "User", "700", at(101)), (706, 99, "dan", "User", "700", at(15)), (707, 60, "ann", "User", "700", at(30))],
            "id long, pull_request_review_id long, user string, user_type string, in_reply_to_id string, created_at string",
        ),
        "pr_timeline": spark.createDataFrame([(1, "head_ref_force_pushed", "ann", at(50)), (1, "closed", "ann", at(50)), (2, "head_ref_force_pushed", None, at(20 + 168)), (2, "head_ref_force_pushed", None, at(20 + 169))], "pr_id long, event string, actor string, created_at string"),
    }
    return frames.__getitem__


def found(spark):
    from threadline.operators import cohort

    t = tables(spark)
    items = loaders.backbone(t)
    known = loaders.interactions(t, ALIASES).join(items.select("pr_id", "repo_id", "author_agent", "author_login"), "pr_id")
    triggers = cohort.first_triggers(cohort.feedback_events(known, items)).drop("cross_agent")
    responses = channels.channel_responses(triggers, loaders.inline_comments(t), loaders.reviews(t), loaders.comments(t), loaders.rewrites(t), ALIASES)
    return triggers, responses


def test_interactions_of_three_channels(spark):
    rows = loaders.interactions(tables(spark), ALIASES).collect()
    of = {r.event_id: r for r in rows}
    assert len(rows) == 16 and 706 not in of and of[700].pr_id == of[702].pr_id == 1 and of[707].pr_id == 2
    assert (of[700].source, of[700].actor_agent, of[700].parent_id, of[701].parent_id) == ("inline_review_comment", "B", None, 700)
    assert (of[600].actor_agent, of[602].source, of[500].state, of[603].review_id) == ("A", "pr_comment", "COMMENTED", None)
    assert {r.pr_id: r.created_dt for r in loaders.backbone(tables(spark)).collect()} == {1: dt(2024, 3, 1), 2: dt(2024, 3, 1), 3: None}


def test_rules_of_the_channels(spark):
    triggers, responses = found(spark)
    t = {r.pr_id: r for r in triggers.collect()}
    assert (t[1].trigger_event_id, t[1].trigger_source, t[1].trigger_review_id) == (700, "inline_review_comment", 50)
    assert (t[2].trigger_event_id, t[2].trigger_source) == (602, "pr_comment")
    got = {(r.pr_id, r.response_source, r.event_id): (r.role, r.hours_after) for r in responses.collect()}
    assert got == {
        (1, "direct_inline_reply", 701): ("author_account", 1.0), (1, "direct_inline_reply", 702): ("other_human", 90.0),
        (1, "subsequent_review", 502): ("author_account", 3.0), (1, "subsequent_pr_comment", 600): ("author_agent_brand", 2.0), (1, "subsequent_pr_comment", 603): ("other_human", 1.0),
        (1, "force_push", None): ("unknown_actor", 41.0), (2, "force_push", None): ("unknown_actor", 168.0),
    }


def test_chains_and_funnel(spark):
    triggers, responses = found(spark)
    chains = channels.channel_chains(triggers, responses)
    of = {r.pr_id: r for r in chains.collect()}
    assert [of[1][c] for c in channels.CHANNELS.values()] == [2, 1, 2, 1] and [of[2][c] for c in channels.CHANNELS.values()] == [0, 0, 0, 1]
    assert of[1].merged_within_response_window and not of[2].merged_within_response_window and of[1].first_subsequent_review_dt == dt(2024, 3, 1, 12)
    funnel = {r.channel: r for r in channels.channel_funnel(chains).collect()}
    assert (funnel["any"].n_triggers, funnel["any"].n_answered, funnel["any"].n_responses) == (2, 2, 7)
    assert (funnel["direct_inline_reply"].share, funnel["force_push"].median_hours) == (0.5, 104.5)


def test_other_corpus_and_given_tasks(spark):
    import pytest

    t = {
        "pull_request": spark.createDataFrame([(1, 5, "https://github.com/O/R/", "A", 1, "Fix: a", T0, "2024-03-31T00:00:00Z"), (2, 6, "https://api.github.com/repos/o/r", "A", 1, None, T0, "2024-03-31T00:00:01Z")], "id long, number long, repo_url string, agent string, user_id long, title string, created_at string, merged_at string"),
        "pr_task_type": spark.createDataFrame([(2, "perf", 9)], "id long, type string, confidence int"),
    }
    assert {(r.id, r.task_type, r.merged_30d) for r in loaders.labelled_items(t.__getitem__).collect()} == {(1, "fix", True), (2, None, False)}
    assert [(r.id, r.title, r.task_type) for r in loaders.training_items(t.__getitem__).collect()] == [(2, "", "maintenance")]
    p = spark.createDataFrame([(1, "docs", 0.5), (2, "fix", 0.1)], "id long, task_type string, margin double")
    assert {(r.id, r.task_type) for r in loaders.predicted_items(t.__getitem__, p, 0.2).collect()} == {(1, "docs"), (2, None)}
    with pytest.raises(ValueError, match="not unique"):
        loaders.predicted_items(t.__getitem__, p.union(p))
    pairs = spark.createDataFrame([("o/R", 5, "A", "B", dt(2024, 3, 2)), ("O/R/", 5, "A", "B", dt(2024, 3, 3)), ("o/r", 6, "A", "C", dt(2024, 3, 2))], "repo_name string, pr_number long, author_agent string, reviewer_agent string, first_review_at timestamp_ntz")
    triggers = spark.createDataFrame([(1, "A", "B", dt(2024, 3, 1, 12)), (2, "A", "B", dt(2024, 3, 1))], "pr_id long, author_agent string, trigger_agent string, trigger_dt timestamp_ntz")
    got = {r.pr_id: (r.exact_pair, r.any_pair, r.hours_later) for r in loaders.overlap(triggers, loaders.item_map(t.__getitem__), loaders.cross_pairs(pairs)).collect()}
    assert got == {1: (True, True, 12.0), 2: (False, True, None)}
    with pytest.raises(ValueError, match="one product"):
        loaders.cross_pairs(spark.createDataFrame([("o/r", 5, "A", "A", dt(2024, 3, 2))], pairs.schema))


def test_repositories_and_all_items(spark):
    t = {
        "all_repository": spark.createDataFrame([(2, "u", "py", 1, 2, False), (1, "u", "go", 3, 4, True), (3, "v", None, 0, 0, None)], "id long, url string, language string, stars long, forks long, is_forked boolean"),
        "all_pull_request": spark.createDataFrame([(1, "u", 7, "A", 5, "closed", T0, None, T0)], "id long, repo_url string, repo_id long, agent string, user_id long, state string, created_at string, closed_at string, merged_at string"),
    }
    assert {(r.repo_url, r.repository_id, r.language) for r in loaders.repositories(t.__getitem__).collect()} == {("u", 1, "go"), ("v", 3, None)}
    r = loaders.all_items(t.__getitem__).first()
    assert (r.merged, r.closed_dt, r.merged_dt) == (True, None, dt(2024, 3, 1))
