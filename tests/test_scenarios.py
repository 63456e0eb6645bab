"""Small scenarios for operators whose rules are easy to get wrong."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from threadline.functions import columns as X
from threadline.functions import text as T
from threadline.operators import asof, audit, cohort, ledger, matching, sequence, survival
from threadline.sources import tables
from threadline.streaming import events as S

DAY0 = datetime(2024, 1, 1)
ITEM = "pr_id long, repo_id long, user_id long, agent string, created_dt timestamp_ntz, closed_dt timestamp_ntz, merged_dt timestamp_ntz"


def day(n):
    return None if n is None else DAY0 + timedelta(days=n)


def items(spark, rows):
    return spark.createDataFrame([(i, 1, u, a, day(c), day(x), day(m)) for i, u, a, c, x, m in rows], ITEM)


def test_an_open_item_is_no_predecessor(spark):
    df = items(spark, [(1, 1, "a", 0, 2, 2), (2, 1, "b", 1, 10, 10), (3, 2, "b", 3, 5, None)])
    got = {r.pr_id: (r.prior_pr_id, r.switched) for r in ledger.transitions(df, F.lit(day(100))).collect()}
    assert got == {3: (1, True)}


def test_event_study_counts_from_the_onset(spark):
    df = items(spark, [(i, 1, "a" if i < 3 else "b", i, i + 1, i + 1) for i in range(1, 6)])
    assert sorted(r.event_index for r in ledger.event_study(df).collect()) == [-2, -1, 0, 1, 2]


def test_transition_types(spark):
    df = spark.createDataFrame([(True, False), (True, True), (False, False), (False, True), (None, False)], "same_user boolean, switched boolean")
    got = [r[0] for r in df.select(X.transition_type()).collect()]
    assert got == ["persistence", "brand_change_same_contributor", "contributor_change_stable_agent", "joint_reconfiguration", "joint_reconfiguration"]


def test_three_step_chain_and_ties(spark):
    df = items(spark, [(9, 1, "a", 0, 1, 1), (10, 1, "a", 2, 3, None), (11, 1, "a", 4, 5, None), (12, 1, "a", 6, None, None)])
    got = {r.pr_id: (r.p1_pr_id, r.p2_pr_id, r.p3_pr_id, r.streak) for r in ledger.streaks(ledger.decision_chains(df)).collect()}
    assert got[12] == (11, 10, 9, "2") and got[11] == (10, 9, None, "1") and got[10] == (9, None, None, "0")
    tied = items(spark, [(1, 1, "a", 0, 2, None), (2, 1, "a", 1, 5, None), (3, 1, "a", 1, 5, None), (4, 1, "a", 6, 7, None)])
    assert sorted(r.pr_id for r in ledger.resolved_events(tied).collect()) == [1, 4]


@pytest.mark.parametrize(("start", "found"), [(20, 1), (60, 0)])
def test_file_successor_within_the_window(spark, start, found):
    df = items(spark, [(1, 1, "a", 0, 10, None), (2, 1, "b", start, start + 2, start + 2)])
    files = spark.createDataFrame([(1, "x.py"), (1, "y.py"), (2, "x.py"), (2, "z.py")], "pr_id long, filename string")
    got = ledger.file_successors(df, files).collect()
    assert len(got) == found
    if found:
        assert (got[0].shared_files, got[0].mode, got[0].recovered) == (1, "brand_change_same_contributor", True)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [True, False])
def test_asof_against_brute_force(spark, direction, strict):
    import random

    rng = random.Random(3)
    left = [(i, rng.randrange(4), rng.choice([None, *range(12)])) for i in range(80)]
    right = [(100 + i, rng.randrange(4), rng.choice([None, *range(12)])) for i in range(60)]
    a = spark.createDataFrame([(i, k, day(t)) for i, k, t in left], "id long, k long, t timestamp_ntz")
    b = spark.createDataFrame([(i, k, day(t)) for i, k, t in right], "id long, k long, t timestamp_ntz")
    got = {r.id: r.prior_id for r in asof.asof_join(a, b, "t", "t", ["k"], ["id"], direction, strict, tie=["id"]).collect()}
    for i, k, t in left:
        ok = [(u, j) for j, q, u in right if t is not None and q == k and u is not None and (u < t if direction == "backward" else u > t) or (not strict and t is not None and q == k and u == t)]
        want = None if not ok else (max(ok)[1] if direction == "backward" else min(ok)[1])
        assert got[i] == want, (i, k, t)


def test_alias_map_and_normalisers(spark):
    df = spark.createDataFrame([("Bot-A",), ("bot-a",), ("human",), (None,)], "user string")
    assert [r[0] for r in df.select(X.product_of("user", {"bot-A": "A"})).collect()] == ["A", "A", None, None]
    urls = spark.createDataFrame([("https://example.org/Own/Name.git/",), ("git@example.org:own/name.git",), ("own/name",), ("bad",), (None,)], "u string")
    assert [r[0] for r in urls.select(X.repo_slug("u")).collect()] == ["own/name"] * 3 + [None, None]
    refs = spark.createDataFrame([("https://x/y/1#issuecomment-12",), ("https://x/y/1#discussion_r34",), ("none",)], "u string")
    assert [r[0] and tuple(r[0]) for r in refs.select(X.comment_reference("u")).collect()] == [("issuecomment", 12), ("discussion_r", 34), None]
    numbers = spark.createDataFrame([("7",), ("-1",), ("x",)], "n string")
    assert [r[0] for r in numbers.select(X.positive_number("n")).collect()] == [7, None, None]
    times = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("bad",)], "t string")
    assert [r[0] is None for r in times.select(X.parse_time("t")).collect()] == [False, True]


def test_api_addresses_of_comments(spark):
    rows = ["https://api.x/repos/o/r/pulls/comments/12", " /pulls/comments/3/ ", "/issues/comments/4-2?a", "/issues/comments/5", "/issues/comments/6-", "/pulls/comments/7x", "", None]
    got = spark.createDataFrame([(x,) for x in rows], "u string").select(X.public_comment("u").alias("r")).collect()
    assert [r.r and tuple(r.r) for r in got] == [("review_comment", 12, None), ("review_comment", 3, None), ("issue_comment", 4, 2), ("issue_comment", 5, None), None, None, None, None]


def test_types_of_titles(spark):
    titles = spark.createDataFrame([("feat(core)!: x",), ("Fix: y",), ("anything",), ("feature: x",), ("[WIP] fix: y",), ("docs : z",), ("bugfix: q",), ("tests: a",), ("fixes: b",), (None,)], "t string")
    assert [r[0] for r in titles.select(T.task_of_title("t")).collect()] == ["feat", "fix", None, "feat", "fix", "docs", "fix", "test", None, None]


def test_titles_are_normalised(spark):
    rows = ["[WIP] feat(api)!: Fix &amp; Café by Claude Code see https://x.org/a b", "chore: docs: deadbeef1 deadbee", "plain  Title\n two", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(T.normalise("t")).collect()]
    assert got == [": fix & café by agent see url b", "sha deadbee", "plain title two", ""]
    refs = spark.createDataFrame([("fixes #12, a#13 _#14 and #12",), ("see https://github.com/o/r/issues/77 #9",), (None,)], "t string")
    assert [r[0] for r in refs.select(T.issue_refs("t")).collect()] == [["12"], ["77", "9"], []]
    pair = spark.createDataFrame([("feat: a.b-c x", "a.b-c y")], "a string, b string")
    assert abs(pair.select(T.jaccard(T.tokens("a"), T.tokens("b"))).first()[0] - 1 / 3) < 1e-12


WHO = ("actor_login", "actor_agent", "user_type", "author_login", "author_agent", "trigger_agent")


@pytest.mark.parametrize(
    ("who", "moved", "role", "owner", "state"),
    [
        (("Ann", None, "USER", "ann", "a", "b"), False, "author_account", "author_human", "user_account"),
        (("bob", "b", "User", "ann", "a", "b"), False, "triggering_reviewer_brand", "other_human", "user_account"),
        (("ann", "a", "Bot", "ann", "a", "b"), False, "author_agent_brand", "author_agent", "mapped_product"),
        (("x", "b", None, "ann", "a", "b"), True, "triggering_reviewer_brand", "triggering_reviewer", "mapped_product"),
        (("x", "c", "bot", "ann", "a", "b"), False, "other_agent_brand", "other_agent", "mapped_product"),
        (("x", None, "BOT", "ann", "a", "b"), True, "other_bot", "other_bot", "other_bot"),
        (("ANN", None, None, "ann", "a", "b"), True, "unknown_actor", "author_account_untyped", "branch_movement_untyped"),
        (("x", None, None, "ann", "a", "b"), True, "unknown_actor", "branch_actor_untyped", "branch_movement_untyped"),
        (("ann", None, None, "ann", "a", "b"), False, "unknown_actor", "unknown", "branch_movement_untyped"),
        (("bob", None, "user", "ann", "a", "b"), True, "other_human", "other_human", "user_account"),
    ],
)
def test_roles_owners_and_states(spark, who, moved, role, owner, state):
    df = spark.createDataFrame([(*who, moved)], ", ".join(f"{x} string" for x in WHO) + ", moved boolean")
    got = df.select(X.actor_role(*WHO), X.owner(*WHO, F.col("moved")), X.atomic_state(F.col("actor_agent"), F.col("user_type"))).first()
    assert tuple(got) == (role, owner, state)


@pytest.mark.parametrize(("trigger_review", "found"), [(None, {2, 3, 4}), (7, {3, 4})])
def test_events_without_a_review_are_responses(spark, trigger_review, found):
    triggers = spark.createDataFrame([(1, DAY0, None, 1, trigger_review, "t", "a", "ann")], "pr_id long, trigger_dt timestamp_ntz, closed_dt timestamp_ntz, trigger_event_id long, trigger_review_id long, trigger_agent string, author_agent string, author_login string")
    rows = [(1, 2, 7, None, "review", day(1), "x", None, "User"), (1, 3, None, None, "comment", day(1), "x", None, "User"), (1, 4, 8, None, "review", day(2), "x", None, "User"), (1, 5, None, None, "comment", day(9), "x", None, "User")]
    ix = spark.createDataFrame(rows, "pr_id long, event_id long, review_id long, parent_id long, source string, interaction_dt timestamp_ntz, actor_login string, actor_agent string, user_type string")
    assert {r.event_id for r in cohort.response_events(triggers, ix).collect()} == found
    actions = sequence.debatch(cohort.response_events(triggers, ix), sequence.action_key())
    assert {r.action for r in actions.collect()} >= {"comment:3", "review:8"}


def test_triggers_must_be_mature(spark):
    rows = [(1, 1, "s", day(1), True), (1, 2, "s", day(3), True), (2, 3, "s", day(9), True)]
    fb = spark.createDataFrame([(*r, None, "a") for r in rows], "pr_id long, event_id long, source string, interaction_dt timestamp_ntz, cross_agent boolean, review_id long, actor_agent string")
    assert [r.trigger_event_id for r in cohort.first_triggers(fb, mature_until=F.lit(day(5))).collect()] == [1]


def test_owner_ties_and_routes(spark):
    t = spark.createDataFrame([(1, DAY0), (2, DAY0), (3, DAY0)], "pr_id long, trigger_dt timestamp_ntz")
    rows = [(1, day(1), "other_human", "User", None, 24.0, "click"), (1, day(1), "other_bot", "Bot", None, 24.0, "view"), (2, day(1), "other_bot", "Bot", None, 24.0, "view"), (2, day(3), "other_human", "User", None, 72.0, "click")]
    r = spark.createDataFrame(rows, "pr_id long, interaction_dt timestamp_ntz, owner string, user_type string, actor_agent string, hours_after double, source string")
    first = {x.pr_id: x.first_owner for x in cohort.first_actions(t, r).collect()}
    assert first == {1: "simultaneous_owners", 2: "other_bot", 3: "no_observed_action"}
    assert {x.pr_id: x.route for x in cohort.routes(t, r).collect()} == {1: "human_first", 2: "automation_no_human", 3: "no_observed_action"}


def test_episode_gap_is_strict(spark):
    rows = [(1, i, DAY0 + timedelta(minutes=m)) for i, m in enumerate([0, 10, 20, 31])]
    df = spark.createDataFrame(rows, "pr_id long, event_id long, interaction_dt timestamp_ntz")
    assert [r.episode for r in sequence.episodes(df, 10).orderBy("event_id").collect()] == [1, 1, 1, 2]


def test_greedy_matching_against_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(i, rng.choice("xy"), rng.random() < 0.4, DAY0 + timedelta(hours=rng.randrange(400))) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, s string, arm boolean, t timestamp_ntz")
    got = {(r.exposed_id, r.control_id) for r in matching.nearest_without_replacement(df, ["s"], "arm", "t", "id").collect()}
    want = set()
    for s in "xy":
        free = [(t, i) for i, q, arm, t in rows if q == s and not arm]
        for t, i in sorted((t, i) for i, q, arm, t in rows if q == s and arm):
            if free:
                below = [f for f in free if f[0] < t]
                above = [f for f in free if f[0] >= t]
                pick = min(([min(above)] if above else []) + ([max(below)] if below else []), key=lambda f: abs(f[0] - t))
                free.remove(pick)
                want.add((i, pick[1]))
    assert got == want


def test_of_two_controls_as_near_the_later_is_taken(spark):
    rows = [(1, True, DAY0 + timedelta(hours=5)), (2, False, DAY0 + timedelta(hours=4)), (3, False, DAY0 + timedelta(hours=6))]
    df = spark.createDataFrame([(i, "x", a, t) for i, a, t in rows], "id long, s string, arm boolean, t timestamp_ntz")
    assert [(r.exposed_id, r.control_id) for r in matching.nearest_without_replacement(df, ["s"], "arm", "t", "id").collect()] == [(1, 3)]


def test_caliper_scales_each_cell_and_meets_only_neighbours(spark):
    import random

    rng = random.Random(2)
    rows = [(i, rng.choice("pq"), rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, cell string, a double, b double")
    z = matching.standardise(df, ["a", "b"], ["cell"])
    sums = z.groupBy("cell").agg(F.avg("z_a").alias("m"), F.stddev_pop("z_b").alias("s")).collect()
    assert all(abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9 for r in sums)
    got = {r.exposed_id: (r.control_id, r.distance) for r in matching.nearest_in_caliper(z.filter("id % 2 = 1"), z, ["cell"], ["z_a", "z_b"], "id", 0.3).collect()}
    points = {r.id: (r.cell, r.z_a, r.z_b) for r in z.collect()}
    for i in (i for i in points if i % 2):
        near = sorted((math.dist(points[i][1:], p[1:]), j) for j, p in points.items() if j != i and p[0] == points[i][0])
        assert (got.get(i) or (None,))[0] == (near[0][1] if near[0][0] <= 0.3 else None)


def test_running_sum_over_ranges(spark):
    import random

    rng = random.Random(1)
    rows = [(x, rng.randrange(5)) for x in rng.sample(range(1000), 200)]
    got = {r.k: r.before for r in asof.running_sum(spark.createDataFrame(rows, "k long, v long"), "k", "v", "before", 8).collect()}
    assert got == {k: sum(v for j, v in rows if j < k) for k, _ in rows}


def test_temporal_split_is_by_percent_rank(spark):
    from threadline.operators import learn

    df = spark.createDataFrame([(i, day(t)) for i, t in enumerate([1, 1, 2, 3, 3, 3, 4, 5, 6, 9])], "id long, t timestamp_ntz")
    got = {r.id for r in learn.temporal_split(df, "t", 0.7).filter("is_train").collect()}
    assert got == {r.id for r in df.selectExpr("id", "percent_rank() over (order by t) < 0.7 as early").filter("early").collect()}


def test_contracts_and_state(spark):
    df = spark.createDataFrame([(1, day(0), day(1)), (2, day(2), day(1)), (3, None, day(1))], "id long, a timestamp_ntz, b timestamp_ntz")
    codes = {"NO_START": F.col("a").isNull(), "NOT_AFTER": F.col("b") <= F.col("a")}
    assert {r.id: r.violations for r in audit.violations(df, codes).collect()} == {1: [], 2: ["NOT_AFTER"], 3: ["NO_START"]}
    life = spark.createDataFrame([(1, "closed", day(1), 0), (1, "reopened", day(2), 1), (1, "closed", day(9), 2)], "id long, kind string, t timestamp_ntz, n int")
    assert audit.state_at(life, "id", "kind", "t", "n", F.lit(day(5))).collect()[0].state == "reopened"
    assert [audit.graded(c, ["a"], ["b"]) for c in (["a", "b"], ["a"], ["b"])] == ["FULL", "CONDITIONAL", "INCOMPATIBLE"]


def test_invariants_and_joins_fail_closed(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "k long, v long")
    with pytest.raises(ValueError, match="not unique"):
        tables.join_validated(df, df, ["k"])
    with pytest.raises(ValueError, match="missing"):
        tables.assert_columns(df, ["z"])
    with pytest.raises(ValueError, match="invariants"):
        ledger.require(df, {"small": F.col("v") < 3})


def test_person_periods_stop_at_follow_up(spark):
    df = spark.createDataFrame([(1, 1.5, 0.4, 1.2), (2, 0.0, None, None)], "id long, follow_days double, edge double, merge double")
    got = [(r.bin, r.exposed, r.event) for r in survival.person_periods(df, "edge", "merge").orderBy("bin").collect()]
    assert got == [(0, False, False), (1, False, False), (2, True, False), (3, True, True)]


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    tables.write_table(df, str(tmp_path / "t.parquet"))
    tables.write_csv(df, str(tmp_path / "c"))
    tables.write_json(df, str(tmp_path / "j"))
    for back in (tables.read_table(spark, str(tmp_path), "t", ["k", "v"]), tables.read_csv(spark, str(tmp_path / "c"), "k long, v string"), tables.read_json(spark, str(tmp_path / "j"), "k long, v string")):
        assert audit.set_difference(df, back).count() == 0
    assert tables.file_digests(spark, str(tmp_path / "c")).count() >= 1
    assert [r.column_name for r in tables.dictionary(df, "t").collect()] == ["k", "v"]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i % 5, i, DAY0 + timedelta(minutes=7 * i), "error" if i % 3 else "view") for i in range(60)]
    df = spark.createDataFrame(rows, "pr_id long, event_id long, interaction_dt timestamp_ntz, source string")
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = S.event_stream(spark, str(tmp_path / "in"), df.schema, 2)
    error = F.col("source") == "error"
    S.run_available(S.first_triggers(stream, error), str(tmp_path / "first"), str(tmp_path / "cp1"), "complete")
    want = {(r[0], r[1]) for r in df.filter(error).groupBy("pr_id").agg(F.min("event_id")).collect()}
    assert {(r.pr_id, r.trigger_event_id) for r in S.latest(spark, str(tmp_path / "first")).collect()} == want
    S.run_available(S.windowed_counts(stream, "1 hour", "10 days", "source"), str(tmp_path / "hourly"), str(tmp_path / "cp2"), "complete")
    assert sum(r.n_events for r in S.latest(spark, str(tmp_path / "hourly")).collect()) == 60
    S.run_available(S.once_each(stream, "10 days", ["event_id"]), str(tmp_path / "once"), str(tmp_path / "cp3"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 60


def test_prior_history_against_brute_force(spark):
    import random

    from threadline.operators import history

    rng = random.Random(8)
    events = [(rng.choice("ab"), rng.choice(["x", "y", None]), rng.randrange(4), DAY0 + timedelta(hours=rng.randrange(30))) for _ in range(90)]
    targets = [(rng.choice("abc"), rng.choice(["x", "y", None]), rng.randrange(5), DAY0 + timedelta(hours=rng.randrange(32)), n) for n in range(60)] + [("a", "x", 1, DAY0 + timedelta(hours=9), 0)] * 2
    df = spark.createDataFrame(targets, "k string, l string, pr_id long, trigger_dt timestamp_ntz, n int")
    got = history.strict_prior_history(df, spark.createDataFrame(events, "k string, l string, pr_id long, interaction_dt timestamp_ntz"), ["k", "l"]).collect()
    want = []
    for k, l, i, t, n in targets:
        seen = [(j, s) for a, b, j, s in events if a == k and b == l and b is not None and j != i and s < t]
        last = max((s for _, s in seen), default=None)
        want.append((k, l, i, t, n, len(seen), len({j for j, _ in seen}), last, (t - last).total_seconds() / 3600 if last else None))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_places_over_ranges(spark):
    import random

    from threadline.operators import asof

    rng = random.Random(9)
    rows = [(rng.randrange(6), i) for i in range(137)]
    df = spark.createDataFrame(rows, "v int, i int")
    got = asof.ranked(df, [F.desc("v"), F.asc("i")], ranges=5).withColumn("tile", asof.ntile(F.col("place"), F.lit(137), 10)).collect()
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [(r.v, r.i) for r in sorted(got, key=lambda r: r.place)] == order and sorted(r.place for r in got) == list(range(1, 138))
    assert [sum(r.tile == t for r in got) for t in range(1, 11)] == [14] * 7 + [13] * 3


def test_all_thresholds_in_one_pass(spark):
    from threadline.operators import sequence

    def at(m):
        return DAY0 + timedelta(minutes=m)

    t = spark.createDataFrame([(1, 7, DAY0), (2, 7, DAY0)], "pr_id long, repo_id long, trigger_dt timestamp_ntz")
    r = spark.createDataFrame([(1, DAY0, at(5), "other_bot"), (1, DAY0, at(9), "other_bot"), (1, DAY0, at(9), "user_account")], "pr_id long, trigger_dt timestamp_ntz, interaction_dt timestamp_ntz, state string")
    got = {(x.pr_id, x.threshold_minutes): (x.first_state, x.minutes_from_trigger, x.n_events, x.n_states) for x in sequence.first_states(t, r, [0, 5, 9]).collect()}
    none = ("no_action_within_7d", None, 0, 0)
    assert got == {(1, 0): ("other_bot", 5.0, 1, 1), (1, 5): ("user_account", 9.0, 2, 2), (1, 9): none, (2, 0): none, (2, 5): none, (2, 9): none}
