"""Pairs at one place, packets, rarity and order placebos by hand."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from threadline.operators import collisions
from threadline.plans.collisions import QUERIES
from threadline.stats import nulls

T0 = datetime(2024, 5, 1)
SHA = "ab" * 20


def comments(spark):
    def at(m):
        return T0 + timedelta(minutes=m)

    rows = [
        (1, 50, None, "A", "a", at(5), SHA, "x.py", 3, "first https://a.b", "h1"), (2, 50, None, "A", "a", at(6), SHA, "x.py", 3, "again", "h"), (3, 51, None, "B", "b", at(6), SHA, "x.py", 3, "m@x.org", "h2"),
        (4, 50, None, "C", "c", at(9), SHA, "x.py", 3, None, None), (5, 50, 1, "B", "b", at(1), SHA, "x.py", 3, "reply", "h"), (6, 50, None, "B", "b", at(1), "zz", "x.py", 3, "bad commit", "h"),
        (7, 50, None, "B", "b", at(1), SHA, " ", 3, "no path", "h"), (8, 50, None, "B", "b", at(1), SHA, "x.py", 0, "no line", "h"), (9, 50, None, "B", "b", at(-1), SHA, "x.py", 3, "too early", "h"),
        (10, 60, None, "B", "b", at(2), SHA, "x.py", 3, "two items", "h"), (11, 50, None, None, "d", at(2), SHA, "x.py", 3, "unmapped", "h"), (12, 50, None, "A", "a", at(7), SHA, "y", 1, "alone", "h"),
        (13, 50, None, "A", "a", None, SHA, "x.py", 3, "no time", "h"), (14, 70, None, "A", "a", at(7), SHA, "x.py", 3, "item of one product", "h"),
    ]
    c = spark.createDataFrame(rows, "event_id long, review_id long, parent_id long, product string, actor_login string, comment_dt timestamp_ntz, commit_id string, path string, position int, body string, diff_hunk string")
    reviews = spark.createDataFrame([(50, 1), (50, 1), (51, 1), (60, 1), (60, 2), (70, 2)], "review_id long, pr_id long")
    items = spark.createDataFrame([(1, 7, T0, at(8)), (2, 7, T0, None)], "pr_id long, repo_id long, created_dt timestamp_ntz, closed_dt timestamp_ntz")
    return collisions.marked(c, reviews, items)


def test_waterfall_and_pairs(spark):
    m = comments(spark)
    counts = {r.stage: r.n for r in collisions.waterfall(m, F.lit(T0 + timedelta(minutes=6))).collect()}
    assert counts == {"source": 14, "top_level": 13, "known_item": 12, "mapped": 11, "timed": 10, "valid_place": 7, "after_creation": 6, "within_cutoff": 3, "before_close": 5, "items_of_several": 1, "places": 1, "comments_at_places": 4}
    (r,) = collisions.collision_pairs(collisions.strict_comments(m)).collect()
    assert (r.first_event_id, r.second_event_id, r.product_pair, r.gap_seconds, r.n_products, r.n_comments) == (1, 3, "A + B", 60, 3, 4)
    assert not r.first_after_close and not r.second_after_close and r.record_id.startswith("RC-") and len(r.record_id) == 15


def test_packets_hide_who_and_swap_sides(spark):
    pairs = collisions.collision_pairs(collisions.strict_comments(comments(spark)))
    many = pairs.crossJoin(spark.range(40)).withColumn("record_id", F.concat("record_id", F.col("id")))
    packet, key = collisions.packets(many.drop("id"))
    p, k = {r.record_id: r for r in packet.collect()}, {r.record_id: r for r in key.collect()}
    assert p.keys() == k.keys() and {r.swapped for r in k.values()} == {True, False}
    for i, r in p.items():
        assert (r.body_a, r.body_b) == (("[EMAIL]", "first [URL]") if k[i].swapped else ("first [URL]", "[EMAIL]"))
        assert (r.diff_hunk_a == "h2") == k[i].swapped and r.suffix == ".py"
    assert not {"product_pair", "first_product", "pr_id", "path", "first_dt", "swapped"} & set(packet.columns) and not {"first_body", "second_diff_hunk"} & set(key.columns)
    assert sorted(p, key=lambda i: p[i].order_1) != sorted(p, key=lambda i: p[i].order_2)
    long = pairs.withColumn("first_body", F.lit("x" * 2501)).withColumn("second_diff_hunk", F.lit("ghp_" + "a" * 30))
    assert {r.field: (r.records, r.marked, r.cut) for r in collisions.packet_counts(long).collect()} == {"body": (1, 0, 1), "diff_hunk": (1, 1, 0), "any": (1, 1, 1)}


def test_pairs_without_texts(spark):
    """Texts were part of every row that was sorted on the way to the pairs, also for queries that show none."""
    strict = collisions.strict_comments(comments(spark))
    wide, narrow = (collisions.collision_pairs(x) for x in (strict, strict.drop("body", "diff_hunk")))
    kept = [c for c in wide.columns if not c.endswith(("_body", "_diff_hunk"))]
    assert narrow.columns == kept and narrow.collect() == wide.select(*kept).collect()
    for name in ("collision_pairs", "packet_keys", "blinded_packets", "packet_counts"):
        plan = QUERIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert all("diff_hunk" not in line for line in plan.splitlines() if " Sort [" in line or "Exchange " in line)


def test_rarity_against_frozen_shares(spark):
    rows = [("g", k, 1, "-") for k in "aab"] + [("g", "a", 2, "new"), ("g", "b", 2, "new"), ("g", "c", 2, "old"), ("g", None, 2, "old"), ("h", "a", 2, "new")]
    out = collisions.mean_rarity(spark.createDataFrame(rows, "g string, k string, t int, r string"), "g", "k", F.col("t") < 2, "r").collect()
    assert {(r.g, r.r): (r.n, round(r.rarity, 9)) for r in out} == {("g", "new"): (2, 0.5), ("g", "old"): (1, 1.0)}


def walked(states, most=5):
    found, step = [], 0
    for i, s in enumerate(states):
        if s == "user_account" or step == most:
            break
        if s in ("mapped_product", "other_bot"):
            step += 1
            after = states[i + 1] if i + 1 < len(states) else None
            found.append((step, "no_later_episode" if after is None else after if after in ("user_account", "branch_movement_untyped") else "another_automation"))
    return found


def test_walks_until_the_first_person(spark):
    import random
    from collections import Counter

    rng = random.Random(2)
    items = {i: [rng.choice(["user_account", "mapped_product", "other_bot", "branch_movement_untyped"]) for _ in range(rng.randrange(1, 12))] for i in range(60)}
    df = spark.createDataFrame([(i, o, s) for i, ss in items.items() for o, s in enumerate(ss)], "item long, o long, state string")
    steps = nulls.walk_steps(df, 3, 4).collect()
    assert {(r.step, r.outcome): r.n for r in steps if r.draw == 0} == Counter(x for ss in items.values() for x in walked(ss, 4))
    assert all(sum(r.n for r in steps if r.draw == d and r.step == 1) > 0 for d in (1, 2, 3))
    # an item of one state comes in one order only
    alone = nulls.walk_order_placebo(spark.createDataFrame([(1, 1, "other_bot"), (2, 1, "mapped_product")], "i long, o long, s string"), "i", "o", "s", 5).collect()
    assert {(r.outcome, r.at_risk, r.observed, r.placebo_mean, r.low, r.difference) for r in alone} == {("no_later_episode", 2, 1.0, 1.0, 1.0, 0.0), *((o, 2, 0.0, 0.0, 0.0, 0.0) for o in nulls.ESCALATIONS[:3])}


def test_next_product_against_any_order(spark):
    def at(m):
        return T0 + timedelta(minutes=m)

    events = [(1, at(5), "A"), (1, at(10), "B"), (1, at(20), "A"), (1, at(30), None), (2, at(5), "A"), (2, at(5), "B"), (3, at(0), "A")]
    anchors = spark.createDataFrame([(1, at(0), "A"), (2, at(0), "A"), (3, at(0), "A")], "pr_id long, anchor_dt timestamp_ntz, anchor_product string")
    got = nulls.product_order(spark.createDataFrame(events, "pr_id long, interaction_dt timestamp_ntz, actor_agent string"), anchors, (0, 5)).collect()
    assert {(r.pr_id, r.washout_minutes): (r.eligible, r.observed, round(r.expected, 9)) for r in got} == {(1, 0): (3, 1.0, 0.666666667), (1, 5): (2, 0.0, 0.5)}
