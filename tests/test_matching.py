"""Matching by offers against taking turns one by one."""

import random
from datetime import datetime, timedelta

import pytest

from threadline.operators import matching

DAY0 = datetime(2024, 1, 1)


def by_turns_in_time(rows):
    """rows: (id, stratum, arm, hours)."""
    want = {}
    for s in {r[1] for r in rows}:
        free = [(t, i) for i, q, arm, t in rows if q == s and arm is False and t is not None]
        for t, i in sorted((t, i) for i, q, arm, t in rows if q == s and arm and t is not None):
            if free:
                above, below = [f for f in free if f[0] >= t], [f for f in free if f[0] < t]
                pick = min(([min(above)] if above else []) + ([max(below)] if below else []), key=lambda f: abs(f[0] - t))
                free.remove(pick)
                want[i] = pick[1]
    return want


def matched(spark, rows, block):
    df = spark.createDataFrame([(i, s, a, None if t is None else DAY0 + timedelta(hours=t)) for i, s, a, t in rows], "id long, s string, arm boolean, t timestamp_ntz")
    got = matching.nearest_without_replacement(df.repartition(3), ["s"], "arm", "t", "id", block).collect()
    assert len({r.exposed_id for r in got}) == len({r.control_id for r in got}) == len(got)
    hours = {i: t for i, _, _, t in rows}
    assert all(abs(r.gap_hours - abs(hours[r.exposed_id] - hours[r.control_id])) < 1e-9 for r in got)
    return {r.exposed_id: r.control_id for r in got}


@pytest.mark.parametrize(("seed", "span", "share", "block"), [(1, 400, 0.4, 3), (2, 30, 0.5, 2), (3, 5, 0.7, 4), (4, 2000, 0.3, 1), (5, 50, 0.5, 50_000)])
def test_blocks_in_rounds_as_one_by_one(spark, seed, span, share, block):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["x", "x", "y", None]), rng.random() < share, rng.randrange(span)) for i in range(120)]
    rows += [(500, "x", None, 3), (501, "x", True, None), (502, "z", True, 1), (503, "w", False, 1)]
    assert matched(spark, rows, block) == by_turns_in_time(rows)


def test_a_crowd_walks_over_many_blocks(spark):
    rows = [(i, "x", True, 0) for i in range(25)] + [(100 + i, "x", False, i - 5) for i in range(30)]
    assert matched(spark, rows, 4) == by_turns_in_time(rows)


def test_local_settling_of_many(spark):
    """All of a stratum in one call: no step is repeated for controls that are out of reach."""
    rows = [(i, "x", True, 0) for i in range(3000)] + [(10_000 + i, "x", False, i) for i in range(3000)]
    assert matched(spark, rows, 50_000) == {i: 10_000 + i for i in range(3000)}


def test_empty_and_one_sided(spark):
    assert matched(spark, [], 3) == {}
    assert matched(spark, [(1, "x", True, 1)], 3) == {} == matched(spark, [(1, "x", False, 1)], 3)


def caliper_rows(seed, n):
    rng = random.Random(seed)
    return [(i, rng.choice("pq"), round(rng.gauss(0, 1), 1), round(rng.gauss(0, 1), 1), round(rng.gauss(0, 1), 1), rng.random()) for i in range(n)]


@pytest.mark.parametrize("few", [0, 10, 100_000])
def test_caliper_without_replacement_as_one_by_one(spark, monkeypatch, few):
    monkeypatch.setattr(matching, "FEW", few)
    rows = caliper_rows(3, 90)
    # controls 0 to 39 are in both cells: each serves once
    controls = [(i, c, *x) for i, _, *x in rows if i < 40 for c in "pq"]
    exposed = [r for r in rows if r[0] >= 40]
    schema = "id long, cell string, a double, b double, c double, o double"
    got = matching.match_in_caliper(spark.createDataFrame(exposed, schema), spark.createDataFrame(controls, schema), ["cell"], ["a", "b", "c"], "id", 1.2, ["o"]).collect()
    want, used = set(), set()
    for i, cell, a, b, c, _ in sorted(exposed, key=lambda r: (r[1], r[5], r[0])):
        near = sorted((((a - x) ** 2 + (b - y) ** 2 + (c - z) ** 2) ** 0.5, j) for j, q, x, y, z, _ in controls if q == cell and j not in used)
        if near and near[0][0] <= 1.2:
            used.add(near[0][1])
            want.add((cell, i, near[0][1], round(near[0][0], 9)))
    assert {(r.cell, r.exposed_id, r.control_id, round(r.distance, 9)) for r in got} == want and len(want) > 20


def test_pairs_in_caliper_are_all(spark):
    rows = caliper_rows(4, 60)
    df = spark.createDataFrame(rows, "id long, cell string, a double, b double, c double, o double")
    got = {(r.exposed_id, r.control_id) for r in matching.pairs_in_caliper(df, df, ["cell"], ["a", "b", "c"], "id", 0.7).collect()}
    assert got == {(x[0], y[0]) for x in rows for y in rows if x[0] != y[0] and x[1] == y[1] and sum((x[k] - y[k]) ** 2 for k in (2, 3, 4)) ** 0.5 <= 0.7}


def test_reachability_and_safety_of_pairs(spark):
    rows = [("in", "in", False, False, 1, 0, 0, 2), ("in", "out", False, True, 1, 3, 1, 1), ("in", "in", False, False, 0, 1, 0, 0), ("out", "in", True, False, 2, 0, 1, 0)]
    df = spark.createDataFrame(rows, "pa string, pb string, a_blind boolean, b_blind boolean, a_x long, a_y long, b_x long, b_y long")
    grid = {(r.pa, r.pb): (r.pairs, r.share, r.both_can_ever_fire) for r in matching.reachability(df, "pa", "pb", "in").collect()}
    assert grid == {("in", "in"): (2, 0.5, True), ("in", "out"): (1, 0.25, False), ("out", "in"): (1, 0.25, False)}
    got = {r.outcome: tuple(r)[1:] for r in matching.outcome_safety(df, {"x": "x", "y": "y"}, "blind", "x", ["y"]).collect()}
    assert got == {"x": (1, 1, 2, 1), "y": (0, 1, 2, 1)}


def test_effects_of_switching_and_candidates(spark):
    from threadline.operators import ledger

    rows = [("p", False, True, None)] * 3 + [("p", False, False, None), ("p", True, True, None), ("p", True, False, None), ("p", True, False, DAY0), ("q", True, True, None)]
    t = spark.createDataFrame(rows, "agent string, switched boolean, merged_in_time boolean, prior_merged_dt timestamp_ntz")
    (r,) = ledger.switch_effects(t, "agent").collect()
    error = (0.75 * 0.25 / 4 + 0.5 * 0.5 / 2) ** 0.5
    assert (r.agent, r.stay_n, r.switch_n, r.stay_rate, r.switch_rate, r.effect_pp) == ("p", 4, 2, 0.75, 0.5, -25.0)
    assert abs(r.low_pp - (-25 - 196 * error)) < 1e-9 and abs(r.high_pp - (-25 + 196 * error)) < 1e-9
    stars = spark.createDataFrame([(None,), (0,), (1,), (9,), (10,), (99,), (100,)], "s long").select(ledger.star_bin("s")).collect()
    assert [x[0] for x in stars] == ["Missing", "0", "1–9", "1–9", "10–99", "10–99", "100+"]
    v = spark.createDataFrame([(0.1, 300, 0.4), (0.2, 250, 0.5), (0.3, 220, 0.9), (0.4, 10, 1.0)], "threshold double, selected_n long, precision double")
    chosen = ledger.chosen_threshold(v, 200, 0.45, 0.7)
    assert chosen.first()[0] == 0.2 and ledger.chosen_threshold(v, 400, 0.45, 0.7).first()[0] == 0.7
    pairs = spark.createDataFrame([(1, 0.2, False, None), (2, 0.1, True, False), (3, None, None, True), (4, 0.19, False, False)], "i int, similarity double, same_issue boolean, same_title boolean")
    assert {r.i: r.continuation_candidate for r in ledger.continuation_candidates(pairs, chosen).collect()} == {1: True, 2: True, 3: True, 4: False}
