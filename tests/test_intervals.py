"""Curves in several states, and intervals by draws, against plain loops."""

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from threadline.operators import survival
from threadline.stats import intervals
from threadline.stats.resample import TIMES, drawn_times

GRID = [0.0, 0.5, 1.0, 2.0, 5.0, 10.0]
STATES = {"none": (0,), "some": (1, 2), "best": (2,)}


def curves(rows):
    """rows: follow, merged, off, on; the contract told cell by cell."""
    inf = math.inf
    inside = {"none": lambda t, off, on: on > t and off > t, "some": lambda t, off, on: on <= t or off <= t, "best": lambda t, off, on: on <= t}
    out = {}
    for name, ok in inside.items():
        left, before = 1.0, 0.0
        for i, stop in enumerate(GRID):
            risk = [r for r in rows if r[0] > before and ok(before, inf if r[2] is None else r[2], inf if r[3] is None else r[3])]
            events = sum(r[1] and r[0] <= stop for r in risk)
            left *= 1 - (events / len(risk) if risk else 0)
            out[name, i] = (len(risk), events, round(1 - left, 9))
            before = stop
    return out


def cohort(seed, n):
    rng = np.random.default_rng(seed)
    pick = [0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 4.0, 5.0, 9.0, 10.0]
    return [(int(rng.integers(6)), float(rng.choice(pick)), bool(rng.random() < 0.5), *(None if rng.random() < 0.5 else float(rng.choice(pick)) for _ in range(2))) for _ in range(n)]


def changes_of(spark, rows):
    df = spark.createDataFrame(rows, "repo_id long, follow_days double, merged boolean, off double, on double")
    return survival.risk_changes(df, ["off", "on"], GRID)


def test_states_cell_by_cell(spark):
    rows = cohort(1, 150)
    got = survival.incidence_states(changes_of(spark, rows), STATES, GRID).collect()
    assert {(r.state, r.cell): (r.at_risk, r.events, round(r.incidence, 9)) for r in got} == curves([r[1:] for r in rows])
    assert [r.days for r in sorted(got, key=lambda r: r.cell) if r.state == "none"] == GRID


def test_bands_are_quantiles_of_redrawn_clusters(spark):
    rows, draws = cohort(2, 80), 12
    changes = changes_of(spark, rows)
    pairs = spark.range(draws).crossJoin(spark.range(6).withColumnRenamed("id", "c")).select("id", "c", drawn_times(F.col("id"), F.col("c")).alias("t")).collect()
    times = {(r.id, r.c): r.t for r in pairs}
    each = [curves([r[1:] for r in rows for _ in range(times[d, r[0]])]) for d in range(draws)]
    bands = {(r.state, r.cell): r for r in survival.incidence_bands(changes, STATES, GRID, draws).collect()}
    for k in each[0]:
        low, high = np.quantile([e[k][2] for e in each], [0.025, 0.975])
        assert abs(bands[k].low - low) < 1e-8 and abs(bands[k].high - high) < 1e-8


def test_no_rows_and_overlap(spark):
    empty = survival.incidence_states(changes_of(spark, cohort(1, 0)), STATES, GRID).collect()
    assert len(empty) == 18 and all(r.at_risk == r.events == r.incidence == 0 for r in empty)
    rows = [(s, i, float(i), x, x - 0.1, x + 0.1) for s, xs in (("a", (0.0, 0.4, 0.5)), ("b", (0.0, 0.1, 0.45)), ("c", (0.1, 0.1, 0.1))) for i, x in enumerate(xs)]
    r = survival.band_overlap(spark.createDataFrame(rows, "state string, cell int, days double, incidence double, low double, high double"), "a", "b", "c").first()
    assert (r.cells, r.cells_above, r.cells_below, r.overlapping, r.first_parted_days, r.base_leads_until_days, r.max_abs_gap_days) == (3, 2, 0, 2, 1.0, 1.0, 1.0)
    assert abs(r.end_gap + 5) < 1e-9 and abs(r.max_abs_gap - 30) < 1e-9 and r.base_below_a and r.base_below_b


def test_follow_up_of_merges_closes_and_cutoff(spark):
    from datetime import datetime as dt

    t0 = dt(2024, 1, 1)
    rows = [(1, t0, None, dt(2024, 1, 3)), (2, t0, dt(2024, 1, 5), None), (3, t0, None, None), (4, dt(2024, 2, 1), None, None), (5, t0, dt(2023, 12, 1), None), (6, t0, dt(2024, 3, 1), dt(2024, 3, 1))]
    df = spark.createDataFrame(rows, "id int, trigger_dt timestamp_ntz, closed_dt timestamp_ntz, merged_dt timestamp_ntz")
    got = {r.id: (r.merged, r.follow_days) for r in survival.merge_follow_up(df, F.lit("2024-02-10 00:00:00").cast("timestamp_ntz")).collect()}
    assert got == {1: (True, 2.0), 2: (False, 4.0), 3: (False, 30.0), 4: (False, 9.0), 5: (False, 0.0), 6: (False, 30.0)}


def test_poisson_times():
    assert abs(TIMES[0] - math.exp(-1)) < 1e-12 and TIMES[-1] < 1


def bca_by_hand(rows, draws, times, level=0.95):
    """rows: (unit, num, den)."""
    num, den = sum(r[1] for r in rows), sum(r[2] for r in rows)
    estimate = num / den
    drawn = sorted(sum(times[d, u] * a for u, a, _ in rows) / w for d in range(draws) if (w := sum(times[d, u] * b for u, _, b in rows)))
    below = sum(x < estimate for x in drawn) / len(drawn) + sum(x == estimate for x in drawn) / 2 / len(drawn)
    out = [(num - a) / (den - b) for _, a, b in rows]
    gaps = [sum(out) / len(out) - x for x in out]
    a = sum(g**3 for g in gaps) / (6 * sum(g**2 for g in gaps) ** 1.5)
    law = NormalDist()
    z0 = law.inv_cdf(below)
    ends = [law.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (law.inv_cdf((1 - level) / 2), -law.inv_cdf((1 - level) / 2))]
    return estimate, a, *np.quantile(drawn, ends)


def test_bca_by_hand(spark):
    rng = np.random.default_rng(3)
    rows = [(u, float(rng.exponential()), float(rng.integers(1, 5))) for u in range(25)]
    df = spark.createDataFrame([("k", *r) for r in rows] + [("one", 1, 2.0, 4.0)], "k string, unit long, num double, den double")
    draws = 300
    pairs = spark.range(draws).crossJoin(spark.range(25).withColumnRenamed("id", "c")).select("id", "c", drawn_times(F.col("id"), F.col("c")).alias("t")).collect()
    got = {r.k: r for r in intervals.bca(df, ["k"], draws).collect()}
    want = bca_by_hand(rows, draws, {(r.id, r.c): r.t for r in pairs})
    assert np.allclose((got["k"].estimate, got["k"].acceleration, got["k"].low, got["k"].high), want, atol=1e-9)
    assert (got["one"].n, got["one"].estimate, got["one"].low, got["one"].high) == (1, 0.5, None, None)
    whole = intervals.bca(df.filter("k = 'k'").drop("k"), [], draws).first()
    assert np.allclose((whole.low, whole.high), want[2:], atol=1e-9)


def test_medians_by_hand(spark):
    rng = np.random.default_rng(4)
    rows = [(i, bool(i % 3), float(rng.integers(0, 9))) for i in range(40)] + [(100, None, 1.0), (101, True, None)]
    draws = 40
    pairs = spark.range(draws).crossJoin(spark.range(40).withColumnRenamed("id", "c")).select("id", "c", drawn_times(F.col("id"), F.col("c")).alias("t")).collect()
    times = {(r.id, r.c): r.t for r in pairs}
    r = intervals.median_difference(spark.createDataFrame(rows, "u long, a boolean, v double"), [], "a", "v", "u", draws).first()
    d = [np.median([v for u, a, v in rows[:40] if a for _ in range(times[k, u])]) - np.median([v for u, a, v in rows[:40] if not a for _ in range(times[k, u])]) for k in range(draws)]
    assert (r.n_true, r.n_false) == (26, 14)
    assert r.difference == np.median([v for _, a, v in rows[:40] if a]) - np.median([v for _, a, v in rows[:40] if not a])
    assert np.allclose((r.low, r.high), np.quantile(d, [0.025, 0.975]))


def test_medians_deal_units_before_they_are_drawn(spark):
    """All draws of all units were made in as few tasks as the units' bytes need."""
    rows = spark.createDataFrame([("m", i % 2 == 0, float(i), i) for i in range(20)], "k string, arm boolean, v double, u int")
    out = intervals.median_difference(rows, ["k"], "arm", "v", "u", 30)
    n = spark.conf.get("spark.sql.shuffle.partitions")
    assert f", {n})" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "REPARTITION_BY_NUM" in plan
    (r,) = out.collect()
    assert (r.n_true, r.n_false, r.median_true, r.median_false, r.difference) == (10, 10, 9.0, 10.0, -1.0)
