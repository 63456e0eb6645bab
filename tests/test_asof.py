"""As-of joins by ranges of time give what one window by key gives."""

import random
from datetime import datetime, timedelta

import pytest

from threadline.operators import asof

DAY0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [True, False])
def test_ranges_do_not_change_what_is_found(spark, direction, strict):
    rng = random.Random(4)
    left = [(i, rng.choice(["a", "a", "a", "b", None]), None if i % 17 == 0 else DAY0 + timedelta(hours=rng.randrange(60))) for i in range(120)]
    right = [(i, rng.choice(["a", "a", "c", "b", None]), None if i % 13 == 0 else DAY0 + timedelta(hours=rng.randrange(60))) for i in range(90)]
    a = spark.createDataFrame(left, "i int, k string, t timestamp_ntz")
    b = spark.createDataFrame(right, "e int, k string, u timestamp_ntz")
    found = [{(r.i, r.prior_e, r.prior_u) for r in asof.asof_join(a, b, "t", "u", ["k"], ["e", "u"], direction, strict, tie=["e"], ranges=n).collect()} for n in (0, 1, 2, 7, 40)]
    assert len(found[0]) == 120 and all(f == found[0] for f in found[1:])

    def best(k, t):
        near = [(u, e) for e, q, u in right if q == k and u is not None and t is not None and ((u < t if strict else u <= t) if direction == "backward" else (u > t if strict else u >= t))]
        return (max if direction == "backward" else min)(near, default=(None, None))

    assert {(i, *best(k, t)[::-1]) for i, k, t in left if k is not None} == {f for f in found[0] if left[f[0]][1] is not None}


def test_numbers_as_times(spark):
    a = spark.createDataFrame([(1, "a", 5.0), (2, "a", 50.0), (3, "b", 1.0)], "i int, k string, t double")
    b = spark.createDataFrame([(10, "a", 4.0), (11, "a", 5.0), (12, "a", 20.0)], "e int, k string, u double")
    got = {r.i: r.prior_e for r in asof.asof_join(a, b, "t", "u", ["k"], ["e"], ranges=3).collect()}
    assert got == {1: 10, 2: 12, 3: None}


@pytest.mark.parametrize("ranges", [0, 4])
@pytest.mark.parametrize("strict", [True, False])
def test_forward_takes_the_next_event_without_reading_all_later_ones_for_each_row(spark, strict, ranges):
    """A frame up to the last row is read anew for every row, so a busy key took time with the square of its rows."""
    left = [(i, i % 2, i * 7 % 41) for i in range(60)]
    right = [(100 + i, i % 2, i * 5 % 37) for i in range(50)]
    found = asof.asof_join(spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "e int, k int, at int"), "t", "at", ["k"], ["e", "at"], direction="forward", strict=strict, prefix="next_", tie=["e"], ranges=ranges)
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    want = {}
    for i, k, t in left:
        later = [(at, e) for e, kk, at in right if kk == k and (at > t if strict else at >= t)]
        want[i] = min(later)[::-1] if later else (None, None)
    assert {r.id: (r.next_e, r.next_at) for r in found.collect()} == want
