"""Null models, densities and ranks against plain computations; readers and links on small cases."""

import hashlib
import io
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadline.operators import ledger, textmatch
from threadline.sources import tables
from threadline.stats import density, nulls, resample


def unit(draw, row):
    return int(hashlib.md5(f"{draw}:{row}".encode()).hexdigest()[:8], 16) / 2**32


def frame(spark, n=60):
    rng = np.random.default_rng(3)
    rows = [(i, f"s{i % 4}", float(rng.normal()), float(i % 3 == 0), float(rng.normal())) for i in range(n)]
    return rows, spark.createDataFrame(rows, "i int, s string, y double, x double, z double")


def fit(rows, exposed):
    a = np.array([[1.0, exposed[r[0]], r[4]] for r in rows])
    return np.linalg.lstsq(a, np.array([r[2] for r in rows]), rcond=None)[0][1]


def test_permuted_anchors_by_brute_force(spark):
    rows, df = frame(spark)
    able = {r[0]: r[3] == 1 or r[0] % 2 == 0 for r in rows if r[1] != "s1"}
    df = df.withColumn("able", (F.col("s") != "s1") & ((F.col("x") == 1) | (F.col("i") % 2 == 0)))
    got = {r.draw: r.estimate for r in nulls.permuted_anchors(df.withColumn("x", F.when(F.col("s") == "s1", 0.0).otherwise(F.col("x"))), "y", "x", F.col("able"), ["z"], "s", "i", 5).collect()}
    real = {r[0]: 0.0 if r[1] == "s1" else r[3] for r in rows}
    assert got[0] == pytest.approx(fit(rows, real))
    for draw in range(1, 6):
        exposed = dict(real)
        for s in ("s0", "s2", "s3"):
            inside = sorted((r[0] for r in rows if r[1] == s and able.get(r[0])), key=lambda i: (unit(draw, i), i))
            ones = int(sum(real[i] for i in inside))
            exposed |= {i: float(k < ones) for k, i in enumerate(inside)}
        assert got[draw] == pytest.approx(fit(rows, exposed))


def test_shifted_times_by_brute_force(spark):
    rows, df = frame(spark)
    got = {r.draw: r.estimate for r in nulls.shifted_times(df.withColumn("t", F.when(F.col("x") == 1, 5.0)), "y", "t", 48.0, ["z"], "i", 4).collect()}
    share = sum(r[3] for r in rows) / len(rows)
    assert got[0] == pytest.approx(fit(rows, {r[0]: r[3] for r in rows}))
    for draw in range(1, 5):
        assert got[draw] == pytest.approx(fit(rows, {r[0]: float(unit(draw, r[0]) < share) for r in rows}))


def test_nulls_of_nothing(spark):
    _, df = frame(spark)
    none = df.filter("i < 0")
    assert nulls.permuted_anchors(none, "y", "x", F.lit(True), ["z"], "s", "i", 3).count() == 0
    assert nulls.shifted_times(none, "y", "z", 1.0, [], "i", 3).count() == 0
    assert nulls.null_summary(nulls.sign_flips(none, "y", "i", 3)).first().observed is None


def test_an_item_with_one_state_keeps_its_order(spark):
    df = spark.createDataFrame([(1, k, "a") for k in range(4)] + [(2, 0, "b")], "item int, k int, state string")
    got = {(r.state, r.next_state): (r.observed, r.placebo_mean) for r in nulls.reordered_transitions(df, "item", "k", "state", 10).collect()}
    assert got == {("a", "a"): (0.75, pytest.approx(0.75)), ("a", "end"): (0.25, pytest.approx(0.25)), ("b", "end"): (1.0, pytest.approx(1.0))}


def test_antimode_lies_between_two_modes(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(-1, 0.3, 3000), rng.normal(2, 0.5, 3000)])
    df = spark.createDataFrame([(float(x), i % 20) for i, x in enumerate(v)], "v double, g int")
    b = density.binned(df, F.col("v"))
    cut = density.antimode(b, 1.78)
    assert b.counts.sum() == 6000 and -0.3 < cut < 1.0
    centres, h = b.centres, density.bandwidth(b)
    exact = np.exp(-0.5 * ((centres[:, None] - v) / h) ** 2).sum(1)
    low = density.turns(exact)[1]
    assert min(abs(centres[low] - cut)) < 0.1
    assert density.unimodality_test(b, 40, 2)[1] < 0.05
    draws = {r.draw: r.cut for r in density.cut_by_draws(df, "g", F.col("v"), 1.78, 10).collect()}
    assert len(draws) == 11 and all(-0.5 < c < 1.2 for c in draws.values())


def test_one_mode_has_no_cut(spark):
    v = np.random.default_rng(4).normal(0, 1, 4000)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    b = density.binned(df, F.col("v"))
    h = density.critical_bandwidth(b)
    assert density.modes(b, h * 1.01) == 1 and density.modes(b, h * 0.9) > 1
    assert density.unimodality_test(b, 40, 2)[1] > 0.05
    assert density.binned(df.filter("v > 100"), F.col("v")) is None
    assert density.binned(spark.createDataFrame([(1.0,), (1.0,)], "v double"), F.col("v")) is None


def test_turns_end_plateaus():
    high, low = density.turns(np.array([0, 1, 1, 0, 0, 2, 0.0]))
    assert list(high) == [2, 5] and list(low) == [4]


def test_average_precision_and_signed_rank(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0)], "s double, y int")
    r = textmatch.average_precision(df, "s", "y").first()
    assert r.average_precision == pytest.approx(0.5 * 1 + 0.5 * 2 / 4) and r.brier == pytest.approx((0.01 + 0.64 + 0.09 + 0.49 + 0.01) / 5)
    d = spark.createDataFrame([(x,) for x in (1.0, -1.0, 2.0, 3.0, 0.0)], "c double")
    r = textmatch.signed_rank(d, "c").first()
    assert (r.n, r.w_plus) == (4, 8.5) and r.z == pytest.approx((8.5 - 5) / np.sqrt(4 * 5 * 9 / 24 - 6 / 48))


def test_links_with_nulls_and_repeats(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 2), (4, 5), (6, None)], "a int, b int")
    links = spark.createDataFrame([(1, 9), (1, 9), (2, 9), (2, 8), (3, 7), (4, None), (None, 9)], "item int, issue int")
    got = {r.a: (r.left_linked, r.right_linked, r.shared_links, r.same_link) for r in ledger.link_continuity(pairs, links, "a", "b", "item", "issue").collect()}
    assert got == {1: (True, True, 1, True), 3: (True, True, 0, False), 4: (False, False, 0, False), 6: (False, False, 0, False)}


def test_generic_paths(spark):
    paths = {"README.md": True, "docs/license": True, "a/go.sum": True, "requirements.txt": True, "src/readme_parser.py": False, "main.go": False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.g for r in df.select("p", F.col("p").rlike(ledger.GENERIC_PATHS).alias("g")).collect()} == paths


def test_zipped_csv_and_rows_beside(spark, tmp_path):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a.csv", 'n,t\n1,"x, y"\n2,\n')
        z.writestr("skip.txt", "n,t\n7,no\n")
        z.writestr("b.csv", "t,n\né,3\n")
    (tmp_path / "in.zip").write_bytes(box.getvalue())
    got = tables.read_zipped_csv(spark, str(tmp_path), "n int, t string").orderBy("n").collect()
    assert [tuple(r) for r in got] == [(1, "x, y"), (2, None), (3, "é")]
    one = tables.beside(spark.range(1).select(F.lit(1).alias("a")), spark.range(1).select(F.lit("z").alias("b"))).collect()
    assert [tuple(r) for r in one] == [(1, "z")]


def test_draws_of_an_order_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    """Tasks were as many as the rows before the draws need, so that one sorted very many of them."""
    monkeypatch.setattr(nulls, "TASK_ROWS", 100)
    df = spark.createDataFrame([(i % 5, i, "user_account" if i % 7 == 0 else "other_bot") for i in range(60)], "item int, o int, state string").repartition(2, "item")
    for out in (nulls.reordered_transitions(df, "item", "o", "state", 20), nulls.walk_steps(df, 20)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(item#\d+, 13\)", plan) and not re.search(r"hashpartitioning\(item#\d+, draw#", plan)


@pytest.mark.parametrize("ones", [0, 1, 17, 39, 40])
def test_lowest_ranked_sorts_no_stratum_and_takes_the_same_rows(spark, ones):
    """Every stratum was sorted in every draw, in one task."""
    rows = spark.createDataFrame([(i % 2, i, ones, float(i * i)) for i in range(80)], "s int, i int, ones bigint, v double")
    rank = F.pmod(F.xxhash64("i", "draw"), F.lit(8))
    # The second ranking has many rows in each range.
    for place in (rank, F.floor(rank / 4)):
        got = {r.draw: r.v for r in nulls.lowest_ranked(rows, F.sequence(F.lit(1), F.lit(6)), rank, place, {"v": F.sum("v")}).collect()}
        want = {}
        for r in rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(6)))).withColumn("k", F.row_number().over(Window.partitionBy("s", "draw").orderBy(rank, "i"))).filter("k <= ones").collect():
            want[r.draw] = want.get(r.draw, 0.0) + r.v
        assert got == want


def test_permutation_test_counts_draws_that_tie(spark):
    """Every draw of this frame has the same sum but for rounding; by the order of its terms it did or did not count."""
    rows = [(i, i % 3, 1.0 if i < 30 else 0.0, 0.1) for i in range(90)]
    got = resample.permutation_test(spark.createDataFrame(rows, "i int, s int, x double, r double"), "s", F.col("x"), F.col("r"), 40, 1, "i").first()
    assert got.p == 1.0 and got.observed == pytest.approx(3.0) and got.null_mean == pytest.approx(3.0)
    empty = resample.permutation_test(spark.createDataFrame([], "i int, s int, x double, r double"), "s", F.col("x"), F.col("r"), 40, 1, "i").first()
    assert empty.observed == 0.0 and empty.null_mean is None and empty.p == 1.0
