"""Designs, complete cases and absorbed effects against matrices built in full."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadline.stats import design, ols


def rows(seed=1, n=240):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a, b, x = rng.choice(["p", "q", "r"]), int(rng.integers(0, 4)), float(rng.normal())
        y = 1 + 2 * x + {"p": 0, "q": 1, "r": -1}[a] + 0.5 * b + (x if a == "q" else 0) + float(rng.normal())
        out.append((y, a, b, x, int(rng.integers(0, 15)), float(rng.integers(1, 4))))
    return out


SCHEMA = "y double, a string, b int, x double, g int, w double"


def robust(m, y, g, w=None):
    w = np.ones(len(y)) if w is None else w
    inverse = np.linalg.pinv(m.T @ (m * w[:, None]))
    beta = inverse @ m.T @ (w * y)
    e = w * (y - m @ beta)
    meat = sum(np.outer(s, s) for k in set(g) for s in [m[g == k].T @ e[g == k]])
    n, p, q = len(y), m.shape[1], len(set(g))
    return beta, q / (q - 1) * (n - 1) / (n - p) * inverse @ meat @ inverse


@pytest.mark.parametrize("weight", [None, "w"])
def test_design_by_full_matrix(spark, weight):
    data = rows()
    broken = [(None, "p", 1, 0.5, 1, 1.0), (1.0, None, 1, 0.5, 1, 1.0), (1.0, "p", None, 0.5, 1, 1.0), (1.0, "p", 1, None, 1, 1.0), (1.0, "p", 1, 0.5, None, 1.0), (1.0, "z", 1, float("nan"), 2, 1.0)]
    df = spark.createDataFrame(data + broken, SCHEMA)
    terms = ["x", "C(a)", "C(b)", "C(a):C(b)", "C(a):x"]
    plan = design.design(df, terms, {"a": "q"})
    fit = design.fit(df, "y", plan, "g", weight)
    y, g = np.array([r[0] for r in data]), np.array([r[4] for r in data])
    a, b, x = [r[1] for r in data], [r[2] for r in data], np.array([r[3] for r in data])
    is_a, is_b = {k: np.array([v == k for v in a], float) for k in "pr"}, {k: np.array([v == k for v in b], float) for k in (1, 2, 3)}
    m = np.stack([np.ones(len(y)), x, *is_a.values(), *is_b.values(), *(p * q for p in is_a.values() for q in is_b.values()), *(p * x for p in is_a.values())], axis=1)
    beta, cov = robust(m, y, g, np.array([r[5] for r in data]) if weight else None)
    assert plan.names == ["const", "x", "a=p", "a=r", "b=1", "b=2", "b=3", *(f"a={p}:b={q}" for p in "pr" for q in (1, 2, 3)), "a=p:x", "a=r:x"]
    assert np.allclose(fit.beta, beta) and np.allclose(fit.cov, cov) and (fit.n, fit.clusters, fit.rank) == (len(y), 15, m.shape[1])
    r = np.eye(m.shape[1])[[13, 14]]
    want = (r @ beta) @ np.linalg.inv(r @ cov @ r.T) @ (r @ beta)
    value, df_, p = fit.wald(plan.joint("C(a):x"))
    assert math.isclose(value, want, rel_tol=1e-8) and df_ == 2 and math.isclose(p, math.exp(-want / 2), rel_tol=1e-8)


def test_designs_that_are_refused_or_short_of_rank(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    with pytest.raises(ValueError, match="parts"):
        design.design(df, ["C(a)", "C(a):x"])
    with pytest.raises(ValueError, match="levels"):
        design.design(df, ["C(g)"], most=3)
    twice = df.withColumn("x2", 2 * F.col("x"))
    fit = design.fit(twice, "y", design.design(twice, ["x", "x2"]), "g")
    one = ols.ols(df, "y", {"x": F.col("x")}, "g")
    assert fit.rank == 2 and math.isclose(fit.beta[1] + 2 * fit.beta[2], one.beta[1], rel_tol=1e-8)


def test_tail_of_chi_square():
    assert [round(ols.chi_square_tail(v, k), 4) for v, k in ((3.841, 1), (5.991, 2), (7.815, 3), (9.488, 4), (11.07, 5), (0, 3), (18.307, 10), (19.675, 11))] == [0.05, 0.05, 0.05, 0.05, 0.05, 1.0, 0.05, 0.05]
    assert math.isnan(ols.chi_square_tail(1.0, 0))


def test_complete_cases_in_all_fits(spark):
    data = rows(2)
    holes = [(y, a, b, None if i % 5 == 0 else x, g if i % 7 else None, w) for i, (y, a, b, x, g, w) in enumerate(data)]
    df, full = spark.createDataFrame(holes, SCHEMA), spark.createDataFrame([r for r in holes if r[3] is not None and r[4] is not None], SCHEMA)
    for run in (lambda d: ols.ols(d, "y", {"x": F.col("x")}, "g", "w"), lambda d: ols.logit(d.withColumn("y", (F.col("y") > 1).cast("double")), "y", {"x": F.col("x")}, "g"), lambda d: ols.ols(ols.demean(d, ["y", "x"], "g"), "y", {"x": F.col("x")}, "g", intercept=False)):
        one, two = run(df), run(full)
        assert one.n == two.n and np.allclose(one.beta, two.beta) and np.allclose(one.cov, two.cov)
    a, b = ({r.g: r.x for r in ols.leave_one_out(d, "y", {"x": F.col("x")}, "g").collect()} for d in (df, full))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k]) for k in a)


def test_selections_in_one_pass_as_fits_of_their_own(spark):
    df = spark.createDataFrame([*rows(4), (1.0, "p", 1, None, 1, 1.0), (1.0, None, 1, 0.5, None, 1.0)], SCHEMA)
    x = {"x": F.col("x"), "b": F.col("b")}
    keep = {"all": F.lit(True), "p": F.col("a") == "p", "few": F.col("g") < 4, "none": F.lit(False)}
    found = ols.reestimates(df, "y", x, "g", keep)
    assert list(found) == ["all", "p", "few"]
    for name, fit in found.items():
        own = ols.ols(df.filter(keep[name]), "y", x, "g")
        assert (fit.n, fit.clusters) == (own.n, own.clusters) and np.allclose(fit.beta, own.beta) and np.allclose(fit.cov, own.cov)
    assert ols.reestimates(df.limit(0), "y", x, "g", keep) == {}


def test_moderation_as_refits(spark):
    df = spark.createDataFrame(rows(6), SCHEMA)
    a, b, others = F.col("a") == "p", F.col("a") == "q", {"x": F.col("x")}
    got = {(r["check"], r.detail): r for r in ols.moderation(df, "y", a, b, others, "g", ["b", "g"]).collect()}
    names = {"a": a.cast("double"), "b": b.cast("double"), "x": F.col("x")}
    estimate, error = ols.ols(df, "y", names, "g").contrast({"a": 1.0, "b": -1.0})
    r = got["primary", "g"]
    assert math.isclose(r.estimate, estimate) and math.isclose(r.low, estimate - 1.959963984540054 * error) and r.n == 240
    refits = [ols.ols(df.filter(F.col("b") != k), "y", names, "g").contrast({"a": 1.0, "b": -1.0})[0] for k in range(4)]
    r = got["leave_one_out", "b"]
    assert np.allclose((r.estimate, r.low, r.high), (np.median(refits), min(refits), max(refits)))
    within = ols.ols(ols.demean(df.withColumns(names), ["y", "x"], "g"), "y", {"x": F.col("x")}, "g", intercept=False)
    assert within.n == 240 and {k for k, _ in got} == {"primary", "fixed_effects", "leave_one_out"}


@pytest.mark.parametrize("few", [200_000, 0])
def test_two_effects_absorbed_as_by_dummies(spark, few):
    data = rows(3, 90)
    df = spark.createDataFrame([*data, (1.0, None, 1, 0.5, 1, 1.0), (1.0, "p", 1, None, 1, 1.0)], SCHEMA)
    flat = ols.absorb(df, ["y", "x"], ["a", "b"], 1e-8 if few == 0 else 1e-10, few=few)
    got = ols.ols(flat, "y", {"x": F.col("x")}, "g", intercept=False)
    y, x = np.array([r[0] for r in data]), np.array([r[3] for r in data])
    m = np.stack([x, *(np.array([r[1] == k for r in data], float) for k in "pqr"), *(np.array([r[2] == k for r in data], float) for k in range(1, 4))], axis=1)
    assert got.n == 90 and abs(got.beta[0] - np.linalg.lstsq(m, y, rcond=None)[0][0]) < 1e-6
    assert flat.columns == df.columns
