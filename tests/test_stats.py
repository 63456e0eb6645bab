"""Models and resampling against closed forms in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadline.operators import learn, textmatch
from threadline.stats import concentration, ols, resample


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    n = 400
    g = rng.integers(0, 25, n)
    x, z = (rng.random(n) < 0.4).astype(float), rng.normal(size=n)
    y = (0.3 + 0.4 * x - 0.2 * z + 0.1 * (g % 5) + rng.normal(size=n) > 0.4).astype(float)
    return g, x, z, y


@pytest.fixture(scope="module")
def frame(spark, data):
    g, x, z, y = data
    return spark.createDataFrame([(i, int(a), float(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(g, x, z, y, strict=True))], "pr_id long, g long, x double, z double, y double").cache()


def sandwich(design, e, g, bread, scale):
    meat = sum(np.outer(s, s) for s in (design[g == k].T @ e[g == k] for k in np.unique(g)))
    return np.sqrt(np.diag(scale * bread @ meat @ bread))


def test_ols(frame, data):
    g, x, z, y = data
    fit = ols.ols(frame, "y", {"x": F.col("x"), "z": F.col("z")}, "g")
    d = np.column_stack([np.ones(len(y)), x, z])
    bread = np.linalg.inv(d.T @ d)
    b = bread @ d.T @ y
    k = len(np.unique(g))
    se = sandwich(d, y - d @ b, g, bread, k / (k - 1) * (len(y) - 1) / (len(y) - 3))
    assert np.allclose(fit.beta, b) and np.allclose([s for *_, s in fit.table()], se)
    assert np.isclose(fit.contrast({"x": 1, "z": -1})[0], b[1] - b[2])


def test_logit(frame, data):
    g, x, z, y = data
    fit = ols.logit(frame, "y", {"x": F.col("x"), "z": F.col("z")}, "g")
    d, b = np.column_stack([np.ones(len(y)), x, z]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-d @ b))
        bread = np.linalg.inv(d.T @ (d * (p * (1 - p))[:, None]))
        b = b + bread @ d.T @ (y - p)
    k = len(np.unique(g))
    assert np.allclose(fit.beta, b, atol=1e-6) and np.allclose([s for *_, s in fit.table()], sandwich(d, y - 1 / (1 + np.exp(-d @ b)), g, bread, k / (k - 1)), atol=1e-6)


def test_absorbed_equals_dummies(frame):
    a = ols.ols(ols.absorb(frame, ["y", "x"], ["g"]), "y", {"x": F.col("x")}, "g", intercept=False)
    b = ols.ols(frame, "y", {"x": F.col("x")} | ols.dummies(frame, "g"), "g")
    assert np.isclose(a.beta[0], b.beta[1])


def test_leave_one_out(frame, data):
    g, x, _, y = data
    for r in ols.leave_one_out(frame, "y", {"x": F.col("x")}, "g").collect():
        m = g != r.g
        assert np.isclose(r.x, np.polyfit(x[m], y[m], 1)[0])


def test_overlap_weights_balance(frame):
    w = ols.overlap_weights(frame, "x", {"z": F.col("z")}, "g")
    a, b = (w.filter(F.col("x") == v).agg(F.sum(F.col("overlap_weight") * F.col("z")) / F.sum("overlap_weight")).first()[0] for v in (0, 1))
    assert np.isclose(a, b, atol=1e-6)


def test_bootstraps_are_repeatable_and_cover(frame, data):
    y = data[3]
    one, two = (resample.ratio_bootstrap(frame, "g", F.col("y"), F.lit(1.0), 300).first() for _ in range(2))
    assert one == two and one.low < y.mean() < one.high and np.isclose(one.estimate, y.mean())
    many = resample.poisson_bootstrap(frame, "g", F.col("y"), F.lit(1.0), 200, 1).first()
    assert abs(many.low - one.low) < 0.05 and abs(many.high - one.high) < 0.05


def test_permutation_is_centred(frame):
    flat = ols.demean(frame.withColumn("raw", F.col("x")), ["y"], "g")
    r = resample.permutation_test(flat, "g", F.col("raw"), F.col("y"), 200, 1).first()
    assert abs(r.null_mean) < r.null_sd and 0 < r.p <= 1


def test_concentration(spark):
    df = spark.createDataFrame([(k,) for k, n in (("a", 6), ("b", 3), ("c", 1)) for _ in range(n)], "g string")
    r = concentration.concentration(df, "g", 1).first()
    assert np.isclose(r.hhi, 0.46) and np.isclose(r.largest_share, 0.6) and np.isclose(r.gini, 1 / 3)


def test_auc_and_kappa(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (2.0, 0), (3.0, 1)], "s double, y int")
    assert np.isclose(textmatch.auc(df, "s", "y").first().auc, 0.875)
    k = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "p string, q string")
    assert np.isclose(textmatch.agreement(k, "p", "q").first().kappa, 0.5)


def test_classifier_learns(spark):
    rows = [(i, f"red apple {i % 7}" if i % 2 else f"blue sky {i % 7}", "fruit" if i % 2 else "air") for i in range(60)]
    df = learn.with_grams(spark.createDataFrame(rows, "id long, t string, y string"), "t")
    out = learn.cross_validated(df, "y", F.col("id"), 2)
    assert out.filter("y = predicted").count() == 60
    assert {r.f1 for r in learn.f1_scores(out, "y").collect()} == {1.0}
