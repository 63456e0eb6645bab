"""Least squares and logit from Gram sums, with cluster-robust errors.

Rows never leave Spark: a pass gives X'X and X'y, whose size is that of the
model, and a second one the scores of each cluster, squared and summed there
too. The driver solves systems of a few dozen unknowns.

Only complete cases count: a row that lacks the outcome, a regressor, the weight
or the cluster is in no sum, no count and no mean that is taken out before.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.sources.stage import staged


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    clusters: int
    rank: int | None = None

    def table(self) -> list[tuple[str, float, float]]:
        return [(k, float(b), float(s)) for k, b, s in zip(self.names, self.beta, np.sqrt(np.maximum(np.diag(self.cov), 0)), strict=True)]

    def wald(self, rows: list[dict[str, float]]) -> tuple[float, int, float]:
        """Statistic, degrees of freedom and p of several combinations being 0 together; combinations that follow from others don't count."""
        r = np.array([[w.get(k, 0.0) for k in self.names] for w in rows])
        middle = r @ self.cov @ r.T
        df = int(np.linalg.matrix_rank(middle, hermitian=True))
        value = float((r @ self.beta) @ np.linalg.pinv(middle, hermitian=True) @ (r @ self.beta))
        return value, df, chi_square_tail(value, df)

    def contrast(self, weights: dict[str, float]) -> tuple[float, float]:
        """A linear combination and its standard error."""
        w = np.array([weights.get(k, 0.0) for k in self.names])
        return float(w @ self.beta), float(np.sqrt(max(w @ self.cov @ w, 0.0)))


def chi_square_tail(value: float, df: int) -> float:
    """The chance of more than value under so many degrees of freedom: a finite sum for any whole number of them."""
    if df < 1:
        return float("nan")
    half = max(value, 0.0) / 2
    if df % 2:
        total, term = math.erfc(math.sqrt(half)), math.sqrt(half / math.pi) * 2 * math.exp(-half)
        for k in range(1, df, 2):
            total += term
            term *= 2 * half / (k + 2)
        return min(total, 1.0)
    total, term = 0.0, math.exp(-half)
    for k in range(df // 2):
        total += term
        term *= half / (k + 1)
    return min(total, 1.0)


def complete(df: DataFrame, *needed: Column | str) -> DataFrame:
    """The rows where none of these is null or not a number."""
    kinds = dict(df.dtypes)
    ok = F.lit(True)
    for c in needed:
        col = F.col(c) if isinstance(c, str) else c
        ok = ok & col.isNotNull()
        if not isinstance(c, str) or kinds.get(c) in ("double", "float"):
            ok = ok & ~F.isnan(col.cast("double"))
    return df.filter(ok)


def dummies(df: DataFrame, column: str, reference: str | None = None, most: int = 500) -> dict[str, Column]:
    """A 0/1 column for each level but the reference (by default the first); ``most`` bounds the levels."""
    levels = [r[0] for r in df.select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(levels) > most:
        raise ValueError(f"{column} has over {most} levels; absorb it instead")
    base = levels[0] if reference is None else reference
    return {f"{column}={v}": (F.col(column) == F.lit(v)).cast("double") for v in levels if v != base}


def _means(df: DataFrame, columns: list[str], by: str, weight: str | None) -> DataFrame:
    """by and the means of columns, added up map-side: a row per group, so that a large group is no single task."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return df.groupBy(F.col(by).alias("_g")).agg(F.sum(w).alias("_w"), *(F.try_divide(F.sum(F.col(c) * w), F.sum(w)).alias(f"_m_{c}") for c in columns))


def demean(df: DataFrame, columns: list[str], by: str, weight: str | None = None) -> DataFrame:
    """Columns less their means within groups: absorbs a fixed effect. Rows that lack one of them, the group or the weight go first."""
    whole = complete(df, *columns, by, *([weight] if weight else []))
    joined = whole.join(_means(whole, columns, by, weight), F.col(by) == F.col("_g"))
    return joined.select(*((F.col(c) - F.col(f"_m_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns))


def _sweep(n: np.ndarray, left: np.ndarray, places: list[np.ndarray], spread: np.ndarray, tolerance: float, most: int) -> np.ndarray:
    """Cells' sums without the means of each grouping, taken out in turns until none is left."""
    sizes = [np.bincount(p, weights=n) for p in places]
    for _ in range(most):
        largest = 0.0
        for p, size in zip(places, sizes, strict=True):
            means = np.stack([np.bincount(p, weights=left[:, c]) / size for c in range(left.shape[1])], axis=1)
            largest = max(largest, float(np.max(np.abs(means) / spread, initial=0.0)))
            left = left - n[:, None] * means[p]
        if largest < tolerance:
            return left
    raise ValueError(f"means of the groupings are not gone after {most} passes")


def absorb(df: DataFrame, columns: list[str], groups: list[str], tolerance: float = 1e-10, most: int = 2000, few: int = 200_000) -> DataFrame:
    """Columns without several fixed effects: what is left when the means of one grouping after the other are taken out until none is left.

    Only the sums of each cell (a combination of groups) matter for that, so rows are added up once, passes go over
    cells, and the rows get their cell's shift by one join. A pass ends with the largest mean of any group, relative to
    the column's deviation; passes end once it is under ``tolerance`` and raise after ``most``. Up to ``few`` cells the
    passes run in one place; beyond, each pass is a job over the cells that is written, so a lost executor costs one
    pass. Both go on to the same tolerance. Rows that lack a column or a group go first.
    """
    if len(groups) == 1:
        return demean(df, columns, groups[0])
    whole = complete(df, *columns, *groups)
    spread = whole.agg(*(F.stddev_pop(c).alias(c) for c in columns)).first()
    scale = [float(spread[c] or 0.0) or 1.0 for c in columns]
    keys, sums = [f"_k{i}" for i in range(len(groups))], [f"_s{i}" for i in range(len(columns))]
    cells = staged(whole.groupBy(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True))).agg(F.count(F.lit(1)).cast("double").alias("_n"), *(F.sum(F.col(c).cast("double")).alias(s) for c, s in zip(columns, sums, strict=True))))
    if cells.count() <= few:
        table = cells.toPandas()
        places = [np.unique(table[k].to_numpy(), return_inverse=True)[1] for k in keys]
        before = table[sums].to_numpy(float)
        shift = (before - _sweep(table["_n"].to_numpy(float), before, places, np.array(scale), tolerance, most)) / table[["_n"]].to_numpy(float)
        for c, s in enumerate(sums):
            table[s] = shift[:, c]
        shifts = df.sparkSession.createDataFrame(table[[*keys, *sums]], cells.select(*keys, *sums).schema)
    else:
        left = cells.select(*keys, "_n", *sums, *(F.col(s).alias(f"{s}0") for s in sums))
        for _ in range(most):
            largest = 0.0
            for k in keys:
                means = left.groupBy(k).agg(*(F.try_divide(F.sum(s), F.sum("_n")).alias(f"_m{s}") for s in sums))
                top = means.agg(F.greatest(*(F.max(F.abs(f"_m{s}")) / x for s, x in zip(sums, scale, strict=True)), F.lit(0.0))).first()[0]
                largest = max(largest, float(top))
                left = staged(left.join(means, k).select(*keys, "_n", *((F.col(s) - F.col("_n") * F.col(f"_m{s}")).alias(s) for s in sums), *(f"{s}0" for s in sums)))
            if largest < tolerance:
                break
        else:
            raise ValueError(f"means of the groupings are not gone after {most} passes")
        shifts = left.select(*keys, *(((F.col(f"{s}0") - F.col(s)) / F.col("_n")).alias(s) for s in sums))
    joined = whole.join(shifts, [F.col(g) == F.col(k) for g, k in zip(groups, keys, strict=True)])
    at = dict(zip(columns, sums, strict=True))
    return joined.select(*((F.col(c) - F.col(at[c])).alias(c) if c in at else F.col(c) for c in df.columns))


def _named(df: DataFrame, y: str, x: dict[str, Column], weight: str | None, cluster: str | None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(y).cast("double").alias("y"), w.alias("w"), (F.col(cluster) if cluster else F.lit(0)).alias("g"), F.array(*(c.cast("double") for c in x.values())).alias("x"))
    return complete(rows, "y", "w", "g").filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))


def _gram(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """X'WX, X'Wy and n: one row of sums."""
    x = [F.col("x")[i] for i in range(k)]
    sums = [F.sum(F.col("w") * x[i] * x[j]) for i in range(k) for j in range(i + 1)] + [F.sum(F.col("w") * x[i] * F.col("y")) for i in range(k)]
    row = rows.agg(F.count(F.lit(1)), F.array(*(F.coalesce(s, F.lit(0.0)) for s in sums))).first()
    a = np.zeros((k, k))
    a[np.tril_indices(k)] = row[1][: k * (k + 1) // 2]
    return a + np.tril(a, -1).T, np.array(row[1][k * (k + 1) // 2 :]), row[0]


def _meat(rows: DataFrame, score: Column, k: int) -> tuple[np.ndarray, int]:
    """Sum over clusters of the outer products of their scores."""
    sums = rows.groupBy("g").agg(*(F.sum(score * F.col("x")[i]).alias(f"s{i}") for i in range(k)))
    s = [F.col(f"s{i}") for i in range(k)]
    row = sums.agg(F.count(F.lit(1)), F.array(*(F.sum(s[i] * s[j]) for i in range(k) for j in range(i + 1)))).first()
    a = np.zeros((k, k))
    a[np.tril_indices(k)] = row[1]
    return a + np.tril(a, -1).T, row[0]


def _linear(x: Column, beta: np.ndarray) -> Column:
    return sum((x[i] * float(b) for i, b in enumerate(beta)), F.lit(0.0))


def ols(df: DataFrame, y: str, x: dict[str, Column], cluster: str, weight: str | None = None, intercept: bool = True, absorbed: int = 0) -> Fit:
    """(Weighted) least squares with errors clustered by ``cluster``; ``absorbed`` counts fixed effects taken out before."""
    x = ({"const": F.lit(1.0)} if intercept else {}) | x
    rows, k = _named(df, y, x, weight, cluster), len(x)
    a, b, n = _gram(rows, k)
    inverse = np.linalg.pinv(a)
    beta = inverse @ b
    meat, g = _meat(rows, F.col("w") * (F.col("y") - _linear(F.col("x"), beta)), k)
    scale = g / max(g - 1, 1) * (n - 1) / max(n - k - absorbed, 1)
    return Fit(list(x), beta, scale * inverse @ meat @ inverse, n, g)


def reestimates(df: DataFrame, y: str, x: dict[str, Column], cluster: str, keep: dict[str, Column]) -> dict[str, Fit]:
    """The same least squares on several selections of the rows (by name, a condition), in one pass of Gram sums and one of scores for all of them.

    A row counts for each selection that it meets; one whose condition is null is in none. Selections without a row have no fit.
    """
    x = {"const": F.lit(1.0)} | x
    k = len(x)
    flags = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in keep.items())), lambda v: v.isNotNull())
    values = F.array(*(c.cast("double") for c in x.values()))
    base = df.select(F.col(y).cast("double").alias("y"), F.col(cluster).alias("g"), values.alias("x"), flags.alias("in"))
    rows = complete(base, "y", "g").filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))).select("y", "g", "x", F.explode("in").alias("name"))
    c = [F.col("x")[i] for i in range(k)]
    flat = [c[i] * c[j] for i in range(k) for j in range(k)] + [c[i] * F.col("y") for i in range(k)]
    betas, inverses, sizes = {}, {}, {}
    for r in rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(f) for f in flat)).alias("s")).collect():
        s = np.array(r.s)
        inverses[r.name] = np.linalg.pinv(s[: k * k].reshape(k, k))
        betas[r.name], sizes[r.name] = inverses[r.name] @ s[k * k :], r.n
    if not betas:
        return {}
    table = F.create_map(*(v for name, b in betas.items() for v in (F.lit(name), F.array(*(F.lit(float(t)) for t in b)))))
    beta = table[F.col("name")]
    residual = F.col("y") - sum((c[i] * beta[i] for i in range(k)), F.lit(0.0))
    scores = rows.groupBy("name", "g").agg(*(F.sum(residual * c[i]).alias(f"s{i}") for i in range(k)))
    t = [F.col(f"s{i}") for i in range(k)]
    found = {}
    for r in scores.groupBy("name").agg(F.count(F.lit(1)).alias("g"), F.array(*(F.sum(t[i] * t[j]) for i in range(k) for j in range(k))).alias("m")).collect():
        n, g, inverse = sizes[r.name], r.g, inverses[r.name]
        scale = g / max(g - 1, 1) * (n - 1) / max(n - k, 1)
        found[r.name] = Fit(list(x), betas[r.name], scale * inverse @ np.array(r.m).reshape(k, k) @ inverse, n, g)
    return {name: found[name] for name in keep if name in found}


def logit(df: DataFrame, y: str, x: dict[str, Column], cluster: str, rounds: int = 25, tolerance: float = 1e-10) -> Fit:
    """Logistic regression by reweighted least squares: a Gram sum for each round."""
    x = {"const": F.lit(1.0)} | x
    base, k = _named(df, y, x, None, cluster), len(x)
    beta, inverse, n = np.zeros(k), np.eye(k), 0
    for _ in range(rounds):
        eta = _linear(F.col("x"), beta)
        p = 1 / (1 + F.exp(-eta))
        step = base.withColumn("p", p).select("g", "x", (F.col("p") * (1 - F.col("p"))).alias("w"), (F.col("y") - F.col("p")).alias("r"))
        a, b, n = _gram(step.withColumn("y", F.try_divide(F.col("r"), F.col("w"))).fillna(0.0, ["y"]), k)
        inverse = np.linalg.pinv(a)
        move = inverse @ b
        beta = beta + move
        if np.max(np.abs(move)) < tolerance:
            break
    meat, g = _meat(base, F.col("y") - 1 / (1 + F.exp(-_linear(F.col("x"), beta))), k)
    return Fit(list(x), beta, g / max(g - 1, 1) * inverse @ meat @ inverse, n, g)


def leave_one_out(df: DataFrame, y: str, x: dict[str, Column], group: str) -> DataFrame:
    """Coefficients without each group: one pass of Gram sums per group, downdated from their total.

    The groups' sums stay in Spark; each group's small system is solved in its own row.
    """
    x = {"const": F.lit(1.0)} | x
    k = len(x)
    rows = _named(df, y, x, None, group)
    c = [F.col("x")[i] for i in range(k)]
    flat = [c[i] * c[j] for i in range(k) for j in range(k)] + [c[i] * F.col("y") for i in range(k)]
    sums = rows.groupBy("g").agg(F.array(*(F.sum(f) for f in flat)).alias("s"))
    total = np.array(rows.agg(F.array(*(F.sum(f) for f in flat))).first()[0])

    def solve(batches):
        for pdf in batches:
            out = []
            for s in pdf["s"]:
                left = total - np.asarray(s)
                out.append((np.linalg.pinv(left[: k * k].reshape(k, k)) @ left[k * k :]).tolist())
            yield pdf[["g"]].assign(beta=out)

    kind = df.schema[group].dataType.simpleString()
    names = list(x)
    solved = sums.mapInPandas(solve, f"g {kind}, beta array<double>")
    return solved.select(F.col("g").alias(group), *(F.col("beta")[i].alias(n) for i, n in enumerate(names)))


def overlap_weights(df: DataFrame, exposure: str, x: dict[str, Column], cluster: str) -> DataFrame:
    """score, the fitted chance of exposure, and overlap_weight: 1 less it for exposed rows, it for others."""
    fit = logit(df, exposure, x, cluster)
    eta = sum((c.cast("double") * float(b) for c, b in zip(({"const": F.lit(1.0)} | x).values(), fit.beta, strict=True)), F.lit(0.0))
    scored = df.withColumn("score", 1 / (1 + F.exp(-eta)))
    return scored.withColumn("overlap_weight", F.when(F.col(exposure).cast("double") == 1.0, 1 - F.col("score")).otherwise(F.col("score")))


def moderation(df: DataFrame, y: str, a: Column, b: Column, others: dict[str, Column], cluster: str, groups: list[str], z: float = 1.959963984540054) -> DataFrame:
    """check, detail, estimate, low, high, n of the difference of two effects, a less b: as fitted, within clusters, and without each group in turn.

    Fits without a group are downdated from one pass of sums by group, never refitted; their row has the median and the
    extremes. A group without which one of the effects has no row is left out of them.
    """
    x = {"a": a.cast("double"), "b": b.cast("double"), **others}
    held = {f"_{k}": v.cast("double") for k, v in x.items()}
    whole = complete(df.withColumns(held), y, cluster, *held, *groups)
    names = {k: F.col(k) for k in held}
    less = {"_a": 1.0, "_b": -1.0}
    found = []
    for check, fit in (("primary", ols(whole, y, names, cluster)), ("fixed_effects", ols(demean(whole, [y, *held], cluster), y, names, cluster, intercept=False))):
        estimate, error = fit.contrast(less)
        found.append((check, cluster, estimate, estimate - z * error, estimate + z * error, fit.n))
    n = found[0][-1]
    fixed = df.sparkSession.createDataFrame(found, "check string, detail string, estimate double, low double, high double, n bigint")
    for g in groups:
        has = whole.groupBy(g).agg(F.sum("_a").alias("na"), F.sum("_b").alias("nb"))
        total = has.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
        able = has.crossJoin(F.broadcast(total)).filter((F.col("ta") > F.col("na")) & (F.col("tb") > F.col("nb"))).select(g)
        d = leave_one_out(whole, y, names, g).join(able, g).select((F.col("_a") - F.col("_b")).alias("d"))
        fixed = fixed.unionByName(d.agg(F.lit("leave_one_out").alias("check"), F.lit(g).alias("detail"), F.percentile("d", F.lit(0.5)).alias("estimate"), F.min("d").alias("low"), F.max("d").alias("high"), F.lit(n).cast("bigint").alias("n")))
    return fixed
