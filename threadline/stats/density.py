"""Modes and cuts of a distribution by kernel densities over a fixed grid.

Spark reduces any number of values to counts in ``GRID`` equal bins between
their least and greatest value, with moments and quartiles; the smoothing and
the search for modes then work on those bins alone, whose number is fixed.
Fewer than two values, or equal ones only, have no cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of the grid and its margin on either side, as a share of the range. Fixed values.
GRID, MARGIN = 1024, 0.05


@dataclass
class Binned:
    """Counts of values in equal bins from ``low``, each ``step`` wide."""

    low: float
    step: float
    counts: np.ndarray
    n: int
    mean: float
    sd: float
    iqr: float

    @property
    def centres(self) -> np.ndarray:
        return self.low + self.step * (np.arange(len(self.counts)) + 0.5)


def _edges(least: float, most: float) -> tuple[float, float]:
    pad = MARGIN * (most - least) + 1e-9
    return least - pad, (most - least + 2 * pad) / GRID


def _bin(value: Column, low: Column | float, step: Column | float) -> Column:
    low, step = (x if isinstance(x, Column) else F.lit(x) for x in (low, step))
    return F.least(F.greatest(F.floor((value - low) / step), F.lit(0)), F.lit(GRID - 1)).cast("int")


def binned(df: DataFrame, value: Column) -> Binned | None:
    """The grid of all finite values; None where fewer than two or all equal."""
    v = df.select(value.cast("double").alias("v")).filter("v is not null and not isnan(v) and abs(v) < double('infinity')")
    r = v.agg(F.min("v"), F.max("v"), F.count("v"), F.avg("v"), F.stddev_samp("v"), F.percentile_approx("v", [0.25, 0.75], 100_000)).first()
    if r[2] < 2 or r[0] == r[1]:
        return None
    low, step = _edges(r[0], r[1])
    counts = np.zeros(GRID)
    for b in v.groupBy(_bin(F.col("v"), low, step).alias("bin")).count().collect():
        counts[b["bin"]] = b["count"]
    return Binned(low, step, counts, r[2], r[3], r[4], r[5][1] - r[5][0])


def bandwidth(b: Binned) -> float:
    """The rule of thumb: 0.9 of the smaller spread, over the fifth root of n."""
    spread = min(b.sd, b.iqr / 1.349)
    return 0.9 * (spread if spread > 0 else b.sd or 1.0) * b.n**-0.2


def smooth(counts: np.ndarray, sigma: float) -> np.ndarray:
    """Counts under a normal kernel of sigma bins, cut at four sigma; nothing lies outside the grid."""
    if sigma <= 0:
        return counts
    reach = min(int(4 * sigma + 0.5), 4 * len(counts))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(counts, kernel / kernel.sum())
    return full[reach : reach + len(counts)]


def turns(density: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of maxima and of minima; a plateau turns where it ends."""
    slope = np.sign(np.diff(density))
    place = np.flatnonzero(slope)
    kinds = slope[place]
    change = np.flatnonzero(np.diff(kinds))
    return place[change + 1][kinds[change] > 0], place[change + 1][kinds[change] < 0]


def modes(b: Binned, h: float, counts: np.ndarray | None = None) -> int:
    return len(turns(smooth(b.counts if counts is None else counts, h / b.step))[0])


def antimode(b: Binned | None, most: float) -> float | None:
    """The lowest minimum between modes that lies at ``most`` or below; None where there is none."""
    if b is None:
        return None
    high, low = turns(smooth(b.counts, bandwidth(b) / b.step))
    inside = b.centres[low][b.centres[low] <= most]
    return float(inside.min()) if len(high) >= 2 and len(inside) else None


def critical_bandwidth(b: Binned, most_modes: int = 1) -> float:
    """The smallest bandwidth that leaves at most so many modes, by halving."""
    low, high = 1e-4, max(1.0, b.step * GRID)
    while modes(b, high) > most_modes and high < 1e4:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if modes(b, mid) > most_modes else (low, mid)
    return high


def unimodality_test(b: Binned, draws: int = 200, seed: int = 0) -> tuple[float, float]:
    """Critical bandwidth and p of one mode: draws from the density smoothed by it that show more.

    A draw takes n values of the binned distribution at once (multinomial),
    adds the kernel by smoothing those counts, shrinks to the old variance by
    scaling the bandwidth, and counts modes; its cost is that of the grid, not of n.
    """
    h = critical_bandwidth(b)
    shrink = np.sqrt(1 + h**2 / b.sd**2)
    smoothed = np.maximum(smooth(b.counts, h / b.step), 0)
    rng = np.random.default_rng(seed)
    share = smoothed / smoothed.sum()
    # shrinking the values and keeping h is keeping the values and widening h
    more = sum(modes(b, h * shrink, rng.multinomial(b.n, share).astype(float)) > 1 for _ in range(draws))
    return h, (more + 1) / (draws + 1)


def cut_by_draws(df: DataFrame, cluster: str, value: Column, most: float, draws: int = 200) -> DataFrame:
    """draw, cut: the antimode of samples of whole clusters, each counted Poisson(1) times by its hash; draw 0 is all.

    Spark counts bins by draw; a task then smooths whole draws, each a grid of fixed size.
    """
    from threadline.stats.resample import poisson_times

    base = binned(df, value)
    spark = df.sparkSession
    if base is None:
        return spark.createDataFrame([], "draw int, cut double")
    v = df.select(F.col(cluster).alias("g"), value.cast("double").alias("v")).filter("v is not null and not isnan(v)")
    bins = v.groupBy("g", _bin(F.col("v"), base.low, base.step).alias("bin")).count()
    each = bins.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    times = F.when(F.col("draw") == 0, 1).otherwise(poisson_times(F.col("g"), F.col("draw"), 0))
    counted = each.groupBy("draw", "bin").agg(F.sum(times * F.col("count")).cast("double").alias("n"))
    low, step = base.low, base.step

    def cut(key, pdf):
        import pandas as pd

        counts = np.zeros(GRID)
        counts[pdf["bin"].to_numpy()] = pdf["n"].to_numpy()
        n = counts.sum()
        centres = low + step * (np.arange(GRID) + 0.5)
        found = None
        if n >= 2:
            mean = (counts * centres).sum() / n
            sd = float(np.sqrt((counts * (centres - mean) ** 2).sum() / (n - 1)))
            at = np.interp([0.25 * n, 0.75 * n], counts.cumsum(), centres)
            found = antimode(Binned(low, step, counts, int(n), mean, sd, float(at[1] - at[0])), most)
        return pd.DataFrame({"draw": [key[0]], "cut": pd.array([found], dtype="Float64")})

    return counted.groupBy("draw").applyInPandas(cut, "draw int, cut double")
