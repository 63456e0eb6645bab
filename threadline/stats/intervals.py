"""Intervals of ratios and medians by draws of whole units.

A draw takes each unit Poisson(1) times, by a hash of (draw, unit), so no unit
has a number, nothing is collected, and one method holds at any number of
units. Draws are summed map-side: what is shuffled is a row per group and draw,
or for medians the histogram of a group's values in a draw.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.stats.resample import drawn_times


def with_draws(df: DataFrame, unit: str, draws: int) -> DataFrame:
    """Each row as often as there are draws that take its unit, with draw and times (how often)."""
    each = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return each.withColumn("times", drawn_times(F.col("draw"), F.col(unit))).filter("times > 0")


def ratio_draws(sums: DataFrame, keys: list[str], draws: int, unit: str = "unit") -> DataFrame:
    """keys, draw, ratio; sums has one row per unit and group with num and den. Draws whose den is 0 have no ratio and go."""
    drawn = with_draws(sums, unit, draws).groupBy(*keys, "draw").agg(F.try_divide(F.sum(F.col("times") * F.col("num")), F.sum(F.col("times") * F.col("den"))).alias("ratio"))
    return drawn.filter("ratio is not null")


def _beside(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """other's row of the same keys; without keys it has one row."""
    return df.join(other, keys, how) if keys else df.crossJoin(F.broadcast(other))


def jackknife(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, estimate, acceleration: each unit's estimate without it is the totals less its own sums, never a refit."""
    total = sums.groupBy(*keys).agg(F.sum("num").alias("_num"), F.sum("den").alias("_den"))
    without = F.try_divide(F.col("_num") - F.col("num"), F.col("_den") - F.col("den"))
    # the third central moment over the second to 3/2 is the skewness; what counts are means less estimates
    skew = F.skewness(without)
    acceleration = F.when(skew.isNull() | F.isnan(skew), 0.0).otherwise(-skew / (6 * F.sqrt(F.count(without).cast("double"))))
    return _beside(sums, total, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.sum("num"), F.sum("den")).alias("estimate"), acceleration.alias("acceleration"))


def bca_parts(sums: DataFrame, keys: list[str], draws: int = 2000, unit: str = "unit") -> DataFrame:
    """keys, n, estimate, acceleration, below (share of draws below the estimate, equal ones half), drawn (their sorted ratios, ``draws`` at most)."""
    base = jackknife(sums, keys)
    each = _beside(ratio_draws(sums, keys, draws, unit), base.select(*keys, "estimate"), keys)
    under = F.avg(F.when(F.col("ratio") < F.col("estimate"), 1.0).when(F.col("ratio") == F.col("estimate"), 0.5).otherwise(0.0))
    drawn = each.groupBy(*keys).agg(under.alias("below"), F.sort_array(F.collect_list("ratio")).alias("drawn"))
    return _beside(base, drawn, keys, "left")


def bca_levels(below: float, acceleration: float, level: float) -> tuple[float, float] | None:
    """Which quantiles of the draws bound the interval once bias and acceleration are corrected."""
    if not 0 < below < 1:
        return None
    normal = NormalDist()
    z0 = normal.inv_cdf(below)

    def corrected(z: float) -> float:
        return normal.cdf(z0 + (z0 + z) / (1 - acceleration * (z0 + z)))

    z = normal.inv_cdf((1 - level) / 2)
    return corrected(z), corrected(-z)


def _at(drawn: list[float], share: float) -> float:
    place = share * (len(drawn) - 1)
    k = min(int(place), len(drawn) - 2) if len(drawn) > 1 else 0
    return drawn[k] if len(drawn) == 1 else drawn[k] + (place - k) * (drawn[k + 1] - drawn[k])


def bca(sums: DataFrame, keys: list[str], draws: int = 2000, level: float = 0.95, unit: str = "unit") -> DataFrame:
    """keys, n, estimate, low, high of a ratio of sums over units: bias-corrected and accelerated.

    Fewer than two units, or draws all on one side of the estimate, have no interval. Only a group's sorted draws
    (``draws`` numbers) reach the step that needs the normal law.
    """
    parts = bca_parts(sums, keys, draws, unit)
    kinds = [f"`{k}` {parts.schema[k].dataType.simpleString()}" for k in keys]

    def bounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            low, high = [], []
            for n, below, acceleration, drawn in zip(frame["n"], frame["below"], frame["acceleration"], frame["drawn"], strict=True):
                levels = bca_levels(below, acceleration, level) if n > 1 and drawn is not None and len(drawn) else None
                low.append(_at(list(drawn), levels[0]) if levels else None)
                high.append(_at(list(drawn), levels[1]) if levels else None)
            yield frame.assign(low=pd.Series(low, frame.index, dtype=float), high=pd.Series(high, frame.index, dtype=float)).drop(columns=["below", "drawn"])

    return parts.mapInPandas(bounds, ", ".join([*kinds, "n bigint, estimate double, acceleration double, low double, high double"])).withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("low", "high")})


def median_difference(rows: DataFrame, keys: list[str], arm: str, value: str, unit: str, draws: int = 2000, level: float = 0.95) -> DataFrame:
    """keys, n and median of both arms, difference (true less false), low, high, apart: by draws of units within each arm.

    A draw's median is that of the histogram of its values, each counted as often as its unit is drawn. Null values
    and rows without an arm are left out; an empty arm leaves everything but the counts null.
    """
    known = rows.filter(F.col(value).isNotNull() & F.col(arm).isNotNull()).select(*keys, F.col(arm).alias("_arm"), F.col(value).cast("double").alias("_v"), F.col(unit).alias("_unit"))

    half, v = F.lit(0.5), F.col("_v")
    on, off = F.col("_arm"), ~F.col("_arm")
    plain = known.groupBy(*keys).agg(
        F.count_if(on).alias("n_true"), F.count_if(off).alias("n_false"), F.percentile(F.when(on, v), half).alias("median_true"), F.percentile(F.when(off, v), half).alias("median_false")
    )
    # Draws make rows many: units are dealt before that, to more tasks than their few bytes would get.
    dealt = known.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_unit")
    histogram = with_draws(dealt, "_unit", draws).groupBy(*keys, "draw", "_arm").agg(F.percentile("_v", half, F.col("times")).alias("m"))
    both = histogram.groupBy(*keys, "draw").agg((F.max(F.when(on, F.col("m"))) - F.max(F.when(off, F.col("m")))).alias("d"))
    tail = (1 - level) / 2
    bands = both.groupBy(*keys).agg(F.percentile("d", F.lit(tail)).alias("low"), F.percentile("d", F.lit(1 - tail)).alias("high"))
    return _beside(plain, bands, keys, "left").withColumns({"difference": F.col("median_true") - F.col("median_false"), "apart": F.coalesce((F.col("low") > 0) | (F.col("high") < 0), F.lit(False))})
