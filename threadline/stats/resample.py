"""Bootstraps and permutations over groups' sums.

A draw takes a cluster Poisson(1) times, by a hash of both: no cluster needs a
number, none is collected, and the method is the same at any number of them.
``hashed_bootstrap`` draws clusters by number instead, for few of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.stats.nulls import lowest_ranked

def cluster_sums(df: DataFrame, cluster: str, numerator: Column, denominator: Column) -> DataFrame:
    return df.groupBy(cluster).agg(F.sum(numerator.cast("double")).alias("num"), F.sum(denominator.cast("double")).alias("den"))


def _limits(drawn: DataFrame, *first: Column) -> DataFrame:
    return drawn.agg(*first, F.percentile("ratio", F.lit(0.025)).alias("low"), F.percentile("ratio", F.lit(0.975)).alias("high"))


def _each_draw(sums: DataFrame, cluster: str, draws: int) -> DataFrame:
    each = sums.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return each.withColumn("t", drawn_times(F.col("draw"), F.col(cluster))).filter("t > 0")


def ratio_bootstrap(df: DataFrame, cluster: str, numerator: Column, denominator: Column, draws: int = 2000) -> DataFrame:
    """estimate, low, high of a ratio of sums, drawing whole clusters; a draw without a denominator does not count."""
    sums = cluster_sums(df, cluster, numerator, denominator)
    drawn = _each_draw(sums, cluster, draws).groupBy("draw").agg(F.try_divide(F.sum(F.col("t") * F.col("num")), F.sum(F.col("t") * F.col("den"))).alias("ratio"))
    seen = sums.agg(F.try_divide(F.sum("num"), F.sum("den")).alias("estimate"))
    return seen.crossJoin(F.broadcast(_limits(drawn)))


def difference_bootstrap(df: DataFrame, cluster: str, arm: Column, numerator: Column, denominator: Column, draws: int = 2000) -> DataFrame:
    """a, b (ratios of the arm and of the rest), estimate (a less b), low, high: a draw takes a cluster's rows of both arms together."""
    num, den = numerator.cast("double"), denominator.cast("double")
    parts = {"an": F.when(arm, num), "ad": F.when(arm, den), "bn": F.when(~arm, num), "bd": F.when(~arm, den)}
    sums = df.groupBy(cluster).agg(*(F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in parts.items()))

    def ratio(side: str, weight: Column) -> Column:
        return F.try_divide(F.sum(weight * F.col(f"{side}n")), F.sum(weight * F.col(f"{side}d")))

    drawn = _each_draw(sums, cluster, draws).groupBy("draw").agg((ratio("a", F.col("t")) - ratio("b", F.col("t"))).alias("ratio"))
    seen = sums.agg(ratio("a", F.lit(1)).alias("a"), ratio("b", F.lit(1)).alias("b")).withColumn("estimate", F.col("a") - F.col("b"))
    return seen.crossJoin(F.broadcast(_limits(drawn)))


def hashed_bootstrap(sums: DataFrame, cluster: str, draws: int, most: int = 10_000) -> DataFrame:
    """draw, ratio: clusters picked by md5 of (draw, place), so that any engine draws the same.

    For at most ``most`` clusters, which are numbered in one task and broadcast;
    more are refused: ``poisson_bootstrap`` takes any number.
    """
    n = sums.count()
    if n > most:
        raise ValueError(f"{n} clusters, but at most {most} are resampled by number")
    numbered = sums.withColumn("k", F.row_number().over(_by(cluster)) - 1)
    picks = sums.sparkSession.range(0, draws).withColumnRenamed("id", "draw").withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("draw").cast("string"), F.col("place").cast("string"))), 1, 8), 16, 10).cast("bigint")
    drawn = picks.withColumn("k", F.pmod(key, F.lit(n)).cast("int")).join(F.broadcast(numbered), "k")
    return drawn.groupBy("draw").agg(F.try_divide(F.sum("num"), F.sum("den")).alias("ratio"))


def _by(cluster: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(F.lit(0)).orderBy(cluster)


def poisson_times(cluster: Column, draw: Column, seed: int) -> Column:
    """How often a draw takes a cluster: Poisson(1), from their hash."""
    u = F.pmod(F.xxhash64(cluster, draw, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    times, total, term = F.lit(0), 0.0, float(np.exp(-1))
    for k in range(1, 9):
        total += term
        times = F.when(u >= total, k).otherwise(times)
        term /= k
    return times


#: Up to which uniform number a cluster is drawn 0, 1, 2, ... times: sums of the Poisson(1) law.
TIMES = tuple(float(x) for x in np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)]))


def drawn_times(draw: Column, cluster: Column) -> Column:
    """How often a draw takes a cluster: Poisson(1), from the md5 of both, so that any engine draws the same."""
    key = F.conv(F.substring(F.md5(F.concat_ws(":", draw.cast("string"), cluster.cast("string"))), 1, 8), 16, 10).cast("bigint")
    u = key / 4294967296.0
    return sum((F.when(u >= x, 1).otherwise(0) for x in TIMES), F.lit(0))


def drawn_times_sql(draw: str, cluster: str) -> str:
    u = f"CAST(CAST('0x' || substr(md5(CAST({draw} AS VARCHAR) || ':' || CAST({cluster} AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"
    return "(" + " + ".join(f"CASE WHEN {u} >= {x!r} THEN 1 ELSE 0 END" for x in TIMES) + ")"


def poisson_bootstrap(df: DataFrame, cluster: str, numerator: Column, denominator: Column, draws: int = 200, seed: int = 0) -> DataFrame:
    """As ratio_bootstrap, for any number of clusters: each cluster counts Poisson(1) times in each draw, drawn from its hash."""
    sums = cluster_sums(df, cluster, numerator, denominator)
    each = sums.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    times = poisson_times(F.col(cluster), F.col("draw"), seed)
    drawn = each.withColumn("t", times).groupBy("draw").agg(F.try_divide(F.sum(F.col("t") * F.col("num")), F.sum(F.col("t") * F.col("den"))).alias("ratio"))
    estimate = sums.agg(F.try_divide(F.sum("num"), F.sum("den"))).first()[0]
    return drawn.agg(F.lit(estimate).cast("double").alias("estimate"), F.percentile("ratio", F.lit(0.025)).alias("low"), F.percentile("ratio", F.lit(0.975)).alias("high"))


def permutation_test(df: DataFrame, stratum: str, exposure: Column, residual: Column, draws: int = 1000, seed: int = 0, row_id: str = "pr_id") -> DataFrame:
    """observed, null_mean, null_sd, p of Σ exposure·residual, shuffling exposure within strata.

    A draw orders a stratum's rows by a hash of (draw, row) and hands its
    exposures out in that order; only rows near the last one are sorted.
    """
    rows = df.select(F.col(stratum).alias("s"), F.col(row_id).alias("i"), exposure.cast("double").alias("x"), residual.cast("double").alias("r")).filter("x is not null and r is not null")
    observed = rows.agg(F.sum(F.col("x") * F.col("r"))).first()[0]
    sizes = rows.groupBy("s").agg(F.sum("x").cast("bigint").alias("ones"))
    rank = F.xxhash64("i", "draw", F.lit(seed))
    # The rank's first byte: 256 ranges of it.
    drawn = lowest_ranked(rows.join(sizes, "s"), F.sequence(F.lit(1), F.lit(draws)), rank, F.shiftright(rank, 56), {"stat": F.sum("r")})
    none = df.sparkSession.range(1, draws + 1 if observed is not None else 1).select(F.col("id").cast("int").alias("draw"), F.lit(0.0).alias("stat"))
    stats = drawn.unionByName(none).groupBy("draw").agg(F.sum("stat").alias("stat"))
    seen = F.lit(float(observed or 0.0))
    # A draw that ties with what was seen counts, in whatever order its terms were added up.
    beyond = F.count_if(F.abs("stat") >= F.abs(seen) - 1e-9 * F.greatest(F.abs(seen), F.lit(1.0)))
    return stats.agg(seen.alias("observed"), F.avg("stat").alias("null_mean"), F.stddev_samp("stat").alias("null_sd"), ((beyond + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
