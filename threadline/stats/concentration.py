"""How unevenly a total is spread over groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadline.operators.asof import ranked, running_sum


def composition(df: DataFrame, group: str) -> DataFrame:
    """Count, share, rank and cumulative share of each group, largest first; groups are ranked by ranges, not in one task."""
    counted = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    place = ranked(counted, [F.desc("n"), F.asc(group)])
    whole = place.agg(F.sum("n").alias("_all"))
    summed = running_sum(place, "place", "n", "_before")
    return summed.crossJoin(F.broadcast(whole)).select(group, "n", (F.col("n") / F.col("_all")).alias("share"), "place", ((F.col("_before") + F.col("n")) / F.col("_all")).alias("cumulative"))


def concentration(df: DataFrame, group: str, top: int = 10) -> DataFrame:
    """groups, HHI, share of the largest and of the top ones, Gini."""
    c = composition(df, group)
    # With places from the largest, the Gini sum needs them from the smallest: n + 1 - place.
    n, total = F.count(F.lit(1)), F.sum("n")
    return c.agg(
        n.alias("n_groups"), F.sum(F.col("share") * F.col("share")).alias("hhi"), F.max("share").alias("largest_share"),
        F.sum(F.when(F.col("place") <= top, F.col("share")).otherwise(0.0)).alias("top_share"),
        (2 * ((n + 1) * total - F.sum(F.col("place") * F.col("n"))) / (n * total) - (n + 1) / n).alias("gini"),
    )


def jensen_shannon(df: DataFrame, group: str, arm: str, a: str, b: str) -> DataFrame:
    """Jensen-Shannon distance (root, natural log) between two arms' distributions over a group."""
    wide = df.groupBy(group).agg(F.count_if(F.col(arm) == a).alias("na"), F.count_if(F.col(arm) == b).alias("nb"))
    whole = wide.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    p, q = F.try_divide(F.col("na"), F.col("ta")), F.try_divide(F.col("nb"), F.col("tb"))
    rows = wide.crossJoin(F.broadcast(whole)).select(p.alias("p"), q.alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    def kl(x: str):
        return F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / F.col("m"))).otherwise(0.0)
    return rows.agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(0.5 * kl("p") + 0.5 * kl("q")))).alias("distance"))


def rarefied(df: DataFrame, group: str, kind: str, n: int) -> DataFrame:
    """Expected number of kinds in n draws without replacement from each group, exactly: no draws are made."""
    k = df.groupBy(group, kind).agg(F.count(F.lit(1)).alias("k")).withColumn("total", F.sum("k").over(Window.partitionBy(group)))
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    absent = F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * F.greatest(F.lit(0.0), (F.col("total") - F.col("k") - i).cast("double")) / F.greatest(F.lit(1.0), (F.col("total") - i).cast("double")))
    return k.filter(F.col("total") >= n).groupBy(group).agg(F.sum(1 - absent).alias("kinds"))
