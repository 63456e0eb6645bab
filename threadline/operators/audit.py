"""Coverage, waterfalls, samples and check tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of each side, shared, and orphans on either side, in one full join of distinct keys."""
    a = left.select(F.col(key).alias("k")).filter("k is not null").distinct().withColumn("l", F.lit(1))
    b = right.select(F.col(key).alias("k")).filter("k is not null").distinct().withColumn("r", F.lit(1))
    both = a.join(b, "k", "full")
    return both.agg(F.count("l").alias("left_keys"), F.count("r").alias("right_keys"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


def waterfall(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Rows left after each further condition, all counted in one pass."""
    conditions, so_far = [], F.lit(True)
    for name, step in steps.items():
        so_far = so_far & F.coalesce(step, F.lit(False))
        conditions.append(F.count_if(so_far).alias(name))
    counts = df.agg(*conditions)
    rows = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(n).alias("condition"), F.col(n).alias("n")) for i, n in enumerate(steps)))
    return counts.select(F.explode(rows).alias("x")).select("x.*")


def check_table(df: DataFrame, checks: dict[str, tuple[Column, str]]) -> DataFrame:
    """check, severity, violations, passed: every check in one pass. A check is what a good row satisfies."""
    counts = df.agg(*(F.count_if(~F.coalesce(good, F.lit(False))).alias(name) for name, (good, _) in checks.items()))
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.col(n).alias("violations"), (F.col(n) == 0).alias("passed")) for n, (_, s) in checks.items()))
    return counts.select(F.explode(rows).alias("x")).select("x.*")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, rows, nulls, distinct values (null not counted), least and greatest as text."""
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))
    long = df.select(F.explode(rows).alias("x")).select("x.*")
    return long.groupBy("column").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("v").isNull()).alias("n_null"), F.count_distinct("v").alias("n_distinct"), F.min("v").alias("least"), F.max("v").alias("greatest"))


def sample_by_hash(df: DataFrame, strata: list[str], row_id: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each stratum in the order of a hash of their id, with the weight each stands for: the same rows on any cluster."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))
    stratum = Window.partitionBy(*strata)
    ranked = df.withColumns({"_n": F.row_number().over(stratum.orderBy(key, row_id)), "_size": F.count(F.lit(1)).over(stratum)})
    return ranked.filter(F.col("_n") <= n).withColumn("design_weight", F.col("_size") / F.least(F.col("_size"), F.lit(n))).drop("_n", "_size")


def weighted_sample(df: DataFrame, row_id: str, weight: Column, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, with chances by weight: the greatest keys u^(1/w), u from a hash of the id."""
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string"))), 1, 12), 16, 10).cast("double") + 1) / float(16**12 + 1)
    return df.withColumn("sample_key", F.pow(u, 1 / weight)).orderBy(F.desc("sample_key"), row_id).limit(n)


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with their side; none means that they are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def violations(df: DataFrame, codes: dict[str, Column], name: str = "violations") -> DataFrame:
    """df with an array of the codes whose condition holds."""
    return df.withColumn(name, F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in codes.items()))))


def state_at(events: DataFrame, key: str, kind: str, time: str, tie: str, until: Column) -> DataFrame:
    """The kind of each key's last event up to a time."""
    return events.filter(F.col(time) <= until).groupBy(key).agg(F.max(F.struct(time, tie, kind))[kind].alias("state"))


def zero_filled(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of the given values, absent ones as 0."""
    dims = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(dims).join(n, column, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def account_scores(events: DataFrame, login: str, time: str, text: str) -> DataFrame:
    """Marks of automation for each account: repeated texts, even gaps, few hours, much per active day."""
    order = Window.partitionBy(login).orderBy(time, "event_id")
    gaps = events.withColumn("gap", F.timestamp_diff("SECOND", F.lag(time).over(order), F.col(time)).cast("double"))
    base = gaps.groupBy(login).agg(
        F.count(F.lit(1)).alias("n"), (1 - F.count_distinct(text) / F.count(text)).alias("duplicate_share"),
        F.try_divide(F.stddev_samp("gap"), F.avg("gap")).alias("gap_cv"), F.count_distinct(F.to_date(time)).alias("active_days"),
    )
    by_hour = events.groupBy(login, F.hour(time).alias("h")).agg(F.count(F.lit(1)).alias("k"))
    p = F.col("k") / F.sum("k").over(Window.partitionBy(login))
    entropy = by_hour.withColumn("p", p).groupBy(login).agg((-F.sum(F.col("p") * F.log2("p"))).alias("hour_entropy"))
    return base.join(entropy, login).withColumn("per_active_day", F.col("n") / F.col("active_days"))


def graded(columns: list[str], required: list[str], conditional: list[str]) -> str:
    """FULL, CONDITIONAL or INCOMPATIBLE by the columns a source has."""
    have = set(columns)
    if not set(required) <= have:
        return "INCOMPATIBLE"
    return "FULL" if set(conditional) <= have else "CONDITIONAL"
