"""Monthly panels, entrants' features and event-month contrasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadline.functions.columns import rate


def month(column: str):
    return F.date_trunc("month", F.col(column)).cast("timestamp_ntz")


def monthly_panel(items: DataFrame, key: str = "repo_id", time: str = "created_dt") -> DataFrame:
    return items.groupBy(key, month(time).alias("month")).agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct("agent").alias("n_agents"), rate(F.col("merged_dt").isNotNull()).alias("merge_rate"))


def months_between(late, early):
    return (F.year(late) - F.year(early)) * 12 + F.month(late) - F.month(early)


def pre_features(panel: DataFrame, onsets: DataFrame, months: int = 3, key: str = "repo_id") -> DataFrame:
    """Mean log volume, its slope and the mean rate over the months before an onset; all of them must be there."""
    joined = panel.join(onsets.select(key, month("onset_dt").alias("onset_month")), key)
    at = joined.withColumn("event_month", months_between(F.col("month"), F.col("onset_month")).cast("int")).filter(F.col("event_month").between(-months, -1))
    v = F.log1p(F.col("n_items").cast("double"))
    out = at.groupBy(key, "onset_month").agg(F.count(F.lit(1)).alias("k"), F.avg(v).alias("mean_log"), F.regr_slope(v, F.col("event_month").cast("double")).alias("slope"), F.avg("merge_rate").alias("mean_rate"))
    return out.filter(F.col("k") == months).drop("k")


def event_contrasts(pairs: DataFrame, panel: DataFrame, width: int, value: str, key: str = "repo_id") -> DataFrame:
    """Treated less control by event month for matched pairs, and the difference to month -1. Absent months count as 0."""
    grid = pairs.withColumn("event_month", F.explode(F.sequence(F.lit(-width), F.lit(width)))).withColumn("month", F.add_months(F.to_date("onset_month"), F.col("event_month")).cast("timestamp_ntz"))
    a = panel.select(F.col(key).alias("exposed_id"), "month", F.col(value).cast("double").alias("a"))
    b = panel.select(F.col(key).alias("control_id"), "month", F.col(value).cast("double").alias("b"))
    zero = F.lit(0.0)
    joined = grid.join(a, ["exposed_id", "month"], "left").join(b, ["control_id", "month"], "left")
    gaps = joined.select("exposed_id", "control_id", "event_month", (F.coalesce("a", zero) - F.coalesce("b", zero)).alias("gap"))
    base = F.max(F.when(F.col("event_month") == -1, F.col("gap"))).over(Window.partitionBy("exposed_id", "control_id"))
    return gaps.withColumn("did", F.col("gap") - base)


def task_shares(items: DataFrame, key: str, task: str) -> DataFrame:
    n = F.count(F.lit(1))
    return items.groupBy(key, task).agg(n.alias("n"), (n / F.sum(n).over(Window.partitionBy(key))).alias("share"))


def available_before(items: DataFrame, key: str = "repo_id", agent: str = "agent", time: str = "created_dt", tie: str = "pr_id") -> DataFrame:
    """How many agents a group had used strictly before each item: running first uses, not a growing set."""
    order = Window.partitionBy(key).orderBy(time, tie)
    new = (F.row_number().over(Window.partitionBy(key, agent).orderBy(time, tie)) == 1).cast("int")
    marked = items.withColumn("_new", new)
    return marked.withColumn("n_available", F.coalesce(F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))).drop("_new")


def shrunken_advantage(items: DataFrame, agent: str, task: str, outcome, prior: float = 10.0) -> DataFrame:
    """Success of an agent at a task, shrunk towards the task's own rate by ``prior`` items."""
    y = outcome.cast("double")
    by = items.groupBy(agent, task).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("wins"))
    w = Window.partitionBy(task)
    base = F.sum("wins").over(w) / F.sum("n").over(w)
    return by.withColumn("task_rate", base).withColumn("score", (F.col("wins") + prior * F.col("task_rate")) / (F.col("n") + prior))
