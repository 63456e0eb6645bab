"""Histories strictly before an event, and who first mediates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadline.functions.columns import hours, is_type


def strict_prior_history(targets: DataFrame, history: DataFrame, keys: list[str], target_id: str = "pr_id", target_time: str = "trigger_dt", time: str = "interaction_dt") -> DataFrame:
    """Earlier events of the same keys on other items: how many, on how many items, how recent.

    Targets and events are stacked in order of time, targets first at equal times, and counted as they go by: all events
    less those of the target's own item, items as they first come up less the own one. The last event of another item is
    the last event, or, where that is of the target's item, the one before the stretch of events of that item. So an
    account's events are read once, however many targets it has. Null keys have no history.
    """
    known = history.select(*keys, F.col("pr_id").alias("_item"), F.col(time).alias("_at")).filter("_at is not null")
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    none = F.lit(None)
    asked = targets.select(*keys, F.col(target_id).alias("_item"), F.col(target_time).alias("_at"), F.lit(0).alias("_side"), F.struct(*targets.columns).alias("_row"))
    both = asked.unionByName(known.select(*keys, "_item", "_at", F.lit(1).alias("_side"), none.cast(asked.schema["_row"].dataType).alias("_row")))
    turn, own = Window.partitionBy(*keys).orderBy("_at", "_side", "_item"), Window.partitionBy(*keys, "_item").orderBy("_at", "_side")
    before, own_before = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (turn, own))
    event = F.col("_side") == 1
    zero = F.lit(0).cast("bigint")
    counted = both.withColumn("_own", F.coalesce(F.sum("_side").over(own_before), zero)).withColumns(
        {
            "_all": F.coalesce(F.sum("_side").over(before), zero),
            "_items": F.coalesce(F.sum((event & (F.col("_own") == 0)).cast("int")).over(before), zero),
            "_last": F.last(F.when(event, F.struct("_at", "_item")), ignorenulls=True).over(before),
        }
    )
    changed = F.when(event & ~F.col("_last._item").eqNullSafe(F.col("_item")), F.col("_last._at"))
    found = counted.withColumn("_changed", F.last(changed, ignorenulls=True).over(before)).filter("_side = 0")
    last = F.when(~F.col("_last._item").eqNullSafe(F.col("_item")), F.col("_last._at")).otherwise(F.col("_changed"))
    out = found.select("_row.*", (F.col("_all") - F.col("_own")).alias("n_prior"), (F.col("_items") - (F.col("_own") > 0).cast("bigint")).alias("n_prior_items"), last.alias("last_prior_dt"))
    return out.withColumn("hours_since_prior", hours("last_prior_dt", target_time))


def first_responders(responses: DataFrame, horizon_hours: float = 48.0) -> DataFrame:
    """First response of each account to each item within the horizon, its rank, and ties at the first instant."""
    near = responses.filter((F.col("hours_after") <= horizon_hours) & is_type("user"))
    first = near.groupBy("pr_id", "actor_login").agg(F.min("interaction_dt").alias("first_dt"), F.min_by("source", F.struct("interaction_dt", "event_id")).alias("source"))
    item = Window.partitionBy("pr_id")
    at = F.min("first_dt").over(item)
    return first.withColumns({"responder_rank": F.rank().over(item.orderBy("first_dt")), "is_first": F.col("first_dt") == at, "n_first": F.sum((F.col("first_dt") == at).cast("bigint")).over(item)})


def with_total(df: DataFrame, keys: list[str], aggregates: list, total: str = "all") -> DataFrame:
    """Groups and their grand total in one pass."""
    out = df.cube(*keys).agg(F.grouping_id().alias("_g"), *aggregates)
    every = 2 ** len(keys) - 1
    return out.filter(F.col("_g").isin(0, every)).withColumns({k: F.when(F.col("_g") == every, total).otherwise(F.col(k).cast("string")) for k in keys}).drop("_g")
