"""Risk sets, person-periods, hazards and cumulative incidence, in one state or in several that items move through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadline.functions.columns import HAZARD_DAYS, after, seconds
from threadline.sources.stage import staged
from threadline.stats.resample import drawn_times


def follow_up(items: DataFrame, start: str, end: Column, horizon_days: float = 30.0) -> DataFrame:
    """Days from start to the earliest of end, close and horizon, never below 0."""
    until = F.least(end, F.col("closed_dt"))
    days = seconds(F.col(start), until) / 86400.0
    return items.withColumn("follow_days", F.greatest(F.lit(0.0), F.least(F.coalesce(days, F.lit(horizon_days)), F.lit(horizon_days))))


def person_periods(cohort: DataFrame, exposure_days: str, event_days: str, days: tuple[float, ...] = HAZARD_DAYS) -> DataFrame:
    """One row for each bin that an item enters under observation, with its exposure by then and whether its event falls there.

    The bins are a short literal array, so the expansion is a generator over
    each row and nothing is shuffled.
    """
    bins = F.array(*(F.struct(F.lit(i).alias("bin"), F.lit(lo).alias("low"), F.lit(hi).alias("high")) for i, (lo, hi) in enumerate(zip(days, days[1:], strict=False))))
    entered = F.filter(bins, lambda b: b["low"] < F.col("follow_days"))
    rows = cohort.withColumn("b", F.explode(entered))
    event = F.col(event_days)
    return rows.withColumns(
        {
            "bin": F.col("b.bin"),
            "exposed": F.coalesce(F.col(exposure_days) <= F.col("b.low"), F.lit(False)),
            "event": F.coalesce((event > F.col("b.low")) & (event <= F.col("b.high")) & (event <= F.col("follow_days")), F.lit(False)),
        }
    ).drop("b")


def hazards(periods: DataFrame, *keys: str) -> DataFrame:
    return periods.groupBy("bin", *keys).agg(F.count(F.lit(1)).alias("at_risk"), F.count_if("event").alias("events"), F.avg(F.col("event").cast("double")).alias("hazard"))


def cumulative_incidence(table: DataFrame, *keys: str) -> DataFrame:
    """1 less the running product of the hazards' complements."""
    w = Window.partitionBy(*(keys or (F.lit(0),))).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn("incidence", 1 - F.product(1 - F.col("hazard")).over(w))


def standardised_risk(table: DataFrame, exposure: str = "exposed") -> DataFrame:
    """Risk at the horizon had all, or none, been exposed in every bin."""
    return table.groupBy(exposure).agg((1 - F.product(1 - F.col("hazard"))).alias("risk"))


def incidence_on_grid(cohort: DataFrame, exposure_days: str, event_days: str, grid: list[float]) -> DataFrame:
    """Incidence in time-varying states on a grid: who is at risk in a cell by its state at the cell's start."""
    cells = list(zip(grid, grid[1:], strict=False))
    return cumulative_incidence(hazards(person_periods(cohort, exposure_days, event_days, tuple(x for x, _ in cells) + (grid[-1],)), "exposed"), "exposed")


def sequential_exposures(triggers: DataFrame, responses: DataFrame, bounds: list[tuple[float, float]], flag: Column) -> DataFrame:
    """For each (low, high] in hours whether a flagged response fell into it."""
    seen = responses.groupBy("pr_id").agg(*(F.bool_or(flag & (F.col("hours_after") > lo) & (F.col("hours_after") <= hi)).alias(f"in_{lo:g}_{hi:g}h") for lo, hi in bounds))
    names = [f"in_{lo:g}_{hi:g}h" for lo, hi in bounds]
    return triggers.join(seen, "pr_id", "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in names})


def merge_follow_up(triggers: DataFrame, cutoff: Column, horizon_days: int = 30) -> DataFrame:
    """merged: an event after the trigger within the horizon; follow_days: up to it, else to close, horizon or cutoff, from 0 to the horizon.

    The merge is read as it was recorded, so one later than the cutoff still counts.
    """
    horizon = after("trigger_dt", days=horizon_days)
    merged = F.coalesce((F.col("merged_dt") > F.col("trigger_dt")) & (F.col("merged_dt") <= horizon), F.lit(False))
    until = F.when(merged, F.col("merged_dt")).otherwise(F.least(F.coalesce("closed_dt", horizon), horizon, cutoff))
    days = seconds(F.col("trigger_dt"), until) / 86400.0
    return triggers.withColumns({"merged": merged, "follow_days": F.greatest(F.lit(0.0), F.least(days, F.lit(float(horizon_days))))})


def _cells_before(days: Column, grid: list[float]) -> Column:
    """How many cells of the grid start before so many days; cell i starts where cell i - 1 ends, and the first at 0. Null is never."""
    starts = F.array(*(F.lit(float(x)) for x in (0.0, *grid[:-1])))
    return F.when(days.isNull(), len(grid)).otherwise(F.size(F.filter(starts, lambda x: x < days)))


def risk_changes(cohort: DataFrame, steps: list[str], grid: list[float], cluster: str = "repo_id", follow: str = "follow_days", merged: str = "merged") -> DataFrame:
    """cluster, arm, cell, risk, events: by how much the risk set of an arm changes at a cell, and the events in it.

    An item is in arm k from the cell that starts at or after its step k; a later step outranks all earlier ones. Of an
    item only the begin and end of its stay in each arm and its event are rows, however fine the grid is.
    """
    n = F.col("_n")
    bounds = [F.lit(0)] + [F.least(n, *(F.col(f"_c{j}") for j in range(k, len(steps)))) for k in range(len(steps))] + [n]
    stays = list(zip(bounds, bounds[1:], strict=False))

    def change(arm: Column, cell: Column, risk: int, events: int) -> Column:
        return F.struct(arm.cast("int").alias("arm"), cell.cast("int").alias("cell"), F.lit(risk).alias("risk"), F.lit(events).alias("events"))

    rows = [F.when(lo < hi, change(F.lit(k), edge, risk, 0)) for k, (lo, hi) in enumerate(stays) for edge, risk in ((lo, 1), (hi, -1))]
    last = sum((F.when(lo < n, 1).otherwise(0) for lo, _ in stays[1:]), F.lit(0))
    rows.append(F.when(F.col(merged) & (n > 0), change(last, n - 1, 0, 1)))
    cells = cohort.select(F.col(cluster).alias("cluster"), merged, _cells_before(F.col(follow), grid).alias("_n"), *(_cells_before(F.col(s), grid).alias(f"_c{k}") for k, s in enumerate(steps)))
    each = cells.select("cluster", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull() & (r["cell"] < len(grid)))).alias("r"))
    return each.groupBy("cluster", "r.arm", "r.cell").agg(F.sum("r.risk").alias("risk"), F.sum("r.events").alias("events"))


def _curves(changes: DataFrame, base: DataFrame, states: dict[str, tuple[int, ...]], grid: list[float], *keys: str) -> DataFrame:
    """Incidence by state and cell; base has the keys whose curves are wanted, whole even where nothing changes."""
    of_arm = F.create_map(*(x for a in sorted({a for arms in states.values() for a in arms}) for x in (F.lit(a), F.array(*(F.lit(s) for s, arms in states.items() if a in arms)))))
    summed = changes.withColumn("state", F.explode(of_arm[F.col("arm")])).groupBy(*keys, "state", "cell").agg(F.sum("risk").alias("risk"), F.sum("events").alias("events"))
    whole = base.withColumn("state", F.explode(F.array(*map(F.lit, states)))).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))
    w = Window.partitionBy(*keys, "state").orderBy("cell")
    zero = F.lit(0).cast("bigint")
    counted = whole.join(summed, [*keys, "state", "cell"], "left").withColumn("events", F.coalesce("events", zero))
    at_risk = counted.withColumn("at_risk", F.sum(F.coalesce("risk", zero)).over(w))
    hazard = F.coalesce(F.try_divide(F.col("events").cast("double"), F.col("at_risk").cast("double")), F.lit(0.0))
    days = F.array(*(F.lit(float(x)) for x in grid))
    return at_risk.withColumn("incidence", 1 - F.product(1 - hazard).over(w)).select(*keys, "state", "cell", days[F.col("cell")].alias("days"), "at_risk", "events", "incidence")


def incidence_states(changes: DataFrame, states: dict[str, tuple[int, ...]], grid: list[float]) -> DataFrame:
    """state, cell, days, at_risk, events, incidence; states are unions of arms and may overlap."""
    return _curves(changes, changes.sparkSession.range(1).select(), states, grid)


def incidence_draws(changes: DataFrame, states: dict[str, tuple[int, ...]], grid: list[float], draws: int) -> DataFrame:
    """The same curves in each draw of whole clusters: a cluster is one row of its few changes, counted as often as it is drawn."""
    rows = changes.groupBy("cluster").agg(F.collect_list(F.struct("arm", "cell", "risk", "events")).alias("rows"))
    each = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("times", drawn_times(F.col("draw"), F.col("cluster")))
    drawn = each.filter("times > 0").select("draw", "times", F.inline("rows")).select("draw", "arm", "cell", (F.col("risk") * F.col("times")).alias("risk"), (F.col("events") * F.col("times")).alias("events"))
    base = changes.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw"))
    return _curves(drawn, base, states, grid, "draw")


def incidence_bands(changes: DataFrame, states: dict[str, tuple[int, ...]], grid: list[float], draws: int = 2000, level: float = 0.95) -> DataFrame:
    """state, cell, days, incidence with low and high: pointwise quantiles of the curves of all draws."""
    changes, tail = staged(changes), (1 - level) / 2
    drawn = incidence_draws(changes, states, grid, draws).groupBy("state", "cell").agg(F.percentile("incidence", F.lit(tail)).alias("low"), F.percentile("incidence", F.lit(1 - tail)).alias("high"))
    return incidence_states(changes, states, grid).join(drawn, ["state", "cell"]).select("state", "cell", "days", "incidence", "low", "high")


def band_overlap(bands: DataFrame, a: str, b: str, base: str, early_days: float = 7.0) -> DataFrame:
    """How two curves differ over the grid, with a third for scale, in one row: gaps in points, where bands part, until when base leads."""
    of = {k: F.max(F.when(F.col("state") == k, F.struct("incidence", "low", "high"))).alias(f"s{i}") for i, k in enumerate((a, b, base))}
    by_cell = bands.groupBy("cell", "days").agg(*of.values())
    x, y, z = F.col("s0.incidence"), F.col("s1.incidence"), F.col("s2.incidence")
    overlap = (F.col("s0.low") <= F.col("s1.high")) & (F.col("s1.low") <= F.col("s0.high"))
    gap, lead = (x - y) * 100.0, (z >= x) & (z >= y)
    end = F.max(F.struct("cell", ((y - x) * 100.0).alias("ab"), ((x - z) * 100.0).alias("za"), ((y - z) * 100.0).alias("zb"), (F.col("s2.high") < F.col("s0.low")).alias("below_a"), (F.col("s2.high") < F.col("s1.low")).alias("below_b")))
    return by_cell.agg(
        F.count(F.lit(1)).alias("cells"),
        F.min(gap).alias("min_gap"),
        F.max(gap).alias("max_gap"),
        F.count_if(gap > 0).alias("cells_above"),
        F.count_if(gap < 0).alias("cells_below"),
        F.count_if(overlap).alias("overlapping"),
        F.min(F.when(~overlap, F.col("days"))).alias("first_parted_days"),
        F.min(F.when(~lead, F.col("days"))).alias("base_leads_until_days"),
        F.max(F.abs(gap)).alias("max_abs_gap"),
        F.max(F.struct(F.abs(gap).alias("g"), (-F.col("days")).alias("d"))).alias("_at"),
        F.avg(F.abs(gap)).alias("mean_abs_gap"),
        F.max(F.when(F.col("days") <= early_days, F.abs(gap))).alias("max_abs_gap_early"),
        end.alias("_end"),
    ).select("*", (-F.col("_at.d")).alias("max_abs_gap_days"), F.col("_end.ab").alias("end_gap"), F.col("_end.za").alias("end_gap_base_a"), F.col("_end.zb").alias("end_gap_base_b"), F.col("_end.below_a").alias("base_below_a"), F.col("_end.below_b").alias("base_below_b")).drop("_at", "_end")
