"""Bursts, sessions and state sequences of an item's events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadline.functions.columns import NO_ACTION, STATES, after, any_, seconds, state_priority


def first_states(triggers: DataFrame, responses: DataFrame, thresholds: list[int], state: str = "state") -> DataFrame:
    """For each threshold (minutes) the state of the first event later than that after the trigger; at one instant the best by precedence.

    Events are brought to instants once and all thresholds are one aggregation over them, however many there are.
    """
    at = responses.groupBy("pr_id", "interaction_dt").agg(
        F.min("trigger_dt").alias("_from"), F.min(state_priority(state)).alias("p"), F.count(F.lit(1)).alias("n_events"), F.count_distinct(state).alias("n_states")
    )
    instant = F.struct("interaction_dt", "p", "n_events", "n_states")
    firsts = at.groupBy("pr_id").agg(*(F.min(F.when(F.col("interaction_dt") > after("_from", minutes=m), instant)).alias(f"_f{i}") for i, m in enumerate(thresholds)))
    each = F.array(*(F.struct(F.lit(m).alias("threshold_minutes"), F.col(f"_f{i}").alias("f")) for i, m in enumerate(thresholds)))
    names = F.array(*map(F.lit, STATES))
    return triggers.join(firsts, "pr_id", "left").select("pr_id", "repo_id", "trigger_dt", F.inline(each)).select(
        "threshold_minutes",
        "pr_id",
        "repo_id",
        F.coalesce(F.try_element_at(names, F.col("f.p") + 1), F.lit(NO_ACTION)).alias("first_state"),
        (seconds("trigger_dt", "f.interaction_dt") / 60.0).alias("minutes_from_trigger"),
        F.coalesce("f.n_events", F.lit(0).cast("bigint")).alias("n_events"),
        F.coalesce("f.n_states", F.lit(0).cast("bigint")).alias("n_states"),
    )


def state_shares(states: DataFrame) -> DataFrame:
    """Count and share of every state at every threshold, absent states with 0."""
    dims = states.select("threshold_minutes").distinct().withColumn("first_state", F.explode(F.array(*map(F.lit, (*STATES, NO_ACTION)))))
    n = states.groupBy("threshold_minutes", "first_state").agg(F.count(F.lit(1)).alias("n"))
    filled = dims.join(n, ["threshold_minutes", "first_state"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    total = F.sum("n").over(Window.partitionBy("threshold_minutes"))
    return filled.withColumn("share", F.col("n") / total)


def migration(states: DataFrame, start: int, end: int) -> DataFrame:
    """How items move between states from one threshold to another."""
    a = states.filter(F.col("threshold_minutes") == start).select("pr_id", F.col("first_state").alias("from_state"))
    b = states.filter(F.col("threshold_minutes") == end).select("pr_id", F.col("first_state").alias("to_state"))
    return a.join(b, "pr_id").groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


def leave_one_group_out(df: DataFrame, group: str, label: str) -> DataFrame:
    """Shares of each label with each group left out: totals less the group's, without refits."""
    n = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    groups, labels = n.select(group).distinct(), n.groupBy(label).agg(F.sum("n").alias("total_n"))
    sizes = n.groupBy(group).agg(F.sum("n").alias("group_n"))
    total = labels.withColumn("all_n", F.sum("total_n").over(Window.partitionBy(F.lit(0))))
    names = total.groupBy(F.lit(0).alias("one")).agg(F.collect_list(F.struct(label, "total_n", "all_n")).alias("labels"))
    grid = groups.withColumn("one", F.lit(0)).join(F.broadcast(names), "one").select(group, F.explode("labels").alias("x")).select(group, "x.*")
    filled = grid.join(n, [group, label], "left").join(sizes, group)
    left = F.col("total_n") - F.coalesce("n", F.lit(0))
    return filled.select(group, label, F.try_divide(left.cast("double"), (F.col("all_n") - F.col("group_n")).cast("double")).alias("share_without"))


def leave_one_out_range(loo: DataFrame, group: str, label: str) -> DataFrame:
    """For each label the least and greatest share, and the groups whose absence gives them."""
    order = F.struct("share_without", group)
    return loo.groupBy(label).agg(F.min("share_without").alias("low"), F.max("share_without").alias("high"), F.min(order)[group].alias("low_without"), F.max(order)[group].alias("high_without"))


def episodes(events: DataFrame, gap_minutes: float, key: str = "pr_id", time: str = "interaction_dt", tie: str = "event_id") -> DataFrame:
    """Each event with its episode: a new one begins where more than the gap has passed, in whole seconds."""
    order = Window.partitionBy(key).orderBy(time, tie)
    new = F.coalesce(seconds(F.lag(time).over(order), F.col(time)) > gap_minutes * 60, F.lit(True))
    marked = events.withColumn("_new", new.cast("int"))
    return marked.withColumn("episode", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def episode_states(marked: DataFrame, key: str = "pr_id", time: str = "interaction_dt") -> DataFrame:
    """One row per episode: its span, size and best state."""
    names = F.array(*map(F.lit, STATES))
    out = marked.groupBy(key, "episode").agg(F.min(time).alias("start_dt"), F.max(time).alias("end_dt"), F.count(F.lit(1)).alias("n_events"), F.min(state_priority("state")).alias("p"))
    return out.withColumn("state", F.element_at(names, F.col("p") + 1)).drop("p")


def next_states(rows: DataFrame, key: str = "pr_id", order: str = "start_dt") -> DataFrame:
    window = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("next_state", F.coalesce(F.lead("state").over(window), F.lit("end")))


def next_shares(rows: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.groupBy("state", "next_state").agg(n.alias("n"), (n / F.sum(n).over(Window.partitionBy("state"))).alias("share"))


def automation_walks(rows: DataFrame, depth: int = 4, key: str = "pr_id", order: str = "start_dt", person: str = STATES[0]) -> DataFrame:
    """Episodes before an item's first one by a person, at most ``depth``, with what came next."""
    window = Window.partitionBy(key).orderBy(order)
    so_far = F.max((F.col("state") == person).cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0))
    step = F.row_number().over(window)
    walked = rows.withColumns({"seen": so_far, "step": step, "next_state": F.coalesce(F.lead("state").over(window), F.lit("end"))})
    return walked.filter((F.col("seen") == 0) & (F.col("step") <= depth)).drop("seen")


def next_owner(events: DataFrame, anchors: DataFrame, washouts: list[int], state: str = "state") -> DataFrame:
    """For each anchor and washout the best state at the first instant later than the washout."""
    names = F.array(*map(F.lit, STATES))
    each = anchors.withColumn("washout_minutes", F.explode(F.array(*map(F.lit, washouts))))
    joined = each.join(events.select("pr_id", "interaction_dt", state), "pr_id").filter(F.timestamp_diff("SECOND", F.col("anchor_dt"), F.col("interaction_dt")) > F.col("washout_minutes") * 60)
    at = joined.groupBy("pr_id", "washout_minutes", "interaction_dt").agg(F.min(state_priority(state)).alias("p"))
    first = at.groupBy("pr_id", "washout_minutes").agg(F.min(F.struct("interaction_dt", "p")).alias("f"))
    return each.join(first, ["pr_id", "washout_minutes"], "left").select("pr_id", "washout_minutes", "anchor_dt", F.coalesce(F.try_element_at(names, F.col("f.p") + 1), F.lit("none")).alias("next_state"))


def action_key() -> Column:
    """A review's rows are one action; any other event is one by itself, and without an id it is told by time and account."""
    movement = F.concat(F.lit("movement:"), F.unix_micros(F.col("interaction_dt").cast("timestamp")).cast("string"), F.lit(":"), F.coalesce(F.lower(F.trim("actor_login")), F.lit("")))
    return F.coalesce(F.concat(F.lit("review:"), F.col("review_id").cast("string")), F.concat(F.col("source"), F.lit(":"), F.col("event_id").cast("string")), movement)


def debatch(events: DataFrame, batch: Column, owner: str = "owner") -> DataFrame:
    """Rows of one logical action as one: its first owner by time, its span and its sources."""
    order = F.struct("interaction_dt", "event_id")
    return events.groupBy("pr_id", batch.alias("action")).agg(
        F.min("interaction_dt").alias("action_dt"),
        F.min_by(owner, order).alias("owner"),
        F.count(F.lit(1)).alias("n_rows"),
        F.array_join(F.sort_array(F.collect_set("source")), "|").alias("sources"),
    )


def timestamp_states(actions: DataFrame, several: str = "simultaneous") -> DataFrame:
    """Actions of one second as one state; several owners are one of their own."""
    at = actions.groupBy("pr_id", F.date_trunc("second", "action_dt").cast("timestamp_ntz").alias("at_dt")).agg(F.count(F.lit(1)).alias("n_actions"), F.min("owner").alias("low"), F.max("owner").alias("high"))
    return at.select("pr_id", "at_dt", "n_actions", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(several).alias("owner"), (F.col("low") != F.col("high")).alias("ambiguous"))


def bounces(states: DataFrame, order: str = "at_dt") -> DataFrame:
    """First and second state of each item, whether the first owner stays, comes back or never does."""
    window = Window.partitionBy("pr_id").orderBy(order)
    placed = states.withColumns({"n": F.row_number().over(window), "first_owner": F.first("owner").over(window)})
    return placed.groupBy("pr_id", "first_owner").agg(
        F.max(F.when(F.col("n") == 2, F.col("owner"))).alias("second_owner"),
        any_((F.col("n") > 1) & (F.col("owner") == F.col("first_owner"))).alias("returns"),
        any_(F.col("owner") != F.col("first_owner")).alias("leaves"),
        F.count(F.lit(1)).alias("n_states"),
    )


def gap_histogram(gaps: DataFrame, low: float, high: float, bins: int, gap: str = "gap_minutes") -> DataFrame:
    """Log-spaced bins of positive gaps: count, share and cumulative share."""
    x = F.log10(gap)
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((x - low) / ((high - low) / bins)).cast("int")))
    n = F.count(F.lit(1))
    counted = gaps.filter(F.col(gap) > 0).groupBy(place.alias("bin")).agg(n.alias("n"))
    every = Window.partitionBy(F.lit(0))
    total = F.sum("n").over(every)
    return counted.withColumns({"share": F.col("n") / total, "cumulative": F.sum("n").over(every.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / total})


def hazard_by_bin(histogram: DataFrame) -> DataFrame:
    """Of what has lasted to a bin, the share that ends in it."""
    later = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    return histogram.withColumn("at_risk", F.sum("n").over(later)).withColumn("hazard", F.col("n") / F.col("at_risk"))


def best_split(histogram: DataFrame, y: str, x: str = "bin") -> DataFrame:
    """The bin where cutting the curve in two leaves the least squared error, by prefix sums."""
    w = Window.partitionBy(F.lit(0)).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(0))
    v = F.col(y)
    sums = histogram.withColumns({"k": F.count(F.lit(1)).over(w), "s": F.sum(v).over(w), "q": F.sum(v * v).over(w), "kk": F.count(F.lit(1)).over(every), "ss": F.sum(v).over(every), "qq": F.sum(v * v).over(every)})
    left = F.col("q") - F.col("s") * F.col("s") / F.col("k")
    rest = F.col("ss") - F.col("s")
    right = F.col("qq") - F.col("q") - rest * rest / (F.col("kk") - F.col("k"))
    cut = sums.filter("k < kk").withColumn("sse", left + right)
    return cut.agg(F.min(F.struct(F.col("sse"), F.col(x).alias("split"))).alias("b")).select("b.split", "b.sse")
