"""Null models: anchors permuted within strata, times drawn anew, signs flipped, states reordered.

A draw is a number that joins a row by md5 of (draw, row), so every engine
draws the same. Rows are expanded by a generator and summed map-side by draw:
what reaches the driver is one row of sums for each draw. Null values of the
outcome or a control leave a row out; an empty table gives null estimates.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadline.sources.stage import staged


def hashed_unit(draw: Column, row: Column) -> Column:
    """A number in [0, 1) of a draw and a row: the first 32 bits of md5("draw:row")."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", draw.cast("string"), row.cast("string"))), 1, 8), 16, 10).cast("bigint") / float(1 << 32)


def _design(df: DataFrame, y: str, x: Column, controls: list[str], **more: Column) -> DataFrame:
    w = F.array(F.lit(1.0), *(F.col(c).cast("double") for c in controls))
    rows = df.select(F.col(y).cast("double").alias("y"), x.cast("double").alias("x"), w.alias("w"), *(c.alias(n) for n, c in more.items()))
    return rows.filter(F.col("y").isNotNull() & F.col("x").isNotNull() & F.forall("w", lambda v: v.isNotNull()))


def _moments(k: int) -> list[Column]:
    """Sums that a 0/1 exposure adds to the normal equations: its own, with each control, with the outcome."""
    on = F.col("on").cast("double")
    return [F.sum(on).alias("xx"), F.sum(on * F.col("y")).alias("xy"), *(F.sum(on * F.col("w")[i]).alias(f"x{i}") for i in range(k))]


def _estimates(rows: DataFrame, drawn: DataFrame, k: int) -> DataFrame:
    """draw, estimate: the exposure's coefficient beside the controls, from each draw's sums (partialling out)."""
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    base = rows.agg(*(F.sum(F.col("w")[i] * F.col("w")[j]) for i, j in pairs), *(F.sum(F.col("w")[i] * F.col("y")) for i in range(k))).first()
    spark, kind = rows.sparkSession, "draw bigint, estimate double"
    if base[0] is None:
        return spark.createDataFrame([], kind)
    a = np.zeros((k, k))
    for (i, j), v in zip(pairs, base, strict=False):
        a[i, j] = a[j, i] = v
    inverse, wy = np.linalg.pinv(a), np.array(base[len(pairs) :])
    out = []
    for r in drawn.orderBy("draw").collect():
        wx = np.array([r[f"x{i}"] for i in range(k)])
        left = r["xx"] - wx @ inverse @ wx
        out.append((r["draw"], float((r["xy"] - wx @ inverse @ wy) / left) if left > 1e-12 else None))
    return spark.createDataFrame(out, kind)


#: Ranges of the hashed rank by which rows are counted.
BINS = 256


def lowest_ranked(rows: DataFrame, draws: Column, rank: Column, place: Column, sums: dict[str, Column]) -> DataFrame:
    """draw and sums over the ``ones`` rows of lowest (rank, i) of each stratum s, in each draw. rows: s, i, ones and more.

    No stratum is sorted: rows are added up by ``place``, one of ``BINS`` ranges of the rank, map-side. Ranges below
    the last row that is wanted count whole; of the range it lies in alone, rows are ranked.
    """
    each = rows.withColumn("draw", F.explode(draws)).withColumn("place", place)
    parts = staged(each.groupBy("s", "draw", "place").agg(F.max("ones").alias("ones"), F.count(F.lit(1)).alias("n"), *(v.alias(k) for k, v in sums.items())))
    before = Window.partitionBy("s", "draw").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("need", F.col("ones") - F.coalesce(F.sum("n").over(before), F.lit(0)))
    cut = placed.filter("need > 0 and n > need").groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("draw", F.struct("place", "need")))).alias("cut"))
    split = rows.join(cut, "s").select(*rows.columns, F.explode("cut").alias("draw", "at")).filter(place == F.col("at.place"))
    turn = F.row_number().over(Window.partitionBy("s", "draw").orderBy(rank, "i"))
    some = split.withColumn("turn", turn).filter(F.col("turn") <= F.col("at.need")).groupBy("draw").agg(*(v.alias(k) for k, v in sums.items()))
    whole = placed.filter("n <= need").select("draw", *sums)
    return whole.unionByName(some).groupBy("draw").agg(*(F.sum(k).alias(k) for k in sums))


def permuted_anchors(df: DataFrame, y: str, anchored: str, eligible: Column, controls: list[str], stratum: str, row_id: str, draws: int = 200) -> DataFrame:
    """draw, estimate; draw 0 is observed. Which eligible rows are anchored is shuffled within strata.

    A stratum keeps its number of anchored rows; one with all or none of its
    eligible rows anchored keeps them as they are, and is added to every draw
    as one sum instead of being expanded.
    """
    k = len(controls) + 1
    rows = _design(df, y, F.col(anchored), controls, s=F.col(stratum), i=F.col(row_id), e=F.coalesce(eligible, F.lit(False)))
    sizes = rows.filter("e").groupBy("s").agg(F.sum("x").cast("bigint").alias("ones"), F.count(F.lit(1)).alias("n")).filter("ones > 0 and ones < n")
    loose = rows.filter("e").join(sizes.select("s", "ones"), "s")
    fixed = rows.join(sizes.select("s", F.lit(True).alias("varies")), "s", "left").filter("varies is null or not e").withColumn("on", F.col("x"))
    names = ["xx", "xy", *(f"x{i}" for i in range(k))]
    unit = hashed_unit(F.col("draw"), F.col("i"))
    every = F.sequence(F.lit(1).cast("bigint"), F.lit(draws).cast("bigint"))
    shuffled = lowest_ranked(loose.withColumn("on", F.lit(1.0)), every, unit, F.floor(unit * BINS), dict(zip(names, _moments(k), strict=True)))
    base = fixed.agg(*_moments(k)).withColumn("draw", F.explode(every))
    seen = rows.withColumn("on", F.col("x")).agg(*_moments(k)).withColumn("draw", F.lit(0).cast("bigint"))
    drawn = shuffled.unionByName(base).unionByName(seen).groupBy("draw").agg(*(F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names))
    return _estimates(rows, drawn, k)


def shifted_times(df: DataFrame, y: str, time: str, limit: float, controls: list[str], row_id: str, draws: int = 200) -> DataFrame:
    """draw, estimate; draw 0 is observed. Each row takes the time of a row drawn from all, missing times included.

    A drawn time is within the limit with the share of rows whose own is, and
    nothing else of it matters, so a draw compares a hash with that share.
    """
    k = len(controls) + 1
    rows = _design(df, y, F.coalesce(F.col(time) <= limit, F.lit(False)), controls, i=F.col(row_id))
    share = rows.agg(F.avg("x")).first()[0] or 0.0
    each = rows.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(draws).cast("bigint"))))
    on = F.when(F.col("draw") == 0, F.col("x") == 1).otherwise(hashed_unit(F.col("draw"), F.col("i")) < share)
    return _estimates(rows, each.withColumn("on", on).groupBy("draw").agg(*_moments(k)), k)


def null_summary(draws: DataFrame) -> DataFrame:
    """observed, null_mean, null_sd, low, high and a two-sided p of draws whose number 0 is observed."""
    seen = draws.agg(F.max(F.when(F.col("draw") == 0, F.col("estimate"))).alias("observed"))
    others = draws.filter("draw > 0 and estimate is not null").withColumn("one", F.lit(1)).join(F.broadcast(seen.withColumn("one", F.lit(1))), "one")
    beyond = F.count_if(F.abs("estimate") >= F.abs("observed"))
    return others.agg(
        F.max("observed").alias("observed"),
        F.avg("estimate").alias("null_mean"),
        F.stddev_samp("estimate").alias("null_sd"),
        F.percentile("estimate", F.lit(0.025)).alias("low"),
        F.percentile("estimate", F.lit(0.975)).alias("high"),
        ((beyond + 1) / (F.count(F.lit(1)) + 1)).alias("p"),
    )


def sign_flips(df: DataFrame, contrast: str, row_id: str, draws: int = 1000) -> DataFrame:
    """draw, estimate: the mean of contrasts whose signs are drawn anew; draw 0 is observed. Null and NaN contrasts don't count."""
    rows = df.select(F.col(contrast).cast("double").alias("v"), F.col(row_id).alias("i")).filter("v is not null and not isnan(v)")
    each = rows.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(draws).cast("bigint"))))
    kept = (F.col("draw") == 0) | (hashed_unit(F.col("draw"), F.col("i")) < 0.5)
    return each.groupBy("draw").agg(F.avg(F.when(kept, F.col("v")).otherwise(-F.col("v"))).alias("estimate"))


#: Rows of all draws that a task sorts.
TASK_ROWS = 2_000_000


def _drawn_by_item(rows: DataFrame, draws: int) -> DataFrame:
    """rows (item and more) once for each draw from 0 on, an item's draws where its rows are.

    Draws make rows many, but only where they are sorted: rows are written and dealt before that, to as many tasks
    as all draws need, since by the bytes that are dealt Spark would take far fewer.
    """
    whole = staged(rows)
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-whole.count() * (draws + 1) // TASK_ROWS))
    return whole.repartition(tasks, "item").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(draws).cast("bigint"))))


def reordered_transitions(df: DataFrame, item: str, order: str, state: str, draws: int = 100, end: str = "end") -> DataFrame:
    """state, next_state, observed share, mean and 95% limits of shares had each item's states come in any order."""
    rows = df.select(F.col(item).alias("item"), F.col(order).alias("o"), F.col(state).alias("state"))
    each = _drawn_by_item(rows, draws)
    at = F.when(F.col("draw") > 0, hashed_unit(F.col("draw"), F.concat_ws("/", F.col("item").cast("string"), F.col("o").cast("string")))).otherwise(F.lit(0.0))
    follows = F.coalesce(F.lead("state").over(Window.partitionBy("item", "draw").orderBy(at, "o")), F.lit(end))
    counts = each.withColumn("next_state", follows).groupBy("draw", "state", "next_state").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("draw", "state")))
    # a transition that a draw lacks has share 0 there
    mean = F.sum(F.when(F.col("draw") > 0, F.col("share")).otherwise(0.0)) / draws
    found = shares.groupBy("state", "next_state").agg(
        F.coalesce(F.max(F.when(F.col("draw") == 0, F.col("share"))), F.lit(0.0)).alias("observed"), mean.alias("placebo_mean"), F.collect_list(F.when(F.col("draw") > 0, F.col("share"))).alias("s")
    )
    filled = F.array_sort(F.concat("s", F.array_repeat(F.lit(0.0), F.lit(draws) - F.size("s"))))

    def quantile(q: float) -> Column:
        lo = int(q * (draws - 1))
        part = q * (draws - 1) - lo
        return F.get("f", F.lit(lo)) * (1 - part) + F.coalesce(F.get("f", F.lit(lo + 1)), F.lit(0.0)) * part

    out = found.withColumn("f", filled).withColumns({"low": quantile(0.025), "high": quantile(0.975), "difference": F.col("observed") - F.col("placebo_mean")})
    return out.select("state", "next_state", "observed", "placebo_mean", "low", "high", "difference")


#: What a step of automation may be followed by, and how many steps are told apart.
ESCALATIONS = ("user_account", "another_automation", "branch_movement_untyped", "no_later_episode")
MAX_STEP = 5


def walk_steps(rows: DataFrame, draws: int, max_step: int = MAX_STEP) -> DataFrame:
    """draw, step, outcome, n of sequences (item, o, state) up to their first person; draw 0 has them in order, others reshuffled.

    The steps of an item are its states of automation; a step is followed by whatever comes next. Draws order an item's
    rows by a hash, so sequences are sorted in Spark and never gathered.
    """
    each = _drawn_by_item(rows, draws)
    at = F.when(F.col("draw") > 0, hashed_unit(F.col("draw"), F.concat_ws("/", F.col("item").cast("string"), F.col("o").cast("string")))).otherwise(F.lit(0.0))
    turn = Window.partitionBy("item", "draw").orderBy(at, "o")
    so_far = turn.rowsBetween(Window.unboundedPreceding, 0)
    person, machine = F.col("state") == "user_account", F.col("state").isin("mapped_product", "other_bot")
    after = F.lead("state").over(turn)
    outcome = F.when(after.isNull(), ESCALATIONS[3]).when(after == "user_account", ESCALATIONS[0]).when(after.isin("mapped_product", "other_bot"), ESCALATIONS[1]).otherwise(ESCALATIONS[2])
    walked = each.withColumns({"step": F.sum(machine.cast("int")).over(so_far), "met": F.max(person.cast("int")).over(so_far), "outcome": outcome})
    return walked.filter(machine & (F.col("met") == 0) & (F.col("step") <= max_step)).groupBy("draw", "step", "outcome").agg(F.count(F.lit(1)).alias("n"))


def walk_order_placebo(df: DataFrame, item: str, order: str, state: str, draws: int = 1000, max_step: int = MAX_STEP) -> DataFrame:
    """step, outcome, at_risk, observed share, mean and 95% limits of the shares had each item's states come in any order, and the difference.

    A draw that has no item at risk at a step has no share there and does not count; one that only lacks the outcome has 0.
    """
    rows = df.select(F.col(item).alias("item"), F.col(order).alias("o"), F.col(state).alias("state")).filter("state is not null")
    counts = walk_steps(rows, draws, max_step)
    wide = counts.groupBy("draw", "step").agg(F.sum("n").alias("at_risk"), *(F.sum(F.when(F.col("outcome") == o, F.col("n")).otherwise(0)).alias(o) for o in ESCALATIONS))
    each = wide.select("draw", "step", "at_risk", F.inline(F.array(*(F.struct(F.lit(o).alias("outcome"), (F.col(o) / F.col("at_risk")).alias("share")) for o in ESCALATIONS))))
    drawn = F.when(F.col("draw") > 0, F.col("share"))
    out = each.groupBy("step", "outcome").agg(
        F.max(F.when(F.col("draw") == 0, F.col("at_risk"))).alias("at_risk"), F.max(F.when(F.col("draw") == 0, F.col("share"))).alias("observed"), F.avg(drawn).alias("placebo_mean"),
        F.percentile(drawn, F.lit(0.025)).alias("low"), F.percentile(drawn, F.lit(0.975)).alias("high"),
    )
    return out.withColumn("difference", F.col("observed") - F.col("placebo_mean")).withColumn("at_risk", F.coalesce("at_risk", F.lit(0).cast("bigint")))


def product_order(events: DataFrame, anchors: DataFrame, washouts: tuple[int, ...], item: str = "pr_id", time: str = "interaction_dt", product: str = "actor_agent") -> DataFrame:
    """item, washout_minutes, eligible, observed, expected: whether the next product after an anchor is the anchor's own, and how likely that was in any order.

    Had the later events come in any order, the first would be the anchor's product as often as its share of them is: no
    draws are needed. Next instants of several products are left out. anchors: item, anchor_dt, anchor_product and more.
    """
    later = events.select(item, F.col(time).alias("_t"), F.col(product).alias("_p")).filter("_p is not null")
    gates = anchors.select(item, "anchor_dt", "anchor_product", F.explode(F.array(*map(F.lit, washouts))).alias("washout_minutes"))
    met = gates.join(later, item).filter(F.col("_t") > F.timestamp_add("MINUTE", F.col("washout_minutes"), F.col("anchor_dt")))
    same = (F.col("_p") == F.col("anchor_product")).cast("int")
    by_time = met.groupBy(item, "washout_minutes", "_t").agg(F.count(F.lit(1)).alias("n"), F.sum(same).alias("k"), F.min("_p").alias("low"), F.max("_p").alias("high"))
    first = F.min(F.struct("_t", "n", "k", "low", "high")).alias("f")
    whole = by_time.groupBy(item, "washout_minutes").agg(first, F.sum("n").alias("eligible"), F.sum("k").alias("own"))
    alone = whole.filter("f.low = f.high")
    return alone.select(item, "washout_minutes", "eligible", (F.col("f.k") > 0).cast("double").alias("observed"), (F.col("own") / F.col("eligible")).alias("expected"))
