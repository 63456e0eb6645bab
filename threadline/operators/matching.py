"""Matching: nearest in time within exact strata, and nearest within a caliper, with and without replacement."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from threadline.sources.stage import staged


#: Controls of a stratum that one task settles at once, and ranges of time by which rows are ranked.
BLOCK, RANGES = 50_000, 64
#: Pairs within the caliper that one task may settle by turns.
FEW = 100_000


def ranked_in_strata(rows: DataFrame, ranges: int = RANGES) -> DataFrame:
    """stratum, arm, time, id, with how many controls and exposed rows of the stratum come before; no task has a whole stratum.

    Exposed rows come before controls of the same time. Rows are counted by ranges of time, whose bounds are
    quantiles; a range adds what the ranges before it have.
    """
    cuts = rows.agg(F.percentile_approx("time", [i / ranges for i in range(1, ranges)])).first()[0] or []
    placed = rows.withColumn("range", sum((F.coalesce(F.col("time") > F.lit(x), F.lit(False)).cast("int") for x in sorted(set(cuts))), F.lit(0)))
    sizes = placed.groupBy("stratum", "range").agg(F.count_if(~F.col("arm")).alias("c"), F.count_if("arm").alias("e"))
    before = Window.partitionBy("stratum").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("stratum")
    starts = sizes.select("stratum", "range", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}0") for x in ("c", "e")), F.sum("c").over(whole).alias("n_controls"))
    inside = Window.partitionBy("stratum", "range").orderBy("time", ~F.col("arm"), "id").rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.select("*", *(F.coalesce(F.sum(flag.cast("bigint")).over(inside), F.lit(0)).alias(f"{x}1") for x, flag in (("c", ~F.col("arm")), ("e", F.col("arm")))))
    return counted.join(starts, ["stratum", "range"]).select("stratum", "arm", "time", "id", (F.col("c0") + F.col("c1")).alias("controls_before"), (F.col("e0") + F.col("e1")).alias("exposed_before"), "n_controls")


_RECORD = ("stratum", "block", "id", "turn", "time", "low", "high", "low_time", "high_time", "held", "held_id", "held_time")


def _settle(own: pd.DataFrame, records: pd.DataFrame, block: int) -> list[tuple]:
    """One block's controls and who holds them, after all its visitors took turns; visitors who want another block's control leave.

    Turns only ascend within a call: who is displaced has a later turn. So a control held by an earlier turn stays
    out of reach for all that follow, and is stepped over for good.
    """
    time, ids = dict(zip(own["rank"], own["time"], strict=True)), dict(zip(own["rank"], own["id"], strict=True))
    inner = own.loc[own["block"] == own["home"], "rank"]
    first, last = (int(inner.min()), int(inner.max())) if len(inner) else (0, -1)
    rows = [dict(zip(records.columns, r, strict=True)) for r in records.itertuples(index=False, name=None)]
    hold = {int(r["held"]): r for r in rows if r["held"] >= 0}
    heap = [(r["turn"], k, r) for k, r in enumerate(rows) if r["held"] < 0]
    heapq.heapify(heap)
    skips: dict[int, dict[int, int]] = {1: {}, -1: {}}

    def reach(at: int, turn: int, way: int) -> int:
        skip, path = skips[way], []
        while first <= at <= last:
            if at in skip:
                path.append(at)
                at = skip[at]
            elif at in hold and hold[at]["turn"] < turn:
                path.append(at)
                skip[at] = at = at + way
            else:
                break
        for x in path:
            skip[x] = at
        return at

    out, count = [], len(rows)
    while heap:
        turn, _, r = heapq.heappop(heap)
        for name, way in (("low", -1), ("high", 1)):
            at = reach(r[name], turn, way)
            if at != r[name]:
                r[name], r[f"{name}_time"] = at, time.get(at)
        below = None if r["low_time"] is None else r["time"] - r["low_time"]
        above = None if r["high_time"] is None else r["high_time"] - r["time"]
        if below is None and above is None:
            continue
        target = r["high"] if below is None or (above is not None and above <= below) else r["low"]
        if first <= target <= last:
            former = hold.get(target)
            r["held"], r["held_id"], r["held_time"] = target, ids[target], time[target]
            hold[target] = r
            if former is not None:
                former["held"], former["held_id"] = -1, None
                count += 1
                heapq.heappush(heap, (former["turn"], count, former))
        else:
            r["block"] = target // block
            out.append(r)
    return [tuple(r[c] for c in records.columns) for r in (*hold.values(), *out)]


def nearest_without_replacement(df: DataFrame, strata: list[str], arm: str, time: str, row_id: str, block: int = BLOCK) -> DataFrame:
    """Each exposed row in order of time takes the nearest free other of its stratum; of two as near the later is taken.

    Turns and equal times are ordered by id. Taking turns is one by one, but its result is also that of offers: who is
    free asks for the nearest control that no earlier turn holds, and is displaced by an earlier turn. The order of
    offers does not matter, so each block of ``block`` neighbouring controls settles its visitors in a task of its own;
    those who look beyond its border visit the next block in the next round, which is written. Of n controls the
    first n turns all find one, so later exposed rows of a stratum stay without.
    Rows without a time or an arm take no part.
    """
    named = df.select(F.to_json(F.struct(*(F.col(s) for s in strata))).alias("stratum"), F.col(arm).alias("arm"), F.unix_micros(F.col(time).cast("timestamp")).alias("time"), F.col(row_id).alias("id"))
    ranked = staged(ranked_in_strata(named.filter("arm is not null and time is not null")))
    rank = F.col("controls_before")
    home = F.floor(rank / block)
    blocks = F.array_distinct(F.array(F.floor((rank - 1) / block), home, F.floor((rank + 1) / block)))
    own = staged(ranked.filter(~F.col("arm")).select("stratum", rank.alias("rank"), "time", "id", home.alias("home"), F.explode(blocks).alias("block")))
    times = ranked.filter(~F.col("arm")).select("stratum", rank.alias("at"), F.col("time").alias("t"))
    turns = ranked.filter(F.col("arm") & (F.col("exposed_before") < F.col("n_controls")))
    visits = turns.select("stratum", "id", F.col("exposed_before").alias("turn"), "time", (rank - 1).alias("low"), rank.alias("high"), "n_controls")
    for name in ("low", "high"):
        visits = visits.join(times.select("stratum", F.col("at").alias(name), F.col("t").alias(f"{name}_time")), ["stratum", name], "left")
    start = F.floor(F.least("high", F.col("n_controls") - 1) / block)
    none = F.lit(None)
    id_type = df.schema[row_id].dataType.simpleString()
    records = visits.select("stratum", start.alias("block"), "id", "turn", "time", "low", "high", "low_time", "high_time", F.lit(-1).cast("bigint").alias("held"), none.cast(id_type).alias("held_id"), none.cast("bigint").alias("held_time"))
    records = staged(records.select(*_RECORD))
    schema = records.schema

    def settle(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        def frame(t: pa.Table) -> pd.DataFrame:
            return pd.DataFrame({c: pd.Series(t.column(c).to_pylist(), dtype=object) for c in t.column_names})

        rows = _settle(frame(mine), frame(theirs), block)
        return pa.table({c: pa.array([r[k] for r in rows], theirs.schema.field(c).type) for k, c in enumerate(theirs.column_names)})

    while True:
        asked = records.filter("held < 0").select("stratum", "block").distinct()
        if asked.isEmpty():
            break
        busy = records.join(asked, ["stratum", "block"], "left_semi").select(*_RECORD)
        rest = records.join(asked, ["stratum", "block"], "left_anti").select(*_RECORD)
        settled = own.join(asked, ["stratum", "block"], "left_semi").groupBy("stratum", "block").cogroup(busy.groupBy("stratum", "block")).applyInArrow(settle, schema)
        records = staged(settled.unionByName(rest))
    return records.select(F.col("id").alias("exposed_id"), F.col("held_id").alias("control_id"), (F.abs(F.col("held_time") - F.col("time")) / 3.6e9).alias("gap_hours"))


def standardise(df: DataFrame, columns: list[str], cell: list[str]) -> DataFrame:
    """Each column less its mean over its population deviation in its cell; a constant column becomes 0. One row per cell is joined back."""
    moments = df.groupBy(*cell).agg(*(f(c).alias(f"{name}_{c}") for c in columns for name, f in (("mean", F.avg), ("sd", F.stddev_pop))))
    joined = df.alias("_d").join(moments.alias("_m"), [F.col(f"_d.{c}").eqNullSafe(F.col(f"_m.{c}")) for c in cell])
    return joined.select("_d.*", *(F.coalesce(F.try_divide(F.col(f"_d.{c}") - F.col(f"mean_{c}"), F.col(f"sd_{c}")), F.lit(0.0)).alias(f"z_{c}") for c in columns))


def pairs_in_caliper(exposed: DataFrame, controls: DataFrame, cell: list[str], columns: list[str], row_id: str, caliper: float) -> DataFrame:
    """cell, exposed_id, control_id, distance of all rows of one cell within the caliper of each other.

    Rows within the caliper lie in neighbouring boxes of a grid of that width, so an exposed row meets
    the boxes around its own: by up to three columns, 27 of them.
    """
    a = exposed.select(*cell, F.col(row_id).alias("exposed_id"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = controls.select(*cell, F.col(row_id).alias("control_id"), *(F.col(c).alias(f"b_{c}") for c in columns))
    boxes = []
    for k, c in enumerate(columns[:3]):
        place = F.floor(F.col(f"a_{c}") / caliper)
        a = a.withColumn(f"_box{k}", F.explode(F.array(place - 1, place, place + 1)))
        b = b.withColumn(f"_box{k}", F.floor(F.col(f"b_{c}") / caliper))
        boxes.append(f"_box{k}")
    squares = sum((F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), F.lit(2)) for c in columns), F.lit(0.0))
    joined = a.join(b, [*cell, *boxes]).withColumn("distance", F.sqrt(squares))
    return joined.filter((F.col("distance") <= caliper) & (F.col("exposed_id") != F.col("control_id"))).select(*cell, "exposed_id", "control_id", "distance")


def nearest_in_caliper(exposed: DataFrame, controls: DataFrame, cell: list[str], columns: list[str], row_id: str, caliper: float) -> DataFrame:
    """For each exposed row the other row of its cell at the least Euclidean distance, if within the caliper; controls may serve again."""
    pairs = pairs_in_caliper(exposed, controls, cell, columns, row_id, caliper)
    # The least is kept while pairs are made: no window over all pairs of a cell.
    best = pairs.groupBy(*cell, "exposed_id").agg(F.min(F.struct("distance", "control_id")).alias("b"))
    return best.select(*cell, "exposed_id", F.col("b.control_id").alias("control_id"), F.col("b.distance").alias("distance"))


def take_turns(pairs: DataFrame, few: int | None = None) -> DataFrame:
    """turn, exposed_id, control_id, distance when exposed rows in order of their turns each take the nearest control that is free.

    In a round each exposed row asks for its nearest control among those that no earlier turn holds, and a control keeps
    the earliest turn that asks; pairs with a later turn than the keeper's go. When every asker is kept, that is the
    result of taking turns, whatever happened in which round. Rounds are written. Once at most ``few`` pairs are left one
    task takes the turns; the result is the same. Turns (of any type that has an order) belong to one exposed row each;
    equal distances are ordered by control.
    """
    few = FEW if few is None else few
    names = ["turn", "exposed_id", "control_id", "distance"]
    live = staged(pairs.select(*names))
    arrow = to_arrow_schema(live.schema)

    def by_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches, arrow)
        turns, controls = whole["turn"].to_pylist(), whole["control_id"].to_pylist()
        keys = [tuple(t.values()) if isinstance(t, dict) else t for t in turns]
        served, taken, chosen = set(), set(), []
        for t, _, control, k in sorted(zip(keys, whole["distance"].to_pylist(), controls, range(len(keys)), strict=True)):
            if t not in served and control not in taken:
                served.add(t)
                taken.add(control)
                chosen.append(k)
        yield from whole.take(pa.array(chosen, pa.int64())).to_batches()

    n = live.count()
    while n > few:
        asked = live.groupBy("turn").agg(F.min(F.struct("distance", "control_id")).alias("want"))
        kept = asked.groupBy(F.col("want.control_id").alias("control_id")).agg(F.min("turn").alias("keeper"))
        reachable = F.col("keeper").isNull() | (F.col("turn") <= F.col("keeper"))
        live = staged(live.join(kept, "control_id", "left").filter(reachable).select(*names))
        left = live.count()
        if left == n:
            best = live.groupBy("turn").agg(F.min(F.struct("distance", "control_id", "exposed_id")).alias("b"))
            return best.select("turn", "b.exposed_id", "b.control_id", "b.distance")
        n = left
    return live.coalesce(1).mapInArrow(by_turns, live.schema)


def match_in_caliper(exposed: DataFrame, controls: DataFrame, cell: list[str], columns: list[str], row_id: str, caliper: float, order: list[str] | None = None) -> DataFrame:
    """Without replacement: exposed rows by cell, ``order`` and id each take the nearest control within the caliper that is free.

    A control that is in several cells serves once over all of them, as does an exposed row in each.
    """
    keys = [*cell, *(order or [])]
    turns = exposed.select(*cell, F.col(row_id).alias("exposed_id"), F.struct(*(F.col(c) for c in keys), F.col(row_id).alias("_id")).alias("turn"))
    pairs = pairs_in_caliper(exposed, controls, cell, columns, row_id, caliper).join(turns, [*cell, "exposed_id"])
    return take_turns(pairs).select(*(F.col(f"turn.{c}").alias(c) for c in cell), "exposed_id", "control_id", "distance")


def paired_differences(pairs: DataFrame, outcomes: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """Exposed less control for each pair and outcome."""
    a = outcomes.select(F.col(row_id).alias("exposed_id"), *(F.col(c).cast("double").alias(f"a_{c}") for c in columns))
    b = outcomes.select(F.col(row_id).alias("control_id"), *(F.col(c).cast("double").alias(f"b_{c}") for c in columns))
    joined = pairs.join(a, "exposed_id").join(b, "control_id")
    rows = F.array(*(F.struct(F.lit(c).alias("outcome"), (F.col(f"a_{c}") - F.col(f"b_{c}")).alias("difference")) for c in columns))
    return joined.select("exposed_id", "control_id", F.explode(rows).alias("x")).select("exposed_id", "control_id", "x.*")


def concordance(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs where both, one, the other, or neither has the outcome."""
    x, y = F.col(a), F.col(b)
    return pairs.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_exposed"), F.count_if(~x & y).alias("only_control"), F.count_if(~x & ~y).alias("neither"))


def reachability(pairs: DataFrame, a: str, b: str, reachable: str) -> DataFrame:
    """For each two positions of a pair's sides: pairs, their share, and whether both sides are where the outcome can be at all."""
    grid = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("pairs"))
    total = grid.agg(F.sum("pairs").alias("_all"))
    return grid.crossJoin(F.broadcast(total)).select(a, b, "pairs", ((F.col(a) == reachable) & (F.col(b) == reachable)).alias("both_can_ever_fire"), (F.col("pairs") / F.col("_all")).alias("share"))


def outcome_safety(pairs: DataFrame, outcomes: dict[str, str], blind: str, anchored: str, others: list[str]) -> DataFrame:
    """For each outcome (a counter on both sides, ``a_`` and ``b_``): positives on sides that are blind to the anchor, and pairs' sides whose only evidence is the anchored counter."""
    def side(s: str) -> dict[str, Column]:
        none = F.lit(True)
        for o in others:
            none = none & (F.col(f"{s}_{o}") == 0)
        only = F.count_if((F.col(f"{s}_{anchored}") > 0) & none)
        return {k: F.count_if((F.col(f"{s}_{v}") > 0) & F.col(f"{s}_{blind}")) for k, v in outcomes.items()} | {"_only": only}

    a, b = side("a"), side("b")
    row = pairs.agg(*(x.alias(f"a_{k}") for k, x in a.items()), *(x.alias(f"b_{k}") for k, x in b.items()))
    rows = F.array(*(F.struct(F.lit(k).alias("outcome"), F.col(f"a_{k}").alias("blind_positives_a"), F.col(f"b_{k}").alias("blind_positives_b"), F.col("a__only").alias("only_anchored_a"), F.col("b__only").alias("only_anchored_b")) for k in outcomes))
    return row.select(F.inline(rows))


def balance(df: DataFrame, arm: str, columns: list[str], weight: str | None = None) -> DataFrame:
    """Means of both arms and their standardised difference for each column."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = F.array(*(F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("v")) for c in columns))
    long = df.select(F.col(arm).alias("arm"), w.alias("w"), F.explode(rows).alias("x")).select("arm", "w", "x.*")
    def mean(flag):
        return F.sum(F.when(flag, F.col("w") * F.col("v"))) / F.sum(F.when(flag, F.col("w")))
    out = long.groupBy("covariate").agg(
        mean(~F.col("arm")).alias("mean0"), mean(F.col("arm")).alias("mean1"),
        F.var_samp(F.when(~F.col("arm"), F.col("v"))).alias("var0"), F.var_samp(F.when(F.col("arm"), F.col("v"))).alias("var1"),
    )
    return out.withColumn("smd", F.try_divide(F.col("mean1") - F.col("mean0"), F.sqrt((F.col("var0") + F.col("var1")) / 2)))


def effective_size(df: DataFrame, weight: str, *keys: str) -> DataFrame:
    w = F.col(weight)
    return df.groupBy(*keys).agg((F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_n"))
