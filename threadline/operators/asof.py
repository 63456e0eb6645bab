"""Strict and non-strict as-of joins as one sort by key.

Both sides are stacked and each left row takes the nearest right row before (or
after) it in a window: one exchange on the key, one sort, no inequality join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadline.sources.stage import staged


def asof_join(
    left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: list[str], columns: list[str],
    direction: str = "backward", strict: bool = True, prefix: str = "prior_", tie: list[str] | None = None, ranges: int = 0,
) -> DataFrame:
    """Every left row with prefixed ``columns`` of its nearest right row, or nulls.

    Strict leaves out equal times. Right rows with equal times are ordered by
    ``tie``: backward takes the last, forward the first. A left row without a
    time, and right rows without one, match nothing.

    With ``ranges``, a key's rows are dealt by so many ranges of time (quantiles), so that a busy key is no single
    task: a row that finds nothing in its range takes the nearest event of the ranges before (or after) it, which is one
    row per key and range.
    """
    taken = F.struct(*(F.col(x).alias(x) for x in columns))
    none = F.lit(None)
    event = right.filter(F.col(right_time).isNotNull()).select(
        *by, F.col(right_time).alias("_ts"), F.lit(1).alias("_side"), F.struct(*(F.col(t) for t in (tie or columns))).alias("_tie"), taken.alias("_event"), none.alias("_row")
    )
    row = F.struct(*(F.col(x) for x in left.columns))
    query = left.filter(F.col(left_time).isNotNull()).select(*by, F.col(left_time).alias("_ts"), F.lit(0).alias("_side"), none.alias("_tie"), none.alias("_event"), row.alias("_row"))
    both = query.unionByName(event)
    backward = direction == "backward"
    parts = [*by]
    if ranges:
        both, parts = _in_ranges(both, right, right_time, ranges), [*by, "_range"]
    # At equal times a strict search must not pass the events: going backward queries come first, going forward last.
    query_first = strict == backward
    side = F.col("_side") if query_first else -F.col("_side")
    # Forward reads the rows the other way round: a frame that grows is kept up, one that shrinks is read anew for every row.
    order = [x if backward else x.desc() for x in (F.col("_ts"), side, F.col("_tie"))]
    window = Window.partitionBy(*parts).orderBy(*order)
    found = F.last("_event", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    matched = both.withColumn("_found", found).filter("_side = 0")
    if ranges:
        matched = matched.alias("_m").join(_carried(both, by, backward).alias("_c"), [F.col(f"_m.{k}").eqNullSafe(F.col(f"_c.{k}")) for k in parts], "left")
        matched = matched.select("_m._row", F.coalesce("_m._found", "_c._carried").alias("_found"))
    out = matched.select("_row.*", *(F.col(f"_found.{x}").alias(f"{prefix}{x}") for x in columns))
    missing = left.filter(F.col(left_time).isNull()).select("*", *(F.lit(None).cast(right.schema[x].dataType).alias(f"{prefix}{x}") for x in columns))
    return out.unionByName(missing)


def _in_ranges(both: DataFrame, right: DataFrame, time: str, ranges: int) -> DataFrame:
    """Rows with the number of their range of time; equal times share one."""
    micros = F.unix_micros(F.col(time).cast("timestamp")) if dict(right.dtypes)[time].startswith(("timestamp", "date")) else F.col(time)
    cuts = right.agg(F.percentile_approx(micros, [i / ranges for i in range(1, ranges)])).first()[0] or []
    at = F.unix_micros(F.col("_ts").cast("timestamp")) if dict(both.dtypes)["_ts"].startswith(("timestamp", "date")) else F.col("_ts")
    return both.withColumn("_range", sum(((at > F.lit(x)).cast("int") for x in sorted(set(cuts))), F.lit(0)))


def _carried(both: DataFrame, by: list[str], backward: bool) -> DataFrame:
    """For each key and range that has rows, the last event of the key's ranges before it (going forward: the first of those after it)."""
    event = F.when(F.col("_side") == 1, F.struct("_ts", "_tie", "_event"))
    ends = both.groupBy(*by, "_range").agg((F.max(event) if backward else F.min(event)).alias("_end"))
    turn = Window.partitionBy(*by).orderBy("_range" if backward else F.desc("_range"))
    end = F.last("_end", ignorenulls=True).over(turn.rowsBetween(Window.unboundedPreceding, -1))
    return ends.select(*by, "_range", end["_event"].alias("_carried"))


def tie_counts(df: DataFrame, keys: list[str], name: str = "tie_n") -> DataFrame:
    """How many rows share each row's keys."""
    return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def running_sum(df: DataFrame, order: str, value: str, name: str, ranges: int = 64) -> DataFrame:
    """df with the sum of ``value`` over all rows of smaller ``order``, whose values are distinct, without one task for all rows.

    Rows are numbered by range of ``order`` (quantiles, so ranges are even unless
    one value is frequent: aggregate by it first); each range adds up its own
    rows and what the ranges before it sum to, of which there are ``ranges`` at most.
    """
    cuts = df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)])).first()[0] or []
    placed = df.withColumn("_range", sum((F.coalesce(F.col(order) > F.lit(x), F.lit(False)).cast("int") for x in sorted(set(cuts))), F.lit(0)))
    sums = placed.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(starts), "_range")
    return out.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("_start")).drop("_range", "_start")


def ranked(df: DataFrame, order: list[Column], name: str = "place", ranges: int = 64) -> DataFrame:
    """df with each row's place, from 1 on, in a total order of all rows, without one task for all rows.

    Rows are dealt by ranges of the order and written, so that a range is what it was when it was counted; each range
    numbers its own rows after those of the ranges before it, of which there are ``ranges`` at most.
    """
    dealt = staged(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order)
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.row_number().over(inside) + F.col("_start")).drop("_range", "_start")


def ntile(place: Column, n: Column, tiles: int) -> Column:
    """The tile from 1 on of a place from 1 on among n rows: the first tiles have one row more where n does not divide."""
    size, more = F.floor(n / tiles), n % tiles
    wide = more * (size + 1)
    return F.when(place <= wide, F.floor((place - 1) / (size + 1)) + 1).otherwise(more + F.floor((place - 1 - wide) / F.greatest(size, F.lit(1))) + 1).cast("bigint")
