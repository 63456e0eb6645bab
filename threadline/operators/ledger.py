"""Transition ledgers over work items: onsets, predecessors, streaks, successors, event studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadline.functions.columns import after, all_, hours, rate, transition_type, valid_resolution
from threadline.operators.asof import asof_join, first_rows, tie_counts


def group_summary(items: DataFrame, key: str = "repo_id") -> DataFrame:
    return items.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_items"), F.count_distinct("agent").alias("n_agents"), F.min("created_dt").alias("first_dt"), F.max("created_dt").alias("last_dt"), rate(F.col("merged_dt").isNotNull()).alias("merge_rate")
    )


def second_agent_onset(items: DataFrame, key: str = "repo_id") -> DataFrame:
    """When a group first sees a second distinct agent: the second least of the agents' first times."""
    seen = items.groupBy(key, "agent").agg(F.min("created_dt").alias("seen_dt"))
    order = Window.partitionBy(key).orderBy("seen_dt", "agent")
    return seen.withColumn("n", F.row_number().over(order)).filter("n = 2").select(key, F.col("seen_dt").alias("onset_dt"))


def resolved_events(items: DataFrame, key: str = "repo_id") -> DataFrame:
    """Resolved items with the time their outcome is known, without those that share it in their group."""
    known = items.filter(valid_resolution()).withColumn("known_dt", F.greatest("closed_dt", "merged_dt"))
    return tie_counts(known, [key, "known_dt"]).filter("tie_n = 1").drop("tie_n")


def transitions(items: DataFrame, mature_until: Column, follow_days: int = 30, key: str = "repo_id") -> DataFrame:
    """Each item after its group's onset with the latest item resolved strictly before it; each predecessor counts once."""
    onset = second_agent_onset(items, key)
    current = items.filter(F.col("created_dt") <= mature_until).join(onset, key).filter("created_dt >= onset_dt").drop("onset_dt")
    prior = tie_counts(items.filter(valid_resolution()), [key, "closed_dt"], "close_tie_n").withColumn("merged", F.col("merged_dt").isNotNull())
    joined = asof_join(current, prior, "created_dt", "closed_dt", [key], ["pr_id", "agent", "user_id", "closed_dt", "merged_dt", "merged", "close_tie_n"], tie=["pr_id"])
    usable = joined.filter("prior_pr_id is not null and prior_pr_id <> pr_id and prior_close_tie_n = 1 and (prior_merged_dt is null or prior_merged_dt < created_dt)")
    once = first_rows(usable, ["prior_pr_id"], [F.col("created_dt"), F.col("pr_id")])
    return once.withColumns(
        {
            "switched": F.col("agent") != F.col("prior_agent"),
            "same_user": F.col("user_id") == F.col("prior_user_id"),
            "gap_hours": hours("prior_closed_dt", "created_dt"),
            "merged_in_time": F.coalesce(F.col("merged_dt") <= after("created_dt", days=follow_days), F.lit(False)),
            "calendar_month": F.date_format("created_dt", "yyyy-MM"),
        }
    ).withColumn("transition_type", transition_type())


def transition_matrix(ledger: DataFrame) -> DataFrame:
    total = F.sum(F.count(F.lit(1))).over(Window.partitionBy(F.lit(0)))
    return ledger.groupBy("prior_agent", "agent").agg(F.count(F.lit(1)).alias("n"), rate(F.col("merged_in_time")).alias("rate"), (F.count(F.lit(1)) / total).alias("share"))


def paired_by_group(ledger: DataFrame, key: str, flag: str, outcome: str, least: int = 2) -> DataFrame:
    """Rates of both arms side by side for the groups that have enough of each, and their difference."""
    wide = ledger.groupBy(key).pivot(flag, [False, True]).agg(F.count(F.lit(1)).alias("n"), rate(F.col(outcome)).alias("rate"))
    wide = wide.withColumnsRenamed({"false_n": "n0", "false_rate": "rate0", "true_n": "n1", "true_rate": "rate1"})
    return wide.filter((F.col("n0") >= least) & (F.col("n1") >= least)).withColumn("difference", F.col("rate1") - F.col("rate0"))


def within_strata(df: DataFrame, strata: list[str], flag: str, outcome: str) -> DataFrame:
    """Strata that have both arms, the difference of their rates and a harmonic weight."""
    arms = df.groupBy(*strata).agg(
        F.count_if(~F.col(flag)).alias("n0"), F.count_if(F.col(flag)).alias("n1"),
        F.avg(F.when(~F.col(flag), F.col(outcome).cast("double"))).alias("rate0"), F.avg(F.when(F.col(flag), F.col(outcome).cast("double"))).alias("rate1"),
    )
    both = arms.filter("n0 > 0 and n1 > 0")
    return both.withColumns({"weight": 2.0 / (1.0 / F.col("n0") + 1.0 / F.col("n1")), "difference": F.col("rate1") - F.col("rate0")})


def event_study(items: DataFrame, width: int = 10, key: str = "repo_id") -> DataFrame:
    """Rate of merging by place relative to the first item after a group's onset."""
    order = Window.partitionBy(key).orderBy("created_dt", "pr_id")
    ranked = items.withColumn("place", F.row_number().over(order) - 1).join(second_agent_onset(items, key), key)
    first = F.min(F.when(F.col("created_dt") >= F.col("onset_dt"), F.col("place"))).over(Window.partitionBy(key))
    near = ranked.withColumn("event_index", F.col("place") - first).filter(F.col("event_index").between(-width, width))
    p = rate(F.col("merged_dt").isNotNull())
    return near.groupBy("event_index").agg(F.count(F.lit(1)).alias("n"), p.alias("rate"), (1.96 * F.sqrt(p * (1 - p) / F.count(F.lit(1)))).alias("half_width"))


def decision_chains(items: DataFrame, key: str = "repo_id") -> DataFrame:
    """Three predecessors in a row, each strictly known before its successor was made; a first predecessor counts once."""
    events = resolved_events(items, key).withColumn("merged", F.col("merged_dt").isNotNull())
    columns = ["pr_id", "created_dt", "known_dt", "merged"]
    chain = items.select(key, "pr_id", "created_dt", "agent")
    time = "created_dt"
    for n in (1, 2, 3):
        chain = asof_join(chain, events, time, "known_dt", [key], columns, prefix=f"p{n}_", tie=["pr_id"])
        time = f"p{n}_created_dt"
    return first_rows(chain.filter("p1_pr_id is not null"), ["p1_pr_id"], [F.col("created_dt"), F.col("pr_id")])


def streaks(chains: DataFrame) -> DataFrame:
    """Failures in a row before an item: exact, or at least so many where the history ends."""
    failed = [~F.col(f"p{n}_merged") for n in (1, 2, 3)]
    known = [F.col(f"p{n}_merged").isNotNull() for n in (1, 2, 3)]
    label = (
        F.when(known[0] & ~failed[0], "0")
        .when(~known[1], "left-censored-1+")
        .when(~failed[1], "1")
        .when(~known[2], "left-censored-2+")
        .when(~failed[2], "2")
        .otherwise("3+")
    )
    return chains.withColumn("streak", label)


#: Paths that many unrelated changes touch.
GENERIC_PATHS = (
    r"(?i)(^|/)(readme(?:\.[^/]*)?|license(?:\.[^/]*)?|changelog(?:\.[^/]*)?|package-lock\.json|yarn\.lock|pnpm-lock(?:\.yaml)?"
    r"|poetry\.lock|cargo\.lock|go\.sum|requirements(?:\.[^/]*)?)(?:$|/)"
)


def file_successors(items: DataFrame, files: DataFrame, days: int = 30, key: str = "repo_id", cutoff: Column | None = None, generic: Column | None = None) -> DataFrame:
    """For items closed without merging the first later item of the group that changes one of their files.

    An item counts as failed when it closed at or after its creation and not
    after the cutoff. ``generic`` says which paths tell little (by default
    ``GENERIC_PATHS``). ``successor_tie_n`` is how many items could have been
    the successor: those created at the same time that share the path, or
    candidates of different paths at the earliest time.
    """
    who = [F.col("agent").alias("failed_agent"), F.col("user_id").alias("failed_user")]
    mature = F.lit(True) if cutoff is None else F.col("closed_dt") <= cutoff
    resolved = items.filter(F.col("merged_dt").isNull() & (F.col("closed_dt") >= F.col("created_dt")) & mature)
    failed = resolved.join(files, "pr_id").select(key, "filename", F.col("pr_id").alias("failed_id"), F.col("closed_dt").alias("failed_dt"), *who)
    later = tie_counts(items.join(files, "pr_id").select(key, "filename", "pr_id", "created_dt", "agent", "user_id", "merged_dt"), [key, "filename", "created_dt"], "path_n")
    taken = ["pr_id", "created_dt", "agent", "user_id", "merged_dt", "path_n"]
    found = asof_join(failed, later, "failed_dt", "created_dt", [key, "filename"], taken, direction="forward", prefix="next_", tie=["pr_id"])
    near = found.filter(F.col("next_pr_id").isNotNull() & (F.col("next_created_dt") <= after("failed_dt", days=days)))
    telling = ~(generic if generic is not None else F.col("filename").cast("string").rlike(GENERIC_PATHS))
    pairs = near.groupBy(key, "failed_id", "failed_dt", "failed_agent", "failed_user", "next_pr_id", "next_created_dt", "next_agent", "next_user_id", "next_merged_dt").agg(
        F.count(F.lit(1)).alias("shared_files"), F.count_if(telling).alias("shared_telling_files"), F.max("next_path_n").alias("path_n"), F.min("filename").alias("example_file")
    )
    tied = tie_counts(pairs, ["failed_id", "next_created_dt"], "candidate_n")
    first = first_rows(tied, ["failed_id"], [F.col("next_created_dt"), F.col("next_pr_id")])
    return first.withColumns(
        {
            "successor_tie_n": F.greatest("path_n", "candidate_n"),
            "mode": transition_type(F.col("failed_user") == F.col("next_user_id"), F.col("failed_agent") != F.col("next_agent")),
            "recovered": F.coalesce(F.col("next_merged_dt") <= after("next_created_dt", days=days), F.lit(False)),
            "gap_hours": hours("failed_dt", "next_created_dt"),
        }
    ).drop("path_n", "candidate_n")


def link_continuity(pairs: DataFrame, links: DataFrame, left: str, right: str, key: str, link: str) -> DataFrame:
    """Whether two items are linked to the same issue: how many links they share, and on which side any is known.

    An equi-join on (item, link), so that an item with many links is spread by
    them; links with a null on either side and repeated ones don't count.
    """
    known = links.select(key, link).filter(F.col(key).isNotNull() & F.col(link).isNotNull()).distinct()
    here = pairs.select(left, right).distinct().join(known.withColumnRenamed(key, left), left)
    both = here.join(known.withColumnRenamed(key, right), [right, link]).groupBy(left, right).agg(F.count(F.lit(1)).alias("shared_links"))
    has = known.select(key).distinct()
    out = pairs.join(has.select(F.col(key).alias(left), F.lit(True).alias("left_linked")), left, "left")
    out = out.join(has.select(F.col(key).alias(right), F.lit(True).alias("right_linked")), right, "left").join(both, [left, right], "left")
    false, zero = F.lit(False), F.lit(0).cast("bigint")
    out = out.withColumns({"left_linked": F.coalesce("left_linked", false), "right_linked": F.coalesce("right_linked", false), "shared_links": F.coalesce("shared_links", zero)})
    return out.withColumns({"both_linked": F.col("left_linked") & F.col("right_linked"), "same_link": F.col("shared_links") > 0})


def set_continuity(pairs: DataFrame, members: DataFrame, left: str, right: str, key: str, member: str) -> DataFrame:
    """How two items' sets overlap: shared, union, Jaccard, containment; null where one has no set."""
    sets = members.groupBy(key).agg(F.collect_set(member).alias("s"))
    a = sets.select(F.col(key).alias(left), F.col("s").alias("a"))
    b = sets.select(F.col(key).alias(right), F.col("s").alias("b"))
    joined = pairs.join(a, left, "left").join(b, right, "left")
    shared, union = F.size(F.array_intersect("a", "b")).cast("bigint"), F.size(F.array_union("a", "b"))
    covered = F.col("a").isNotNull() & F.col("b").isNotNull()
    return joined.withColumns(
        {
            "covered": covered,
            "shared": F.when(covered, shared),
            "jaccard": F.when(covered, F.try_divide(shared.cast("double"), union.cast("double"))),
            "containment": F.when(covered, F.try_divide(shared.cast("double"), F.least(F.size("a"), F.size("b")).cast("double"))),
        }
    ).drop("a", "b")


def thresholds(df: DataFrame, values: list[float], score: Column, flag: Column, outcome: Column) -> DataFrame:
    """At each threshold: rows that reach it, rates of both arms, difference. The thresholds are a short literal list."""
    each = df.withColumn("threshold", F.explode(F.array(*(F.lit(float(v)) for v in values)))).filter(score >= F.col("threshold"))
    y = outcome.cast("double")
    arms = each.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(~flag, y)).alias("rate0"), F.avg(F.when(flag, y)).alias("rate1"))
    return arms.withColumn("difference", F.col("rate1") - F.col("rate0"))


def star_bin(stars: Column | str) -> Column:
    """Decades of a repository's stars; an unknown number is a bin of its own."""
    n = F.col(stars) if isinstance(stars, str) else stars
    return F.when(n.isNull(), "Missing").when(n < 1, "0").when(n < 10, "1–9").when(n < 100, "10–99").otherwise("100+")


def switch_effects(transitions: DataFrame, by: str) -> DataFrame:
    """After an outcome that was no merge, by group: how those that switched did against those that stayed, in points with 95% limits.

    Groups that lack one of the two go. The limits are those of two independent shares.
    """
    lost, moved, won = transitions.filter(F.col("prior_merged_dt").isNull()), F.col("switched"), F.col("merged_in_time").cast("double")
    arms = lost.groupBy(by).agg(F.count_if(~moved).alias("stay_n"), F.count_if(moved).alias("switch_n"), F.avg(F.when(~moved, won)).alias("stay_rate"), F.avg(F.when(moved, won)).alias("switch_rate")).filter("stay_n > 0 and switch_n > 0")
    effect = F.col("switch_rate") - F.col("stay_rate")
    error = F.sqrt(sum((F.col(f"{a}_rate") * (1 - F.col(f"{a}_rate")) / F.col(f"{a}_n") for a in ("stay", "switch")), F.lit(0.0)))
    return arms.withColumns({"effect_pp": effect * 100, "low_pp": (effect - 1.96 * error) * 100, "high_pp": (effect + 1.96 * error) * 100})


def chosen_threshold(validation: DataFrame, least_n: int, least_precision: float, otherwise: float) -> DataFrame:
    """One row, candidate_threshold: the first threshold that selects enough rows at enough precision, else a given one. validation: threshold, selected_n, precision."""
    good = F.when((F.col("selected_n") >= least_n) & (F.col("precision") >= least_precision), F.col("threshold"))
    return validation.agg(F.coalesce(F.min(good), F.lit(float(otherwise))).alias("candidate_threshold"))


def continuation_candidates(pairs: DataFrame, threshold: DataFrame, similarity: str = "similarity", same: tuple[str, ...] = ("same_issue", "same_title")) -> DataFrame:
    """pairs with the chosen threshold and whether a pair may be one task: a shared reference, an equal title, or enough similarity."""
    known = F.lit(False)
    for flag in same:
        known = known | F.coalesce(flag, F.lit(False))
    joined = pairs.crossJoin(F.broadcast(threshold))
    return joined.withColumn("continuation_candidate", known | F.coalesce(F.col(similarity) >= F.col("candidate_threshold"), F.lit(False)))


def invariants(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule; every rule in one pass."""
    counts = df.agg(*(F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()))
    rows = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules))
    return counts.select(F.explode(rows).alias("x")).select("x.*")


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df, unless a rule is broken."""
    bad = [r for r in invariants(df, rules).collect() if r["violations"]]
    if bad:
        raise ValueError(f"invariants broken: {[r.asDict() for r in bad]}")
    return df


def order_free_expectation(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """Chance that a random member of a group has the flag, and whether all have it."""
    return df.groupBy(key).agg(rate(flag).alias("expected"), all_(flag).alias("always"))
