"""The tables of a collected review corpus, by its own column names, as the frames that the operators take.

Tables: all_pull_request, all_repository, pull_request, pr_reviews, pr_comments,
pr_review_comments, pr_timeline; times are ISO texts. ``tables`` gives a DataFrame by name, from a
folder of Parquet files or from views, so scans stay lazy and read what is used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.functions.columns import after, hours, parse_time, product_of, repo_slug
from threadline.functions.text import task_of_title
from threadline.sources.tables import assert_unique, join_validated, read_table

Tables = Callable[[str], DataFrame]

#: Names of the three channels of feedback, of the timeline's event for a rewritten branch.
REVIEW, COMMENT, INLINE = "submitted_review", "pr_comment", "inline_review_comment"
REWRITTEN = "head_ref_force_pushed"


def folder_tables(spark: SparkSession, folder: str) -> Tables:
    return lambda name: read_table(spark, folder, name)


def _time(column: str) -> Column:
    return parse_time(column).cast("timestamp_ntz")


def backbone(tables: Tables) -> DataFrame:
    """pr_id, number, repo_id, repo_url, author_agent, author_login and the three times of every work item; bad times are null."""
    return tables("pull_request").select(
        F.col("id").alias("pr_id"), "number", "repo_id", "repo_url", F.col("agent").alias("author_agent"), F.col("user").alias("author_login"),
        _time("created_at").alias("created_dt"), _time("closed_at").alias("closed_dt"), _time("merged_at").alias("merged_dt"),
    )


def all_items(tables: Tables) -> DataFrame:
    """Every item of the full layer with its times, and whether it was merged."""
    return tables("all_pull_request").select(
        F.col("id").alias("pr_id"), "repo_url", "repo_id", "agent", "user_id", "state",
        _time("created_at").alias("created_dt"), _time("closed_at").alias("closed_dt"), _time("merged_at").alias("merged_dt"), F.col("merged_at").isNotNull().alias("merged"),
    )


def repositories(tables: Tables) -> DataFrame:
    """One row for a repository's address: that of the least id."""
    row = F.struct(F.col("id").alias("repository_id"), "language", "stars", "forks", "is_forked")
    return tables("all_repository").groupBy(F.col("url").alias("repo_url")).agg(F.min_by(row, "id").alias("r")).select("repo_url", "r.*")


def review_items(tables: Tables) -> DataFrame:
    """review_id, pr_id: the item of each review; of several rows of one review the least item."""
    return tables("pr_reviews").filter("pull_request_review_id is not null").groupBy(F.col("pull_request_review_id").alias("review_id")).agg(F.min("pr_id").alias("pr_id"))


def inline_comments(tables: Tables) -> DataFrame:
    """Inline comments with the item that their review belongs to; those of an unknown review have none and go."""
    own = tables("pr_review_comments").select(
        F.col("id").alias("event_id"), F.col("pull_request_review_id").alias("review_id"), F.col("user").alias("actor_login"), "user_type",
        F.col("in_reply_to_id").try_cast("decimal(20,0)").cast("bigint").alias("parent_id"), _time("created_at").alias("interaction_dt"),
    )
    return own.join(review_items(tables), "review_id")


def reviews(tables: Tables) -> DataFrame:
    return tables("pr_reviews").select(
        "pr_id", F.col("id").alias("event_id"), F.col("pull_request_review_id").alias("review_id"), F.col("user").alias("actor_login"), "user_type",
        F.col("state").cast("string").alias("state"), _time("submitted_at").alias("interaction_dt"),
    )


def comments(tables: Tables) -> DataFrame:
    return tables("pr_comments").select("pr_id", F.col("id").alias("event_id"), F.col("user").alias("actor_login"), "user_type", _time("created_at").alias("interaction_dt"))


def rewrites(tables: Tables) -> DataFrame:
    """Branches rewritten: the timeline's events of that kind, which have an actor and no account type."""
    return tables("pr_timeline").filter(F.col("event") == REWRITTEN).select("pr_id", F.col("actor").alias("actor_login"), _time("created_at").alias("interaction_dt"))


def interactions(tables: Tables, aliases: dict[str, str]) -> DataFrame:
    """The three channels of feedback as one table, with the product that an account stands for."""
    columns = ["pr_id", "event_id", "review_id", "parent_id", "actor_login", "user_type", "state", "interaction_dt"]
    frames = [(REVIEW, reviews(tables)), (COMMENT, comments(tables)), (INLINE, inline_comments(tables))]
    kinds = {"review_id": "bigint", "parent_id": "bigint", "state": "string"}
    whole = [df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns), F.lit(name).alias("source")) for name, df in frames]
    out = whole[0].unionByName(whole[1]).unionByName(whole[2])
    return out.withColumn("actor_agent", product_of("actor_login", aliases))


#: Kinds of task that are told apart; all others are maintenance.
CORE_TASKS = ("feat", "fix", "docs", "test")


def broad_task(kind: Column | str) -> Column:
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.when(k.isin(*CORE_TASKS), k).otherwise("maintenance")


def _titled(tables: Tables) -> DataFrame:
    """Items with their title and times, and whether they were merged within 30 days."""
    items = tables("pull_request").select("id", "repo_url", "agent", "user_id", "title", _time("created_at").alias("created_dt"), _time("merged_at").alias("merged_dt"))
    merged = (F.col("merged_dt") >= F.col("created_dt")) & (F.col("merged_dt") <= after("created_dt", days=30))
    return items.withColumn("merged_30d", F.coalesce(merged, F.lit(False)))


def labelled_items(tables: Tables) -> DataFrame:
    """Items with the task that their title's prefix names; null where it names none."""
    return _titled(tables).withColumn("task_type", task_of_title("title"))


def predicted_items(tables: Tables, predictions: DataFrame, least_margin: float = 0.0) -> DataFrame:
    """Items with their predicted task (id, task_type, margin, one row for an item); predictions under the margin are null."""
    known = predictions.select("id", F.when(F.col("margin") >= least_margin, F.col("task_type")).alias("task_type"), "margin")
    return join_validated(_titled(tables), known, ["id"], "left", "1:1")


def training_items(tables: Tables) -> DataFrame:
    """Items that have a given task, by broad kinds; a missing title is empty."""
    given = tables("pr_task_type").select("id", broad_task("type").alias("task_type"), "confidence")
    items = tables("pull_request").select("id", "repo_url", F.coalesce("title", F.lit("")).alias("title"), _time("created_at").alias("created_dt"))
    return join_validated(items, given, ["id"], "inner", "1:1")


def item_map(tables: Tables) -> DataFrame:
    """pr_id, repo_name, pr_number: how another corpus names an item; each item once, and none without a name."""
    named = tables("pull_request").select(F.col("id").alias("pr_id"), repo_slug("repo_url").alias("repo_name"), F.col("number").alias("pr_number"))
    if not named.filter("pr_id is null or repo_name is null or pr_number is null").isEmpty():
        raise ValueError("an item has no name in the other corpus")
    return assert_unique(named, ["pr_id"])


def cross_pairs(pairs: DataFrame) -> DataFrame:
    """One row for each item and pair of products of another corpus, that of the first review; pairs of one product raise."""
    named = pairs.withColumn("repo_name", repo_slug("repo_name"))
    if not named.filter("author_agent = reviewer_agent").isEmpty():
        raise ValueError("a pair is of one product")
    return named.groupBy("repo_name", "pr_number", "author_agent", "reviewer_agent").agg(F.min("first_review_at").alias("first_review_at"))


def overlap(triggers: DataFrame, items: DataFrame, pairs: DataFrame) -> DataFrame:
    """triggers (one row for an item) with whether another corpus has the same item and pair, or the item at all, and how much later it saw the review.

    items is from ``item_map``, pairs from ``cross_pairs``. The grain of triggers is kept and checked.
    """
    named = join_validated(triggers, items, ["pr_id"], "left", "1:1")
    exact = pairs.select("repo_name", "pr_number", "author_agent", F.col("reviewer_agent").alias("trigger_agent"), "first_review_at", F.lit(True).alias("exact_pair"))
    any_ = pairs.select("repo_name", "pr_number").distinct().withColumn("any_pair", F.lit(True))
    joined = named.join(exact, ["repo_name", "pr_number", "author_agent", "trigger_agent"], "left").join(any_, ["repo_name", "pr_number"], "left")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("exact_pair", "any_pair")}
    return joined.withColumns({**flags, "hours_later": hours("trigger_dt", "first_review_at")})
