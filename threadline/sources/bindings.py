"""Views of the shared test tables as work items, interactions, files and threads.

Every view has its DuckDB text beside it, so that a query and its SQL start from
the same rows. Work items ("prs") have pr_id, repo_id, user_id, agent and their
times; interactions have one row per event of an item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadline.sources.tables import read_table

PR_SQL = """pr AS (
  SELECT o_orderkey AS pr_id, o_custkey % 300 AS repo_id, o_custkey AS user_id, o_orderpriority AS agent, o_orderdate AS created_dt,
    CASE WHEN o_orderstatus <> 'O' THEN min(l_shipdate) FILTER (WHERE l_shipdate > o_orderdate) END AS closed_dt,
    CASE WHEN o_orderstatus = 'F' THEN min(l_shipdate) FILTER (WHERE l_shipdate > o_orderdate) END AS merged_dt
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
  GROUP BY o_orderkey, o_custkey, o_orderpriority, o_orderdate, o_orderstatus)"""

IX_SQL = """ix AS (
  SELECT user_id AS pr_id, event_id, event_type AS source, ts AS interaction_dt, user_id % 20 AS repo_id,
    CASE event_type WHEN 'error' THEN 'A' WHEN 'signup' THEN 'B' END AS actor_agent,
    CASE WHEN event_type IN ('click', 'view') OR event_id % 13 = 0 THEN CASE WHEN event_id % 5 = 0 THEN 'user' ELSE 'User' END
      WHEN event_type = 'purchase' AND event_id % 3 <> 0 THEN NULL WHEN event_id % 7 = 0 THEN 'BOT' ELSE 'Bot' END AS user_type,
    CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS author_agent,
    CASE WHEN event_id % 4 = 0 THEN concat('ACCT', event_id % 11) ELSE concat('acct', event_id % 11) END AS actor_login, concat('Acct', user_id % 11) AS author_login,
    CASE WHEN event_type <> 'view' AND event_id % 17 <> 0 THEN event_id // 2 END AS review_id, value,
    CASE WHEN event_id % 3 = 0 THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS parent_id
  FROM events),
item AS (
  SELECT user_id AS pr_id, user_id % 20 AS repo_id, min(ts) - INTERVAL 1 DAY AS created_dt,
    CASE WHEN user_id % 3 <> 0 THEN min(ts) + to_days(CAST(user_id % 40 + 1 AS INTEGER)) END AS closed_dt,
    CASE WHEN user_id % 3 = 1 THEN min(ts) + to_days(CAST(user_id % 40 + 1 AS INTEGER)) END AS merged_dt
  FROM events GROUP BY user_id)"""

FILES_SQL = """files AS (SELECT DISTINCT l_orderkey AS pr_id, l_partkey % 50 AS filename FROM lineitem)"""

ISSUES_SQL = """issues AS (SELECT DISTINCT l_orderkey AS pr_id, l_suppkey % 7 AS issue_id FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 3 <> 0)"""

#: The events as a corpus of reviews, by the loaders' column names (here after loading): bots named a-bot and b-bot stand for products A and B.
CORPUS_SQL = """ev AS (SELECT event_id, user_id AS pr_id, event_type, date_trunc('second', ts) AS dt, CASE event_type WHEN 'error' THEN 'A-bot' WHEN 'signup' THEN 'b-bot' ELSE concat('acct', event_id % 11) END AS actor_login,
    CASE WHEN event_type IN ('error', 'signup') THEN 'Bot' WHEN event_id % 13 = 0 THEN NULL ELSE 'User' END AS user_type FROM events),
bb AS (SELECT user_id AS pr_id, user_id % 20 AS repo_id, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS author_agent, concat('Acct', user_id % 11) AS author_login, date_trunc('second', min(ts)) - INTERVAL 1 DAY AS created_dt,
    CASE WHEN user_id % 3 <> 0 THEN date_trunc('second', min(ts)) + to_days(CAST(user_id % 40 + 1 AS INTEGER)) END AS closed_dt,
    CASE WHEN user_id % 3 = 1 THEN date_trunc('second', min(ts)) + to_days(CAST(user_id % 40 + 1 AS INTEGER)) END AS merged_dt FROM events GROUP BY user_id),
lv AS (SELECT pr_id, event_id + 1000000 AS event_id, event_id AS review_id, CAST(NULL AS BIGINT) AS parent_id, actor_login, user_type, dt FROM ev WHERE event_type IN ('signup', 'error', 'view') AND event_id % 7 <> 0),
li AS (SELECT pr_id, event_id, event_id AS review_id, parent_id, actor_login, user_type, dt FROM (
  SELECT *, CASE WHEN event_type = 'view' AND event_id % 4 <> 1 THEN lag(event_id) OVER (PARTITION BY pr_id ORDER BY dt, event_id) END AS parent_id FROM ev WHERE event_type IN ('error', 'view')) WHERE event_id % 7 <> 0),
lc AS (SELECT pr_id, event_id, CAST(NULL AS BIGINT) AS review_id, CAST(NULL AS BIGINT) AS parent_id, actor_login, user_type, dt FROM ev WHERE event_type = 'click'),
lt AS (SELECT pr_id, actor_login, dt FROM ev WHERE event_type = 'purchase' AND event_id % 2 = 0),
li3 AS (SELECT *, 'submitted_review' AS source FROM lv UNION ALL SELECT *, 'pr_comment' FROM lc UNION ALL SELECT *, 'inline_review_comment' FROM li),
lx AS (SELECT *, CASE lower(actor_login) WHEN 'a-bot' THEN 'A' WHEN 'b-bot' THEN 'B' END AS actor_agent FROM li3)"""
ALIASES = {"a-bot": "A", "B-Bot": "B"}

LABELLED_SQL = """frame AS (
  SELECT doc_id, CAST(quality AS DOUBLE) AS y, CAST(toxic AS DOUBLE) AS x, ln(1 + CAST(n_chars AS DOUBLE)) AS z, source AS cluster
  FROM labels JOIN documents USING (doc_id))"""


#: Rows of orders and their items that one task joins, where there are many.
TASK_ROWS = 1_000_000


def pull_requests(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders", ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_orderstatus"])
    ships = read_table(spark, folder, "lineitem", ["l_orderkey", "l_shipdate"])
    # Adaptive execution puts partitions together by compressed bytes, of which these narrow rows have few: by rows there are as many tasks as they need.
    tasks = -(-(orders.count() + ships.count()) // TASK_ROWS)
    if tasks > spark.sparkContext.defaultParallelism:
        orders, ships = orders.repartition(tasks, "o_orderkey"), ships.repartition(tasks, "l_orderkey")
    joined = orders.join(ships, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    first = F.min(F.when(F.col("l_shipdate") > F.col("o_orderdate"), F.col("l_shipdate")))
    return (
        joined.groupBy("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_orderstatus")
        .agg(first.alias("ship"))
        .select(
            F.col("o_orderkey").alias("pr_id"),
            (F.col("o_custkey") % 300).alias("repo_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderpriority").alias("agent"),
            F.col("o_orderdate").alias("created_dt"),
            F.when(F.col("o_orderstatus") != "O", F.col("ship")).alias("closed_dt"),
            F.when(F.col("o_orderstatus") == "F", F.col("ship")).alias("merged_dt"),
        )
    )


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events", ["event_id", "user_id", "ts", "event_type", "value"])
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(
        F.col("user_id").alias("pr_id"),
        "event_id",
        F.col("event_type").alias("source"),
        F.col("ts").alias("interaction_dt"),
        (F.col("user_id") % 20).alias("repo_id"),
        F.when(F.col("event_type") == "error", "A").when(F.col("event_type") == "signup", "B").alias("actor_agent"),
        F.when(F.col("event_type").isin("click", "view") | (F.col("event_id") % 13 == 0), F.when(F.col("event_id") % 5 == 0, "user").otherwise("User"))
        .when((F.col("event_type") == "purchase") & (F.col("event_id") % 3 != 0), F.lit(None))
        .when(F.col("event_id") % 7 == 0, "BOT").otherwise("Bot").alias("user_type"),
        F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("author_agent"),
        F.concat(F.when(F.col("event_id") % 4 == 0, "ACCT").otherwise("acct"), F.col("event_id") % 11).alias("actor_login"),
        F.concat(F.lit("Acct"), F.col("user_id") % 11).alias("author_login"),
        F.when((F.col("event_type") != "view") & (F.col("event_id") % 17 != 0), F.floor(F.col("event_id") / 2)).alias("review_id"),
        "value",
        F.when(F.col("event_id") % 3 == 0, before).alias("parent_id"),
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    """The work items that the interactions belong to."""
    first = read_table(spark, folder, "events", ["user_id", "ts"]).groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    closed = F.col("first_ts") + F.make_dt_interval(F.col("user_id") % 40 + 1)
    return first.select(
        F.col("user_id").alias("pr_id"),
        (F.col("user_id") % 20).alias("repo_id"),
        (F.col("first_ts") - F.expr("INTERVAL 1 DAY")).alias("created_dt"),
        F.when(F.col("user_id") % 3 != 0, closed).alias("closed_dt"),
        F.when(F.col("user_id") % 3 == 1, closed).alias("merged_dt"),
    )


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, folder, "lineitem", ["l_orderkey", "l_partkey"])
    return lines.select(F.col("l_orderkey").alias("pr_id"), (F.col("l_partkey") % 50).alias("filename")).distinct()


def linked_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Issues that items refer to, with repeated links and nulls."""
    lines = read_table(spark, folder, "lineitem", ["l_orderkey", "l_suppkey", "l_linenumber"]).filter("l_linenumber = 1")
    return lines.select(F.when(F.col("l_orderkey") % 3 != 0, F.col("l_orderkey")).alias("pr_id"), (F.col("l_suppkey") % 7).alias("issue_id"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome y, exposure x, control z and a cluster for each labelled document."""
    docs = read_table(spark, folder, "documents", ["doc_id", "n_chars", "source"])
    labels = read_table(spark, folder, "labels", ["doc_id", "quality", "toxic"])
    return labels.join(docs, "doc_id").select(
        "doc_id", F.col("quality").cast("double").alias("y"), F.col("toxic").cast("double").alias("x"), F.log(1 + F.col("n_chars").cast("double")).alias("z"), F.col("source").alias("cluster")
    )


def corpus(spark: SparkSession, folder: str):
    """The events as the tables of a review corpus, with its column names and ISO times."""
    ev = read_table(spark, folder, "events", ["event_id", "user_id", "ts", "event_type"])
    kind, i = F.col("event_type"), F.col("event_id")
    bot = kind.isin("error", "signup")
    login = F.when(kind == "error", "A-bot").when(kind == "signup", "b-bot").otherwise(F.concat(F.lit("acct"), i % 11))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ev = ev.withColumns({"user": login, "user_type": F.when(bot, "Bot").when(i % 13 != 0, "User"), "at": at})

    def iso(t):
        return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")

    first = ev.groupBy("user_id").agg(F.min("ts").alias("t"))
    u = F.col("user_id")
    closed = F.col("t") + F.make_dt_interval(u % 40 + 1)
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy(F.date_trunc("second", "ts"), "event_id"))
    inline = ev.filter(kind.isin("error", "view")).withColumn("in_reply_to_id", F.when((kind == "view") & (i % 4 != 1), F.concat(before.cast("string"), F.lit(".0"))))
    found = {
        "pull_request": first.select(
            u.alias("id"), (u * 3).alias("number"), (u % 20).alias("repo_id"), F.concat(F.lit("https://x.org/Own/r"), u % 20).alias("repo_url"), F.when(u % 2 == 0, "A").otherwise("B").alias("agent"),
            F.concat(F.lit("Acct"), u % 11).alias("user"), (u % 11).alias("user_id"), F.when(u % 5 == 0, "feat: x").when(u % 5 == 1, "Fix(core)!: y").when(u % 5 == 2, "docs z").when(u % 5 == 3, "perf: q").alias("title"), iso(F.col("t") - F.expr("INTERVAL 1 DAY")).alias("created_at"), F.when(u % 3 != 0, iso(closed)).alias("closed_at"), F.when(u % 3 == 1, iso(closed)).alias("merged_at"),
        ),
        "pr_reviews": ev.filter(kind.isin("signup", "error", "view") & (i % 7 != 0)).select((i + 1000000).alias("id"), u.alias("pr_id"), i.alias("pull_request_review_id"), "user", "user_type", F.lit("COMMENTED").alias("state"), F.col("at").alias("submitted_at")),
        "pr_comments": ev.filter(kind == "click").select(i.alias("id"), u.alias("pr_id"), "user", "user_type", F.col("at").alias("created_at")),
        "pr_review_comments": inline.select(i.alias("id"), i.alias("pull_request_review_id"), "user", "user_type", "in_reply_to_id", F.col("at").alias("created_at")),
        "pr_task_type": first.filter(u % 4 != 0).select(u.alias("id"), F.when(u % 3 == 0, "test").when(u % 3 == 1, "perf").otherwise("fix").alias("type"), (u % 10).alias("confidence")),
        "predictions": first.filter(u % 7 != 0).select(u.alias("id"), F.when(u % 2 == 0, "docs").otherwise("fix").alias("task_type"), (u % 10 / 10.0).alias("margin")),
        "other_pairs": ev.filter(bot & (u % 3 != 0)).select(
            F.concat(F.lit("OWN/r"), u % 20).alias("repo_name"), (u * 3).alias("pr_number"), F.when(u % 2 == 0, "A").otherwise("B").alias("author_agent"), F.when(u % 2 == 0, "B").otherwise("A").alias("reviewer_agent"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("first_review_at"),
        ),
        "pr_timeline": ev.filter(kind == "purchase").select(u.alias("pr_id"), F.when(i % 2 == 0, "head_ref_force_pushed").otherwise("labeled").alias("event"), F.col("user").alias("actor"), F.col("at").alias("created_at")),
    }
    return found.__getitem__
