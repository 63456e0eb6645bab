"""Queries over identities as texts, and tables that went through files of other formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadline.functions import columns as X
from threadline.operators.audit import graded
from threadline.sources import tables
from threadline.sources.stage import stage_dir

SLUG = r"^(https?://[^/]+/|git@[^:]+:|ssh://[^/]+/)(repos/)?"


def q_identities(spark, d):
    """Repositories, numbers and logins as different sources write them."""
    e = tables.read_table(spark, d, "events", ["event_id", "user_id"])
    i, owner = F.col("event_id"), F.concat(F.lit("Own"), F.col("user_id") % 7)
    url = (
        F.when(i % 6 == 0, F.concat(F.lit("https://api.github.com/repos/"), owner, F.lit("/Repo/"))).when(i % 6 == 1, F.concat(F.lit("git@github.com:"), owner, F.lit("/Repo.git")))
        .when(i % 6 == 2, F.concat(F.lit("  http://github.com/"), owner, F.lit("/repo "))).when(i % 6 == 3, F.concat(owner, F.lit("/repo/extra"))).when(i % 6 == 4, F.concat(owner, F.lit("/repo//")))
    )
    number = F.when(i % 4 == 0, F.concat(F.lit("-"), i)).when(i % 4 == 1, F.lit("x")).otherwise(i.cast("string"))
    who = F.when(i % 3 == 0, F.concat(F.lit(" Acct"), i % 11, F.lit(" "))).when(i % 3 == 1, "  ")
    return e.select("event_id", X.repo_slug(url).alias("repo"), X.positive_number(number).alias("number"), X.login(who).alias("login"))


def q_references(spark, d):
    e = tables.read_table(spark, d, "events", ["event_id"])
    i = F.col("event_id")
    url = (
        F.when(i % 5 == 0, F.concat(F.lit("https://api/repos/o/r/pulls/comments/"), i)).when(i % 5 == 1, F.concat(F.lit("/pulls/comments/"), i, F.lit("?x=1")))
        .when(i % 5 == 2, F.concat(F.lit("/issues/comments/"), i, F.lit("-3#a"))).when(i % 5 == 3, F.concat(F.lit(" /issues/comments/"), i, F.lit(" "))).otherwise(F.concat(F.lit("/issues/comments/"), i, F.lit("x")))
    )
    return e.select("event_id", X.public_comment(url).alias("r")).select("event_id", "r.kind", "r.public_id", "r.fragment")


def q_parquet(spark, d):
    path = stage_dir(spark)
    tables.write_table(tables.read_table(spark, d, "lineitem", ["l_orderkey", "l_returnflag", "l_quantity", "l_shipdate"]), path, ["l_returnflag"])
    back = spark.read.parquet(path)
    return back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.max("l_shipdate").alias("last_ship"))


def q_csv(spark, d):
    path = stage_dir(spark)
    schema = "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    tables.write_csv(tables.read_table(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]), path)
    return tables.read_csv(spark, path, schema).groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderkey").alias("last_key"))


def q_json(spark, d):
    """Nested rows: an item's events as an array, written as JSON lines and read by schema."""
    path = stage_dir(spark)
    e = tables.read_table(spark, d, "events", ["event_id", "user_id", "event_type", "value"])
    nested = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("rows"))
    tables.write_json(nested, path)
    back = tables.read_json(spark, path, "user_id bigint, rows array<struct<event_id:bigint,event_type:string,value:double>>")
    return back.select("user_id", F.inline("rows")).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("value"))


def q_digests(spark, d):
    """How many of the files under the tables' folder are equal in content: digests of all, one row for each size class."""
    f = tables.file_digests(spark, d)
    return f.select("length", "sha256").groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("length"))


def q_graded(spark, d):
    """Which tables could serve as events with a text, by their columns alone."""
    names = ["conversations", "documents", "events", "labels", "pages"]
    rows = [(n, graded(tables.read_table(spark, d, n).columns, ["text"], ["role"])) for n in names]
    found = spark.createDataFrame(rows, "table_name string, grade string")
    return found.join(tables.footer_counts(spark, d, names), "table_name")


_URL = """CASE event_id % 6 WHEN 0 THEN 'https://api.github.com/repos/Own' || user_id % 7 || '/Repo/' WHEN 1 THEN 'git@github.com:Own' || user_id % 7 || '/Repo.git' WHEN 2 THEN '  http://github.com/Own' || user_id % 7 || '/repo ' WHEN 3 THEN 'Own' || user_id % 7 || '/repo/extra' WHEN 4 THEN 'Own' || user_id % 7 || '/repo//' END"""

QUERIES = {
    "identities": (
        q_identities,
        f"""WITH u AS (SELECT event_id, regexp_replace(regexp_replace(regexp_replace(lower(trim({_URL})), '{SLUG}', ''), '/+$', ''), '\\.git$', '') AS s, CASE WHEN event_id % 4 >= 2 THEN event_id END AS number, CASE WHEN event_id % 3 = 0 THEN 'acct' || event_id % 11 END AS login FROM events)
SELECT event_id, CASE WHEN regexp_full_match(s, '[a-z0-9_.-]+/[a-z0-9_.-]+') THEN s END AS repo, CASE WHEN number > 0 THEN number END AS number, login FROM u""",
    ),
    "comment_references": (
        q_references,
        "SELECT event_id, CASE WHEN event_id % 5 <= 1 THEN 'review_comment' WHEN event_id % 5 <= 3 THEN 'issue_comment' END AS kind, CASE WHEN event_id % 5 <= 3 THEN event_id END AS public_id, CASE WHEN event_id % 5 = 2 THEN CAST(3 AS BIGINT) END AS fragment FROM events",
    ),
    "parquet_round_trip": (q_parquet, "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1"),
    "csv_round_trip": (q_csv, "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last_key FROM orders GROUP BY 1, 2"),
    "json_round_trip": (q_json, "SELECT user_id, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2"),
    "file_digests": (q_digests, None),
    "graded_tables": (
        q_graded,
        "SELECT 'conversations' AS table_name, 'FULL' AS grade, (SELECT count(*) FROM conversations) AS n_rows UNION ALL SELECT 'documents', 'CONDITIONAL', (SELECT count(*) FROM documents) UNION ALL SELECT 'events', 'INCOMPATIBLE', (SELECT count(*) FROM events) UNION ALL SELECT 'labels', 'INCOMPATIBLE', (SELECT count(*) FROM labels) UNION ALL SELECT 'pages', 'INCOMPATIBLE', (SELECT count(*) FROM pages)",
    ),
}
