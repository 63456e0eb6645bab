"""Queries for the relational primitives: joins, dedup, windows, aggregates, sets, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadline.functions import columns as X
from threadline.operators.asof import first_rows, ntile, ranked, tie_counts
from threadline.sources import bindings as B
from threadline.sources.tables import join_validated, read_table
from threadline.stats.concentration import composition


def t(spark, d, name, *columns):
    return read_table(spark, d, name, columns)


def q_project(spark, d):
    return t(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice").filter("o_totalprice > 150000 and o_orderstatus <> 'P'").withColumnRenamed("o_orderkey", "order_id")


def q_isin(spark, d):
    return t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity").filter(F.col("l_returnflag").isin("A", "R") & F.col("l_quantity").between(10, 20)).select("l_orderkey", "l_linenumber", "l_returnflag")


def q_labels(spark, d):
    o = t(spark, d, "orders", "o_orderstatus", "o_totalprice")
    size = F.when(F.col("o_totalprice") > 300000, "large").when(F.col("o_totalprice") > 100000, "middle").otherwise("small")
    name = F.create_map(F.lit("F"), F.lit("done"), F.lit("O"), F.lit("open"))[F.col("o_orderstatus")]
    return o.groupBy(size.alias("size"), F.coalesce(name, F.lit("other")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def q_first(spark, d):
    o = t(spark, d, "orders", "o_custkey", "o_orderdate", "o_orderkey")
    return first_rows(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


def q_last(spark, d):
    o = t(spark, d, "orders", "o_custkey", "o_orderdate", "o_orderkey")
    return first_rows(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


def q_distinct(spark, d):
    return t(spark, d, "lineitem", "l_orderkey", "l_returnflag").dropDuplicates()


def q_topk(spark, d):
    return t(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


def q_top1(spark, d):
    n = t(spark, d, "orders", "o_custkey", "o_orderpriority").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("n", "o_orderpriority")).alias("top_priority"))


def q_trycast(spark, d):
    e = t(spark, d, "events", "event_id", "props")
    v = F.regexp_extract("props", r"([0-9]+)", 1)
    return e.select("event_id", v.try_cast("bigint").alias("number"), F.lit(None).cast("bigint").alias("nothing"))


def q_inner(spark, d):
    o, c = t(spark, d, "orders", "o_orderkey", "o_custkey"), t(spark, d, "customer", "c_custkey", "c_nationkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


def q_left(spark, d):
    c, o = t(spark, d, "customer", "c_custkey"), t(spark, d, "orders", "o_custkey", "o_totalprice")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_custkey").alias("n"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


def q_full(spark, d):
    a = t(spark, d, "documents", "doc_id").select(F.col("doc_id").alias("id"), (F.col("doc_id") * 2).alias("left_value"))
    b = t(spark, d, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("right_value"))
    return a.join(b, "id", "full")


def q_semi(spark, d):
    late = t(spark, d, "lineitem", "l_orderkey", "l_quantity").filter("l_quantity > 45")
    return t(spark, d, "orders", "o_orderkey", "o_custkey").join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


def q_anti(spark, d):
    return t(spark, d, "customer", "c_custkey").join(t(spark, d, "orders", "o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


def q_interval(spark, d):
    e = t(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    a = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("start_id"), F.col("ts").alias("start_ts"))
    b = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    inside = (F.col("ts") > F.col("start_ts")) & (F.col("ts") <= X.after("start_ts", hours=12))
    return a.join(b, "user_id").filter(inside).select("start_id", "event_id")


def q_theta(spark, d):
    o = t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    b = o.select("o_custkey", F.col("o_orderkey").alias("other"), F.col("o_orderdate").alias("other_date"), F.col("o_totalprice").alias("other_price"))
    return o.join(b, "o_custkey").filter("other <> o_orderkey and other_date < o_orderdate and other_price > o_totalprice").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_before"))


def q_self(spark, d):
    c = t(spark, d, "conversations", "conv_id", "turn", "role")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent_role"))
    return c.join(p, ["conv_id", "turn"]).groupBy("parent_role", "role").agg(F.count(F.lit(1)).alias("n"))


def q_multikey(spark, d):
    ix = B.interactions(spark, d)
    tr = ix.filter("source = 'error'").select("pr_id", "interaction_dt", "source", F.col("event_id").alias("trigger_id"))
    return tr.join(ix.select("pr_id", "interaction_dt", "source", "event_id"), ["pr_id", "interaction_dt", "source"]).select("trigger_id", "event_id")


def q_validated(spark, d):
    docs = t(spark, d, "documents", "doc_id", "lang")
    return join_validated(t(spark, d, "labels", "doc_id", "quality"), docs, ["doc_id"], "inner", "1:1").groupBy("lang", F.col("quality").cast("bigint").alias("quality")).agg(F.count(F.lit(1)).alias("n"))


def q_dimension(spark, d):
    n = t(spark, d, "events", "event_type", "user_id").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    kinds = F.array(*map(F.lit, ("click", "error", "purchase", "refund", "signup", "view")))
    grid = n.select("user_id").distinct().withColumn("event_type", F.explode(kinds))
    return grid.join(n, ["user_id", "event_type"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def q_aggregates(spark, d):
    q = F.col("l_quantity")
    return t(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_orderkey").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(q), 2).alias("total"), F.round(F.avg(q), 6).alias("mean"), F.min(q).alias("low"), F.max(q).alias("high"), F.count_distinct("l_orderkey").alias("n_orders")
    )


def q_quantiles(spark, d):
    return t(spark, d, "events", "event_type", "value").groupBy("event_type").agg(
        F.round(F.median("value"), 9).alias("median"), F.round(F.percentile("value", F.lit(0.25)), 9).alias("q1"), F.round(F.percentile("value", F.lit(0.9)), 9).alias("p90"), F.round(F.var_samp("value"), 6).alias("variance"), F.round(F.stddev_pop("value"), 6).alias("deviation")
    )


def q_nunique_null(spark, d):
    pr = B.pull_requests(spark, d)
    return pr.groupBy("repo_id").agg(X.n_unique("closed_dt").alias("n_closed_values"), F.count_distinct("closed_dt").alias("n_closed"), F.count_if(F.col("closed_dt").isNull()).alias("n_open"))


def q_filtered(spark, d):
    click = F.col("event_type") == "click"
    return t(spark, d, "events", "user_id", "event_type", "ts", "value").groupBy("user_id").agg(
        F.min(F.when(click, F.col("ts"))).alias("first_click"), F.count_if(click).alias("clicks"), X.any_(F.col("value") > 90).alias("any_high"), X.all_(F.col("value") > 0).alias("all_positive")
    )


def q_first_by(spark, d):
    return t(spark, d, "events", "user_id", "event_type", "ts", "event_id").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


def q_strings(spark, d):
    return t(spark, d, "lineitem", "l_orderkey", "l_returnflag").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), "|").alias("modes"))


def q_pivot(spark, d):
    return t(spark, d, "orders", "o_orderpriority", "o_orderstatus").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


def q_cut(spark, d):
    v = F.col("value")
    return t(spark, d, "events", "value").groupBy(F.when(v <= 10, "(0,10]").when(v <= 50, "(10,50]").otherwise("(50,inf)").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def q_deciles(spark, d):
    c = t(spark, d, "customer", "c_custkey", "c_acctbal")
    place = ranked(c, [F.asc("c_acctbal"), F.asc("c_custkey")]).crossJoin(F.broadcast(c.agg(F.count(F.lit(1)).alias("total"))))
    return place.withColumn("decile", ntile(F.col("place"), F.col("total"), 10)).groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))


def q_subtotals(spark, d):
    o = t(spark, d, "orders", "o_orderstatus", "o_orderpriority", "o_totalprice")
    out = o.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().alias("level"))
    return out.withColumns({"o_orderstatus": F.coalesce("o_orderstatus", F.lit("all")), "o_orderpriority": F.coalesce("o_orderpriority", F.lit("all"))})


def q_ties(spark, d):
    return tie_counts(t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey", "o_orderdate"]).filter("tie_n > 1").select("o_orderkey", "tie_n")


def q_ordinal(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value")
    return e.select("event_id", (F.row_number().over(w) - 1).cast("bigint").alias("place"), F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")).alias("gap_seconds"), F.lead("event_type").over(w).alias("next_type"))


def q_demean(spark, d):
    w = Window.partitionBy("user_id")
    return t(spark, d, "events", "event_id", "user_id", "value").select("event_id", F.round(F.col("value") - F.avg("value").over(w), 8).alias("within"), F.round(F.col("value") / F.sum("value").over(w), 9).alias("share"))


def q_cumulative(spark, d):
    return composition(t(spark, d, "lineitem", "l_returnflag"), "l_returnflag").select("l_returnflag", "n", F.round("cumulative", 9).alias("cumulative"))


def q_union(spark, d):
    a = t(spark, d, "customer", "c_custkey", "c_nationkey").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    b = t(spark, d, "supplier", "s_suppkey", "s_nationkey").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    return a.unionByName(b).groupBy("kind", "nation").agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("last_key"))


def q_union_wide(spark, d):
    a = t(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("key"))
    b = t(spark, d, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


def q_sets(spark, d):
    a = t(spark, d, "customer", "c_nationkey").select(F.col("c_nationkey").alias("k"))
    b = t(spark, d, "supplier", "s_nationkey").select(F.col("s_nationkey").alias("k"))
    name = lambda df, n: df.withColumn("op", F.lit(n))
    return name(a.intersect(b), "both").unionByName(name(a.subtract(b), "left_only")).unionByName(name(b.subtract(a), "right_only")).unionByName(name(a.union(b).distinct(), "either"))


def q_text(spark, d):
    p = t(spark, d, "pages", "page_id", "url")
    return p.select(
        "page_id", F.lower("url").alias("low"), F.char_length("url").cast("bigint").alias("n_chars"), F.substring("url", 1, 12).alias("head"),
        F.col("url").rlike("^https://").alias("secure"), F.regexp_replace("url", "[0-9]+", "N").alias("template"), F.sha2("url", 256).alias("digest"), F.concat_ws("|", F.col("page_id").cast("string"), "url").alias("both"),
    )


def q_dates(spark, d):
    o = t(spark, d, "orders", "o_orderkey", "o_orderdate")
    return o.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month_start"),
        X.after("o_orderdate", days=30).alias("plus_30_days"), F.add_months(F.to_date("o_orderdate"), 2).cast("timestamp_ntz").alias("plus_2_months"), F.hour("o_orderdate").cast("bigint").alias("hour"),
    )


def q_numbers(spark, d):
    v = F.col("value")
    return t(spark, d, "events", "event_id", "value").select(
        "event_id", F.round(F.log1p(v), 9).alias("log1p"), F.round(F.sqrt(v), 9).alias("root"), F.greatest(F.lit(10.0), F.least(v, F.lit(50.0))).alias("clipped"),
        F.round(X.logit(v / 100), 9).alias("logit"), F.round(F.try_divide(v, v - v), 9).alias("nothing"), F.round(X.e_value(1 + v / 100), 9).alias("e_value"),
    )


def q_arrays(spark, d):
    f = B.changed_files(spark, d).groupBy("pr_id").agg(F.sort_array(F.collect_set("filename")).alias("fs"))
    return f.select("pr_id", F.element_at("fs", 1).alias("first_file"), F.size("fs").cast("bigint").alias("n_files"), F.size(F.array_intersect("fs", F.array(*(F.lit(i).cast("bigint") for i in range(10))))).cast("bigint").alias("n_low"))


def q_json(spark, d):
    return t(spark, d, "events", "event_id", "props").select("event_id", F.size(F.json_object_keys("props")).cast("bigint").alias("n_keys"))


def q_hash_sample(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.md5(F.concat(F.lit("7:"), F.col("o_orderkey").cast("string"))), "o_orderkey")
    return t(spark, d, "orders", "o_orderkey", "o_orderpriority").withColumn("k", F.row_number().over(w)).filter("k <= 10").select("o_orderpriority", "o_orderkey")


QUERIES = {
    "project_filter_rename": (q_project, "SELECT o_orderkey AS order_id, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderstatus <> 'P'"),
    "isin_between": (q_isin, "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 10 AND 20"),
    "case_and_map_labels": (q_labels, "SELECT CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS status, count(*) AS n FROM orders GROUP BY 1, 2"),
    "dedup_first": (q_first, "SELECT o_custkey, o_orderdate, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1"),
    "dedup_last": (q_last, "SELECT o_custkey, o_orderdate, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1"),
    "dedup_rows": (q_distinct, "SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem"),
    "top_k": (q_topk, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "top_1_by_group": (q_top1, "SELECT o_custkey, arg_max(o_orderpriority, (n, o_orderpriority)) AS top_priority FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1"),
    "try_cast_and_null_literal": (q_trycast, "SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS number, CAST(NULL AS BIGINT) AS nothing FROM events"),
    "join_inner": (q_inner, "SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "join_left": (q_left, "SELECT c_custkey, count(o_custkey) AS n, round(coalesce(sum(o_totalprice), 0.0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    "join_full": (q_full, "SELECT coalesce(a.id, b.id) AS id, left_value, right_value FROM (SELECT doc_id AS id, doc_id * 2 AS left_value FROM documents) a FULL JOIN (SELECT o_orderkey AS id, o_custkey AS right_value FROM orders) b ON a.id = b.id"),
    "join_semi": (q_semi, "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)"),
    "join_anti": (q_anti, "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "join_interval": (q_interval, "SELECT a.event_id AS start_id, b.event_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR WHERE a.event_type = 'signup' AND b.event_type = 'purchase'"),
    "join_theta": (q_theta, "SELECT a.o_orderkey, count(*) AS n_before FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey <> a.o_orderkey AND b.o_orderdate < a.o_orderdate AND b.o_totalprice > a.o_totalprice GROUP BY 1"),
    "join_self_parent": (q_self, "SELECT p.role AS parent_role, c.role, count(*) AS n FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn + 1 = c.turn GROUP BY 1, 2"),
    "join_multi_key": (q_multikey, f"WITH {B.IX_SQL}\nSELECT a.event_id AS trigger_id, b.event_id FROM ix a JOIN ix b ON a.pr_id = b.pr_id AND a.interaction_dt = b.interaction_dt AND a.source = b.source WHERE a.source = 'error'"),
    "join_validated": (q_validated, "SELECT lang, CAST(quality AS BIGINT) AS quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2"),
    "zero_fill": (q_dimension, "WITH u AS (SELECT DISTINCT user_id FROM events), k AS (SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) AS event_type) SELECT u.user_id, k.event_type, count(e.event_id) AS n FROM u CROSS JOIN k LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = k.event_type GROUP BY 1, 2"),
    "group_aggregates": (q_aggregates, "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS low, max(l_quantity) AS high, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1, 2"),
    "quantiles_variance": (q_quantiles, "SELECT event_type, round(median(value), 9) AS median, round(quantile_cont(value, 0.25), 9) AS q1, round(quantile_cont(value, 0.9), 9) AS p90, round(var_samp(value), 6) AS variance, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY 1"),
    "distinct_with_null": (q_nunique_null, f"WITH {B.PR_SQL}\nSELECT repo_id, count(DISTINCT closed_dt) + max(CASE WHEN closed_dt IS NULL THEN 1 ELSE 0 END) AS n_closed_values, count(DISTINCT closed_dt) AS n_closed, count(*) FILTER (WHERE closed_dt IS NULL) AS n_open FROM pr GROUP BY 1"),
    "filtered_aggregates": (q_filtered, "SELECT user_id, min(ts) FILTER (WHERE event_type = 'click') AS first_click, count(*) FILTER (WHERE event_type = 'click') AS clicks, coalesce(bool_or(value > 90), false) AS any_high, coalesce(bool_and(value > 0), true) AS all_positive FROM events GROUP BY 1"),
    "first_last_by": (q_first_by, "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1"),
    "string_aggregate": (q_strings, "SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS modes FROM lineitem GROUP BY 1"),
    "pivot": (q_pivot, "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1"),
    "bins": (q_cut, "SELECT CASE WHEN value <= 10 THEN '(0,10]' WHEN value <= 50 THEN '(10,50]' ELSE '(50,inf)' END AS bin, count(*) AS n FROM events GROUP BY 1"),
    "deciles": (q_deciles, "SELECT decile, count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high FROM (SELECT *, ntile(10) OVER (ORDER BY c_acctbal, c_custkey) AS decile FROM customer) GROUP BY 1"),
    "subtotals": (q_subtotals, "SELECT coalesce(o_orderstatus, 'all') AS o_orderstatus, coalesce(o_orderpriority, 'all') AS o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "tie_counts": (q_ties, "SELECT o_orderkey, tie_n FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS tie_n FROM orders) WHERE tie_n > 1"),
    "ordinals_lag_lead": (q_ordinal, "SELECT event_id, row_number() OVER w - 1 AS place, datesub('second', lag(ts) OVER w, ts) AS gap_seconds, lead(event_type) OVER w AS next_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "demean_share": (q_demean, "SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 8) AS within, round(value / sum(value) OVER (PARTITION BY user_id), 9) AS share FROM events"),
    "cumulative_share": (q_cumulative, "SELECT l_returnflag, n, round(sum(n) OVER (ORDER BY n DESC, l_returnflag ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 9) AS cumulative FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)"),
    "union_all_tagged": (q_union, "SELECT kind, nation, count(*) AS n, max(key) AS last_key FROM (SELECT 'customer' AS kind, c_custkey AS key, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier) GROUP BY 1, 2"),
    "union_widening": (q_union_wide, "SELECT nation, count(*) AS n FROM (SELECT c_custkey AS key, NULL AS nation FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier) GROUP BY 1"),
    "set_operations": (q_sets, "SELECT c_nationkey AS k, 'both' AS op FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT c_nationkey, 'left_only' FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT s_nationkey, 'right_only' FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer) UNION ALL SELECT c_nationkey, 'either' FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)"),
    "text_scalars": (q_text, "SELECT page_id, lower(url) AS low, length(url) AS n_chars, substr(url, 1, 12) AS head, regexp_matches(url, '^https://') AS secure, regexp_replace(url, '[0-9]+', 'N', 'g') AS template, sha256(url) AS digest, concat_ws('|', CAST(page_id AS VARCHAR), url) AS \"both\" FROM pages"),
    "date_scalars": (q_dates, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start, o_orderdate + INTERVAL 30 DAY AS plus_30_days, CAST(o_orderdate + INTERVAL 2 MONTH AS TIMESTAMP) AS plus_2_months, hour(o_orderdate) AS hour FROM orders"),
    "number_scalars": (q_numbers, "SELECT event_id, round(ln(1 + value), 9) AS log1p, round(sqrt(value), 9) AS root, greatest(10.0::DOUBLE, least(value, 50.0::DOUBLE)) AS clipped, round(ln(greatest(least(value / 100, 0.999::DOUBLE), 0.001::DOUBLE) / (1 - greatest(least(value / 100, 0.999::DOUBLE), 0.001::DOUBLE))), 9) AS logit, CAST(NULL AS DOUBLE) AS nothing, round(CASE WHEN 1 + value / 100 < 1 THEN NULL ELSE 1 + value / 100 + sqrt((1 + value / 100) * (value / 100)) END, 9) AS e_value FROM events"),
    "array_scalars": (q_arrays, f"WITH {B.FILES_SQL}\nSELECT pr_id, min(filename) AS first_file, count(DISTINCT filename) AS n_files, count(DISTINCT CASE WHEN filename < 10 THEN filename END) AS n_low FROM files GROUP BY 1"),
    "json_keys": (q_json, "SELECT event_id, len(json_keys(props)) AS n_keys FROM events"),
    "hash_ordered_sample": (q_hash_sample, "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('7:' || o_orderkey), o_orderkey) AS k FROM orders) WHERE k <= 10"),
}
