"""Queries for coverage, waterfalls, samples, checks, contracts and concentration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadline.functions import columns as X
from threadline.operators import audit
from threadline.plans.cohorts import RESPONSE_SQL, TRIGGER_SQL, chains, responses, triggers
from threadline.sources import bindings as B
from threadline.sources.tables import list_lengths, read_table
from threadline.stats import concentration


def t(spark, d, name, *columns):
    return read_table(spark, d, name, columns)


def q_overlap(spark, d):
    return audit.key_overlap(t(spark, d, "documents", "doc_id"), t(spark, d, "orders", "o_orderkey").withColumnRenamed("o_orderkey", "doc_id"), "doc_id")


def steps() -> dict[str, Column]:
    return {"all": F.lit(True), "closed": F.col("closed_dt").isNotNull(), "merged": F.col("merged_dt").isNotNull(), "within_30_days": F.col("merged_dt") <= X.after("created_dt", days=30), "urgent": F.col("agent") == "1-URGENT"}


def q_waterfall(spark, d):
    return audit.waterfall(B.pull_requests(spark, d), steps())


def q_checks(spark, d):
    checks = {
        "created_known": (F.col("created_dt").isNotNull(), "error"),
        "closed_after_created": (F.col("closed_dt").isNull() | (F.col("closed_dt") >= F.col("created_dt")), "error"),
        "merged_is_closed": (F.col("merged_dt").isNull() | (F.col("merged_dt") == F.col("closed_dt")), "error"),
        "closed_known": (F.col("closed_dt").isNotNull(), "warning"),
    }
    return audit.check_table(B.pull_requests(spark, d), checks)


def q_profile(spark, d):
    return audit.profile(B.pull_requests(spark, d), ["pr_id", "agent", "repo_id"])


def q_sample(spark, d):
    out = audit.sample_by_hash(t(spark, d, "documents", "doc_id", "lang"), ["lang"], "doc_id", 12, 3)
    return out.select("lang", "doc_id", F.round("design_weight", 9).alias("design_weight"))


def q_weighted(spark, d):
    docs = t(spark, d, "documents", "doc_id", "n_chars")
    return audit.weighted_sample(docs, "doc_id", F.col("n_chars").cast("double"), 40, 5).select("doc_id")


def q_difference(spark, d):
    return audit.set_difference(t(spark, d, "documents", "doc_id"), t(spark, d, "orders", "o_orderkey").withColumnRenamed("o_orderkey", "doc_id"))


def codes() -> dict[str, Column]:
    return {
        "RESPONSE_NOT_AFTER_TRIGGER": F.col("interaction_dt") <= F.col("trigger_dt"),
        "RESPONSE_AFTER_WINDOW": F.col("interaction_dt") > X.after("trigger_dt", days=3),
        "PARENT_IS_OTHER_EVENT": F.col("parent_id").isNotNull() & (F.col("parent_id") != F.col("trigger_event_id")),
        "SAME_ACTOR_AS_AUTHOR": F.col("actor_login") == F.col("author_login"),
    }


def q_contracts(spark, d):
    out = audit.violations(responses(spark, d), codes())
    return out.select("pr_id", "event_id", F.array_join("violations", ",").alias("violations"))


def q_state_at(spark, d):
    ix = B.interactions(spark, d)
    return audit.state_at(ix, "pr_id", "source", "interaction_dt", "event_id", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


def q_zero(spark, d):
    return audit.zero_filled(responses(spark, d), "owner", ["author_human", "other_human", "author_agent", "triggering_reviewer", "other_bot", "unknown"])


def q_scores(spark, d):
    e = t(spark, d, "events", "event_id", "user_id", "ts", "props")
    out = audit.account_scores(e, "user_id", "ts", "props")
    return out.select("user_id", "n", *(F.round(c, 9).alias(c) for c in ("duplicate_share", "gap_cv", "hour_entropy", "per_active_day")), "active_days")


def q_composition(spark, d):
    out = concentration.composition(responses(spark, d), "repo_id")
    return out.select("repo_id", "n", F.col("place").cast("bigint").alias("place"), F.round("share", 9).alias("share"), F.round("cumulative", 9).alias("cumulative"))


def q_concentration(spark, d):
    out = concentration.concentration(responses(spark, d), "repo_id", 5)
    return out.select("n_groups", *(F.round(c, 9).alias(c) for c in ("hhi", "largest_share", "top_share", "gini")))


def q_jsd(spark, d):
    return concentration.jensen_shannon(B.interactions(spark, d), "source", "author_agent", "A", "B").select(F.round("distance", 9).alias("distance"))


def q_rarefied(spark, d):
    out = concentration.rarefied(B.interactions(spark, d), "pr_id", "source", 10)
    return out.select("pr_id", F.round("kinds", 9).alias("kinds"))


def q_roots(spark, d):
    """Root and reply events, orphans, and replies that are replied to."""
    ix = B.interactions(spark, d).select("pr_id", "event_id", "parent_id")
    replies = ix.filter("parent_id is not null")
    ids = ix.select(F.col("event_id").alias("parent_id"))
    return ix.agg(F.count_if(F.col("parent_id").isNull()).alias("roots"), F.count("parent_id").alias("replies")).crossJoin(
        replies.join(ids, "parent_id", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    ).crossJoin(replies.alias("r").join(replies.select(F.col("parent_id").alias("p")), F.col("event_id") == F.col("p"), "left_semi").agg(F.count(F.lit(1)).alias("nested")))


def q_lists(spark, d):
    return list_lengths(t(spark, d, "embeddings", "vec_id", "embedding"), "embedding")


def q_threads(spark, d):
    """Turns of each conversation as a nested list and back: what the nested profile reads."""
    c = t(spark, d, "conversations", "conv_id", "turn", "role", "text")
    nested = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.char_length("text").alias("n_chars")))).alias("turns"))
    flat = nested.select("conv_id", F.posexplode_outer("turns").alias("place", "x"))
    return flat.select("conv_id", F.col("place").cast("bigint").alias("place"), F.col("x.role").alias("role"), F.col("x.n_chars").cast("bigint").alias("n_chars"))


def q_triggers_by(spark, d):
    tr = triggers(spark, d)
    return tr.groupBy("trigger_source", F.date_format("trigger_dt", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.concat_ws(">", "author_agent", "trigger_agent")).alias("n_pairs"))


def q_gap(spark, d):
    """How the prevalence of each trait differs between items with and without a reply."""
    c = chains(spark, d).withColumn("arm", F.col("exact_replies") > 0)
    rows = F.array(*(F.struct(F.lit(n).alias("trait"), F.col(n).cast("double").alias("v")) for n in ("later_views", "later_clicks", "movements")))
    long = c.select("arm", F.explode(rows).alias("x")).select("arm", "x.*")
    return long.groupBy("trait").agg(F.round(F.avg(F.when(F.col("arm"), F.col("v"))) - F.avg(F.when(~F.col("arm"), F.col("v"))), 9).alias("gap"))


_C = RESPONSE_SQL + """,
ch AS (SELECT tr.pr_id, coalesce(k.a, 0) AS exact_replies, coalesce(b, 0) AS later_views, coalesce(c, 0) AS later_clicks, coalesce(e, 0) AS movements
  FROM tr LEFT JOIN (SELECT pr_id, count(*) FILTER (WHERE exact_reply) AS a, count(*) FILTER (WHERE source = 'view') AS b, count(*) FILTER (WHERE source = 'click') AS c, count(*) FILTER (WHERE source = 'purchase') AS e FROM rs GROUP BY 1) k USING (pr_id))"""

QUERIES = {
    "key_overlap": (q_overlap, "WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT o_orderkey AS doc_id FROM orders) SELECT (SELECT count(*) FROM a) AS left_keys, (SELECT count(*) FROM b) AS right_keys, (SELECT count(*) FROM a SEMI JOIN b USING (doc_id)) AS shared, (SELECT count(*) FROM a ANTI JOIN b USING (doc_id)) AS left_only, (SELECT count(*) FROM b ANTI JOIN a USING (doc_id)) AS right_only"),
    "population_waterfall": (
        q_waterfall,
        f"""WITH {B.PR_SQL}, s AS (SELECT count(*) AS a, count(*) FILTER (WHERE closed_dt IS NOT NULL) AS b, count(*) FILTER (WHERE merged_dt IS NOT NULL) AS c, count(*) FILTER (WHERE merged_dt <= created_dt + INTERVAL 30 DAY) AS d,
  count(*) FILTER (WHERE merged_dt <= created_dt + INTERVAL 30 DAY AND agent = '1-URGENT') AS e FROM pr)
SELECT step, condition, n FROM s, LATERAL (VALUES (0, 'all', a), (1, 'closed', b), (2, 'merged', c), (3, 'within_30_days', d), (4, 'urgent', e)) v(step, condition, n)""",
    ),
    "quality_checks": (
        q_checks,
        f"""WITH {B.PR_SQL}, s AS (SELECT count(*) FILTER (WHERE created_dt IS NULL) AS a, count(*) FILTER (WHERE closed_dt < created_dt) AS b, count(*) FILTER (WHERE merged_dt IS NOT NULL AND merged_dt IS DISTINCT FROM closed_dt) AS c, count(*) FILTER (WHERE closed_dt IS NULL) AS d FROM pr)
SELECT "check", severity, n AS violations, n = 0 AS passed FROM s, LATERAL (VALUES ('created_known', 'error', a), ('closed_after_created', 'error', b), ('merged_is_closed', 'error', c), ('closed_known', 'warning', d)) v("check", severity, n)""",
    ),
    "column_profile": (
        q_profile,
        f"""WITH {B.PR_SQL}, l AS (SELECT 'pr_id' AS "column", CAST(pr_id AS VARCHAR) AS v FROM pr UNION ALL SELECT 'agent', agent FROM pr UNION ALL SELECT 'repo_id', CAST(repo_id AS VARCHAR) FROM pr)
SELECT "column", count(*) AS n_rows, count(*) FILTER (WHERE v IS NULL) AS n_null, count(DISTINCT v) AS n_distinct, min(v) AS least, max(v) AS greatest FROM l GROUP BY 1""",
    ),
    "stratified_sample": (q_sample, "SELECT lang, doc_id, round(CAST(size AS DOUBLE) / least(size, 12), 9) AS design_weight FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('3:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS size FROM documents) WHERE k <= 12"),
    "weighted_sample": (q_weighted, "SELECT doc_id FROM (SELECT doc_id, pow((CAST(('0x' || substr(md5('5:' || doc_id), 1, 12)) AS BIGINT) + 1) / 281474976710657.0::DOUBLE, 1 / CAST(n_chars AS DOUBLE)) AS k FROM documents) ORDER BY k DESC, doc_id LIMIT 40"),
    "set_difference": (q_difference, "SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT o_orderkey FROM orders) UNION ALL SELECT doc_id, 'right' FROM (SELECT o_orderkey AS doc_id FROM orders EXCEPT ALL SELECT doc_id FROM documents)"),
    "contract_violations": (
        q_contracts,
        f"""WITH {RESPONSE_SQL}
SELECT pr_id, event_id, concat_ws(',', CASE WHEN interaction_dt <= trigger_dt THEN 'RESPONSE_NOT_AFTER_TRIGGER' END, CASE WHEN interaction_dt > trigger_dt + INTERVAL 3 DAY THEN 'RESPONSE_AFTER_WINDOW' END,
  CASE WHEN parent_id <> trigger_event_id THEN 'PARENT_IS_OTHER_EVENT' END, CASE WHEN actor_login = author_login THEN 'SAME_ACTOR_AS_AUTHOR' END) AS violations FROM rs""",
    ),
    "state_at_landmark": (q_state_at, "SELECT user_id AS pr_id, arg_max(event_type, (ts, event_id)) AS state FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1"),
    "zero_filled_counts": (q_zero, f"WITH {RESPONSE_SQL}, k AS (SELECT unnest(['author_human', 'other_human', 'author_agent', 'triggering_reviewer', 'other_bot', 'unknown']) AS owner) SELECT k.owner, count(rs.owner) AS n FROM k LEFT JOIN rs ON rs.owner = k.owner GROUP BY 1"),
    "account_scores": (
        q_scores,
        """WITH g AS (SELECT *, CAST(datesub('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS DOUBLE) AS gap FROM events),
b AS (SELECT user_id, count(*) AS n, 1 - CAST(count(DISTINCT props) AS DOUBLE) / count(props) AS dup, stddev_samp(gap) / nullif(avg(gap), 0) AS cv, count(DISTINCT CAST(ts AS DATE)) AS days FROM g GROUP BY 1),
h AS (SELECT user_id, hour(ts) AS h, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY 1, 2), e AS (SELECT user_id, -sum(p * log2(p)) AS entropy FROM h GROUP BY 1)
SELECT user_id, n, round(dup, 9) AS duplicate_share, round(cv, 9) AS gap_cv, round(entropy, 9) AS hour_entropy, round(CAST(n AS DOUBLE) / days, 9) AS per_active_day, days AS active_days FROM b JOIN e USING (user_id)""",
    ),
    "composition": (q_composition, f"WITH {RESPONSE_SQL}, c AS (SELECT repo_id, count(*) AS n FROM rs GROUP BY 1) SELECT repo_id, n, row_number() OVER (ORDER BY n DESC, repo_id) AS place, round(n / sum(n) OVER (), 9) AS share, round(sum(n) OVER (ORDER BY n DESC, repo_id ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 9) AS cumulative FROM c"),
    "concentration": (
        q_concentration,
        f"""WITH {RESPONSE_SQL}, c AS (SELECT repo_id, CAST(count(*) AS DOUBLE) AS n FROM rs GROUP BY 1), p AS (SELECT n, n / sum(n) OVER () AS s, row_number() OVER (ORDER BY n DESC, repo_id) AS k, row_number() OVER (ORDER BY n, repo_id DESC) AS up FROM c)
SELECT count(*) AS n_groups, round(sum(s * s), 9) AS hhi, round(max(s), 9) AS largest_share, round(sum(s) FILTER (WHERE k <= 5), 9) AS top_share, round(2 * sum(up * n) / (count(*) * sum(n)) - (count(*) + 1.0::DOUBLE) / count(*), 9) AS gini FROM p""",
    ),
    "jensen_shannon": (
        q_jsd,
        f"""WITH {B.IX_SQL}, c AS (SELECT source, CAST(count(*) FILTER (WHERE author_agent = 'A') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE author_agent = 'B') AS DOUBLE) AS b FROM ix GROUP BY 1), p AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c)
SELECT round(sqrt(sum(0.5::DOUBLE * p * ln(p / ((p + q) / 2)) + 0.5::DOUBLE * q * ln(q / ((p + q) / 2)))), 9) AS distance FROM p""",
    ),
    "rarefied_breadth": (
        q_rarefied,
        f"""WITH {B.IX_SQL}, k AS (SELECT pr_id, source, count(*) AS k, CAST(sum(count(*)) OVER (PARTITION BY pr_id) AS BIGINT) AS total FROM ix GROUP BY 1, 2),
f AS (SELECT pr_id, source, product(greatest(0.0::DOUBLE, CAST(total - k - i AS DOUBLE)) / greatest(1.0::DOUBLE, CAST(total - i AS DOUBLE))) AS absent FROM k, range(10) r(i) WHERE total >= 10 GROUP BY 1, 2)
SELECT pr_id, round(sum(1 - absent), 9) AS kinds FROM f GROUP BY 1""",
    ),
    "reply_depth": (
        q_roots,
        f"""WITH {B.IX_SQL}, r AS (SELECT * FROM ix WHERE parent_id IS NOT NULL) SELECT (SELECT count(*) FROM ix WHERE parent_id IS NULL) AS roots, (SELECT count(*) FROM r) AS replies,
  (SELECT count(*) FROM r WHERE parent_id NOT IN (SELECT event_id FROM ix)) AS orphans, (SELECT count(*) FROM r WHERE event_id IN (SELECT parent_id FROM r)) AS nested""",
    ),
    "list_lengths": (q_lists, "SELECT CAST(sum(len(embedding)) AS BIGINT) AS total, count(*) FILTER (WHERE len(embedding) > 0) AS positive, max(len(embedding)) AS longest FROM embeddings"),
    "nested_threads": (q_threads, "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, length(text)) - 1 AS place, role, length(text) AS n_chars FROM conversations"),
    "trigger_channels": (q_triggers_by, f"WITH {TRIGGER_SQL} SELECT trigger_source, strftime(trigger_dt, '%Y-%m') AS month, count(*) AS n, count(DISTINCT author_agent || '>' || trigger_agent) AS n_pairs FROM tr GROUP BY 1, 2"),
    "prevalence_gap": (
        q_gap,
        f"""WITH {_C}, l AS (SELECT exact_replies > 0 AS arm, unnest([{{'t': 'later_views', 'v': later_views}}, {{'t': 'later_clicks', 'v': later_clicks}}, {{'t': 'movements', 'v': movements}}]) AS x FROM ch)
SELECT x.t AS trait, round(avg(x.v) FILTER (WHERE arm) - avg(x.v) FILTER (WHERE NOT arm), 9) AS gap FROM l GROUP BY 1""",
    ),
}
