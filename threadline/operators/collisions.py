"""Comments of several products at one place of one snapshot, and blinded packets of them for raters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadline.functions.replies import packet_text

PLACE = ("pr_id", "commit_id", "path", "position")
#: The texts of a packet: two sides, each with its comment and the context it was made in, and their limits.
LIMITS = {"body": 2500, "diff_hunk": 1500}


def unambiguous(reviews: DataFrame) -> DataFrame:
    """review_id, pr_id of the reviews that belong to one item only."""
    one = reviews.filter("review_id is not null and pr_id is not null").groupBy("review_id").agg(F.min("pr_id").alias("pr_id"), F.max("pr_id").alias("_last"))
    return one.filter("pr_id = _last").drop("_last")


def marked(comments: DataFrame, reviews: DataFrame, items: DataFrame) -> DataFrame:
    """Comments with their item and its times, and one flag for each condition, each of which includes the former ones."""
    known = comments.join(unambiguous(reviews), "review_id", "left").join(items.select("pr_id", "repo_id", "created_dt", "closed_dt"), "pr_id", "left")
    path = F.col("path").isNotNull() & (F.length(F.trim("path")) > 0)
    place = F.coalesce(F.col("commit_id").rlike("^[0-9a-fA-F]{40}$"), F.lit(False)) & path & F.coalesce(F.col("position") > 0, F.lit(False))
    conditions = {
        "top_level": F.col("parent_id").isNull(),
        "known_item": F.col("pr_id").isNotNull(),
        "mapped": F.col("product").isNotNull(),
        "timed": F.col("comment_dt").isNotNull() & F.col("created_dt").isNotNull(),
        "valid_place": place,
        "after_creation": F.coalesce(F.col("comment_dt") >= F.col("created_dt"), F.lit(False)),
    }
    so_far, flags = F.lit(True), {}
    for name, condition in conditions.items():
        so_far = so_far & condition
        flags[name] = so_far
    return known.withColumns(flags)


def strict_comments(marked_comments: DataFrame) -> DataFrame:
    """The valid comments at places where at least two products comment, on items where they do."""
    valid = marked_comments.filter("after_creation")
    item, place = Window.partitionBy("pr_id"), Window.partitionBy(*PLACE)

    def several(w) -> Column:
        return F.min("product").over(w) != F.max("product").over(w)

    return valid.withColumn("_item", several(item)).filter("_item").withColumn("_place", several(place)).filter("_place").drop("_item", "_place")


def waterfall(marked_comments: DataFrame, cutoff: Column) -> DataFrame:
    """step, stage, n: comments left after each condition, two subsets for sensitivity, and items and places of several products."""
    flags = ["top_level", "known_item", "mapped", "timed", "valid_place", "after_creation"]
    valid = F.col("after_creation")
    counts = marked_comments.agg(
        F.count(F.lit(1)).alias("source"), *(F.count_if(f).alias(f) for f in flags),
        F.count_if(valid & (F.col("comment_dt") <= cutoff)).alias("within_cutoff"), F.count_if(valid & (F.col("closed_dt").isNull() | (F.col("comment_dt") <= F.col("closed_dt")))).alias("before_close"),
    )
    of_items = marked_comments.filter(valid).groupBy("pr_id").agg((F.min("product") != F.max("product")).alias("several")).agg(F.count_if("several").alias("items_of_several"))
    places = strict_comments(marked_comments).groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("places"), F.coalesce(F.sum("n"), F.lit(0)).alias("comments_at_places"))
    stages = ["source", *flags, "within_cutoff", "before_close", "items_of_several", "places", "comments_at_places"]
    rows = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), F.col(s).cast("bigint").alias("n")) for i, s in enumerate(stages)))
    return counts.crossJoin(F.broadcast(of_items)).crossJoin(F.broadcast(places)).select(F.inline(rows))


def collision_pairs(strict: DataFrame) -> DataFrame:
    """At each place the first comment and the first one by another product, by time, then id.

    The first comment of another product than the first one's is the second of the products' first comments; so a place
    is a row per product before it is one row, however many comments it has. Texts may be left out of strict and be
    added to the pairs, so that what is sorted stays narrow.
    """
    sides = ("comment_dt", "event_id", "product", "actor_login", "review_id", *(c for c in LIMITS if c in strict.columns))
    of_product = strict.groupBy(*PLACE, "repo_id", "closed_dt", F.col("product").alias("_p")).agg(F.min(F.struct(*sides)).alias("c"), F.count(F.lit(1)).alias("n"))
    of_place = of_product.groupBy(*PLACE, "repo_id", "closed_dt").agg(F.array_sort(F.collect_list("c")).alias("c"), F.sum("n").alias("n_comments"), F.count(F.lit(1)).alias("n_products")).filter("n_products >= 2")
    a, b = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    key = F.concat_ws("|", *(F.col(k).cast("string") for k in PLACE), a["event_id"].cast("string"), b["event_id"].cast("string"))

    def late(side: Column) -> Column:
        return F.coalesce(side["comment_dt"] > F.col("closed_dt"), F.lit(False))

    return of_place.select(
        F.concat(F.lit("RC-"), F.upper(F.substring(F.sha2(key, 256), 1, 12))).alias("record_id"), *PLACE, "repo_id",
        *(side[c].alias(f"{name}_{c}") for name, side in (("first", a), ("second", b)) for c in sides),
        F.concat_ws(" + ", F.array_sort(F.array(a["product"], b["product"]))).alias("product_pair"),
        late(a).alias("first_after_close"), late(b).alias("second_after_close"), F.timestamp_diff("SECOND", a["comment_dt"], b["comment_dt"]).alias("gap_seconds"), "n_products", "n_comments",
    )


def _swapped(seed: int) -> Column:
    """Whether a record shows its second side first: half of them, by a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "record_id")), 1, 2), 16, 10).cast("int") % 2 == 1


def packets(pairs: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Blinded packets and the key to them, from one pass over the pairs.

    A packet has a record's texts as sides A and B, marked and cut, with the digests of the whole marked texts and what
    kind of file they lie in; which side is the earlier comment, and everything that names a product, person or place,
    is in the key alone. ``order_1`` and ``order_2`` give two raters different orders of the same records.
    """
    sides = {f"{s}_{c}": packet_text(F.col(f"{s}_{c}"), limit) for s in ("first", "second") for c, limit in LIMITS.items()}
    swap = _swapped(seed)
    texts = pairs.withColumns({f"_{k}": v for k, v in sides.items()}).withColumn("swapped", swap)
    shown = []
    for name, own, other in (("a", "first", "second"), ("b", "second", "first")):
        for c in LIMITS:
            side = F.when(F.col("swapped"), F.col(f"_{other}_{c}")).otherwise(F.col(f"_{own}_{c}"))
            shown += [side["text"].alias(f"{c}_{name}"), side["digest"].alias(f"{c}_{name}_sha256"), side["cut"].alias(f"{c}_{name}_cut")]
    suffix = F.substring(F.lower(F.regexp_extract("path", r"[^/.][^/]*?(\.[^./]+)$", 1)), 1, 16)
    orders = [F.md5(F.concat_ws(":", F.lit(f"{seed}/{k}"), "record_id")).alias(f"order_{k}") for k in (1, 2)]
    hidden = [c for c in pairs.columns if c not in {f"{s}_{c}" for s in ("first", "second") for c in LIMITS}]
    return texts.select("record_id", suffix.alias("suffix"), *shown, *orders), pairs.withColumn("swapped", swap).select(*hidden, "swapped")


def packet_counts(pairs: DataFrame) -> DataFrame:
    """field, records, marked (with a secret), cut: how many records lose something in each kind of text, and in any."""
    of = {c: [packet_text(F.col(f"{s}_{c}"), limit) for s in ("first", "second")] for c, limit in LIMITS.items()}
    rows = F.array(*(F.struct(F.lit(c).alias("field"), (a["secret"] | b["secret"]).alias("secret"), (a["cut"] | b["cut"]).alias("cut")) for c, (a, b) in of.items()))
    each = pairs.select("record_id", rows.alias("r")).select("record_id", F.inline(F.concat("r", F.array(F.struct(F.lit("any").alias("field"), F.exists("r", lambda x: x["secret"]).alias("secret"), F.exists("r", lambda x: x["cut"]).alias("cut"))))))
    return each.groupBy("field").agg(F.count(F.lit(1)).alias("records"), F.count_if("secret").alias("marked"), F.count_if("cut").alias("cut"))


def mean_rarity(items: DataFrame, group: str, kind: str, earlier: Column, role: str) -> DataFrame:
    """group, role, n, rarity of later items: 1 less the share that an item's kind had among the group's earlier ones, which stay as they were; a new kind has 1."""
    rows = items.filter(F.col(kind).isNotNull()).withColumn("_early", F.coalesce(earlier, F.lit(False)))
    before = rows.filter("_early").groupBy(group, kind).agg(F.count(F.lit(1)).alias("_n"))
    total = before.groupBy(group).agg(F.sum("_n").alias("_t"))
    later = rows.filter("not _early").join(total, group).join(before, [group, kind], "left")
    return later.groupBy(group, role).agg(F.count(F.lit(1)).alias("n"), F.avg(1 - F.coalesce(F.col("_n"), F.lit(0)) / F.col("_t")).alias("rarity"))
