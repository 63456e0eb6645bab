"""Secret scans over an incremental ledger of blobs, with DataFrame functions only.

Each version of a text is addressed by the SHA-256 of its content. The ledger is
a Parquet folder of (blob_id, rules scanned as kind@version, spans); a scan
takes only the pairs of blob and rule version that the ledger lacks, one text
per blob however many paths hold it, appends what it found and joins the ledger
back to all paths. Changing a rule's version rescans that rule alone.

Defined results: null text is empty and has no spans; null doc_ids are paths
like others; repeated rows give repeated results; an empty table gives none.
Whole texts are scanned, however long. Only ``doc_id`` and ``text`` are read, so
other columns may have any names. A hot blob is scanned once, and the join back
to its paths is one that Spark may split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from threadline.llm.common import work_dir

#: They mark matches inside a text; the same characters in a text are replaced first, which no rule can see.
OPEN, MIDDLE, OTHER = "\ue000", "\ue001", "\ue002"


@dataclass(frozen=True)
class Rule:
    """pattern: two groups; a match counts if the second, or without ``value_only`` the whole, has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    least: int
    value_only: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The first three are the base kinds, in their order.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 8, True),
    Rule("access", 1, r"()(AKIA[A-Z0-9]+)", 16),
    Rule("hex", 1, r"()([0-9a-f]{32,})", 32),
    Rule("github", 1, r"()(gh[pousr]_[A-Za-z0-9]{36,})", 40),
    Rule("jwt", 1, r"()(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 29),
    Rule("pem", 1, r"()(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 27),
)
SPAN = "array<struct<start:int,kind_order:int,kind:string,end:int>>"


def blob_id() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def parts(text: Column, rule: Rule) -> Column:
    """Lengths of the parts of a text in turn: before a match, its first group, its second, and so on; null without a match."""
    marked = F.regexp_replace(F.translate(text, OPEN + MIDDLE, OTHER * 2), rule.pattern, f"{OPEN}$1{MIDDLE}$2{OPEN}")
    return F.when(text.rlike(rule.pattern), F.transform(F.split(marked, f"[{OPEN}{MIDDLE}]"), lambda p: F.length(p)))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob_id, rules, spans of blobs (blob_id, todo array<string>, text): each rule of todo over the whole text.

    Matches are marked and the text is split at the marks; places are running sums of the parts' lengths, which are
    rows here, so the work grows with the number of matches. Blobs lie together by their id already, so neither the
    sums nor the collecting of spans moves a row.
    """
    text = F.coalesce("text", F.lit(""))
    each = [F.struct(F.lit(i).alias("o"), F.when(F.array_contains("todo", r.key), parts(text, r)).alias("sizes")) for i, r in enumerate(rules)]
    found = blobs.select("blob_id", "todo", F.explode_outer(F.filter(F.array(*each), lambda x: x["sizes"].isNotNull())).alias("m"))
    rows = found.select("blob_id", "todo", F.col("m.o").alias("o"), F.posexplode_outer("m.sizes").alias("i", "n"))
    turn = Window.partitionBy("blob_id", "o").orderBy("i")
    end, head = F.sum("n").over(turn.rowsBetween(Window.unboundedPreceding, 0)).cast("int"), F.lag("n").over(turn)
    placed = rows.select("blob_id", "todo", "o", "i", "n", end.alias("end"), head.alias("head")).withColumn("start", F.col("end") - F.col("n") - F.col("head"))
    least, kind, value = (F.array(*map(F.lit, xs))[F.col("o")] for xs in ([r.least for r in rules], [r.kind for r in rules], [r.value_only for r in rules]))
    size = F.when(value, F.col("n")).otherwise(F.col("end") - F.col("start"))
    span = F.struct("start", F.col("o").alias("kind_order"), kind.alias("kind"), "end")
    counts = (F.col("i") % 3 == 2) & (size >= least)
    return placed.groupBy("blob_id").agg(F.first("todo").alias("rules"), F.array_sort(F.collect_list(F.when(counts, span))).cast(SPAN).alias("spans"))


def read_ledger(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"blob_id binary, rules array<string>, spans {SPAN}").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def update(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at path lacks, append it, and return the ledger."""
    spark = docs.sparkSession
    keys = F.array(*(F.lit(r.key) for r in rules))
    # One text of each blob, taken map-side first: a hot blob is one row of each task.
    blobs = docs.select(blob_id().alias("blob_id"), F.coalesce("text", F.lit("")).alias("text")).groupBy("blob_id").agg(F.first("text").alias("text"))
    ledger = read_ledger(spark, path)
    if ledger is None:
        todo = blobs.withColumn("todo", keys)
    else:
        done = ledger.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
        todo = blobs.join(done, "blob_id", "left").withColumn("todo", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>")))).filter(F.size("todo") > 0)
    scan(todo, rules).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans of every path, for the given rule versions."""
    version = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.key)))
    current = ledger.select("blob_id", F.filter("spans", lambda s: F.array_contains(F.col("rules"), F.element_at(version, s["kind"]))).alias("spans"))
    # equal spans lie side by side once sorted; array_distinct compares all with all, as it can't hash structs
    each_once = F.transform(F.array(F.array_sort(F.flatten(F.collect_list("spans")))), lambda s: F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1))))[0]
    per_blob = current.groupBy("blob_id").agg(each_once.alias("spans"))
    return docs.select("doc_id", blob_id().alias("blob_id")).join(per_blob, "blob_id")


def op10(docs: DataFrame) -> DataFrame:
    path = work_dir(docs.sparkSession)
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind_order"] < 3)

    def joined(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return findings(docs, update(docs, path)).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans")
    )


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """op10 as DuckDB SQL: a text is split at a rule's matches, and lengths of parts and matches add up to places."""

    def each(i: int, r: Rule) -> str:
        p = "'" + r.pattern.replace("'", "''") + "'"
        value = f"regexp_extract_all(text, {p}, 2)" if r.value_only else f"regexp_extract_all(text, {p})"
        return f"SELECT r, {i} AS o, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(text, {p}) AS ps, regexp_extract_all(text, {p}) AS ms, {value} AS vs FROM t WHERE regexp_matches(text, {p})"

    def joined(where: str = "") -> str:
        return f"coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o){where}, '')"

    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(each(i, r) for i, r in enumerate(rules))}),
k AS (SELECT r, o, kind, least, generate_subscripts(ms, 1) AS k, unnest(ms) AS m, unnest(vs) AS v, unnest(ps[1:len(ms)]) AS p FROM f),
s AS (SELECT r, o, kind, least, v, sum(length(p) + length(m)) OVER (PARTITION BY r, o ORDER BY k) AS b, length(m) AS n FROM k),
u AS (SELECT r, o, kind, CAST(b - n AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM s WHERE length(v) >= least)
SELECT any_value(doc_id) AS doc_id, {counts}, sha256({joined(" FILTER (WHERE o < 3)")}) AS base_sha256, {joined(" FILTER (WHERE o IS NOT NULL)")} AS spans FROM t LEFT JOIN u USING (r) GROUP BY r"""
