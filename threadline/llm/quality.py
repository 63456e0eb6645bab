"""Quality rules: a table of thresholds compiled into one projection, without user functions.

``RULES`` names a ratio and the least and greatest value that passes.
``measure`` computes the counts of every whole text with array functions inside
its own row, so nothing is shuffled and long or repeated texts need no care.

Defined results: null or blank text has no words, fails the base rule and is
not kept; ratios over nothing are 0; null ids and repeated rows give their rows
each; an empty table gives no rows. Only ``doc_id`` and ``text`` are read, so
other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.llm.common import word_array

#: Frequent function words of the four languages; a text without any is a list or junk. Fixed values.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was were with "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "auf das dem den der die ein eine für im ist mit nicht sich sie und von zu "
    "al como con del el es las lo los más no para por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    name: str
    ratio: str
    least: float
    most: float


RULES = (
    Rule("length", "n_words", 50, 1_000_000),
    Rule("word_length", "mean_word_chars", 1.5, 20.0),
    Rule("symbols", "symbol_ratio", 0.0, 0.1),
    Rule("stop_words", "stop_ratio", 0.01, 1.0),
    Rule("repeated_lines", "dup_line_ratio", 0.0, 0.3),
)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _covered(words: Column) -> Column:
    """How many words lie in a 3-word window that the array has twice or more.

    Windows are sorted by hash with their places; equal neighbours repeat, and
    their places are then merged into a union of intervals of three.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i")))

    def repeated(s: Column) -> Column:
        return F.array_sort(F.transform(F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])), lambda x: x["i"]))

    def union(p: Column) -> Column:
        return F.coalesce(F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b), F.lit(0))

    return F.when(F.size(words) >= 4, let(F.sort_array(windows), lambda s: let(repeated(s), union))).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the ratios that RULES name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(
        word_array("text"),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _covered(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).alias("n_stop"),
        ),
    )
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    raw = docs.select("doc_id", counts.alias("c"), line_counts.alias("l"), F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    words, line = F.greatest(F.col("c.n_words"), F.lit(1)), F.greatest(F.col("l.n_lines"), F.lit(1))
    return raw.select(
        "doc_id", "c.n_words", "c.word_chars", "n_symbols", "l.n_dup_lines", "c.n_repeat_words",
        (F.col("c.word_chars") / words).alias("mean_word_chars"),
        (F.col("n_symbols") / words).alias("symbol_ratio"),
        (F.col("c.n_stop") / words).alias("stop_ratio"),
        (F.col("l.n_dup_lines") / line).alias("dup_line_ratio"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression."""
    passed = F.lit(True)
    for r in rules:
        passed = passed & F.col(r.ratio).between(r.least, r.most)
    return passed


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    return F.filter(F.array(*(F.when(~F.col(r.ratio).between(r.least, r.most), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())


def op8(docs: DataFrame) -> DataFrame:
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measure(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & verdict()).alias("kept"), F.array_join(failed_rules(), ",").alias("failed_rules"),
    )


_RATIOS = {
    "n_words": "n_words",
    "mean_word_chars": "word_chars / greatest(n_words, 1)::DOUBLE",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)::DOUBLE",
    "stop_ratio": "n_stop / greatest(n_words, 1)::DOUBLE",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)::DOUBLE",
}


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """op8 as DuckDB SQL: words and their windows as rows, in place of arrays."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    failed = ", ".join(f"CASE WHEN NOT ({_RATIOS[r.ratio]} BETWEEN {r.least!r} AND {r.most!r}) THEN '{r.name}' END" for r in rules)
    return f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM a),
n AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (WHERE lower(w) IN ({stop})) AS n_stop FROM w GROUP BY r),
g AS (SELECT r, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
f AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM g WHERE g IS NOT NULL) WHERE k > 1),
p AS (SELECT r, count(DISTINCT i + d) AS n_repeat_words FROM f, range(3) x(d) GROUP BY r),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stop, 0) AS n_stop, len(ls) AS n_lines
  FROM t JOIN a USING (r) LEFT JOIN n USING (r) LEFT JOIN p USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {failed}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v"""
