"""Findings of a review of queries on titles: each test failed before its finding was settled."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from threadline.functions import text as T
from threadline.operators import learn, textmatch
from threadline.plans.texts import QUERIES

PAGES = ["<title>a &amp; b&amp</title>", "<title>x &amp;lt; &lt;b&gt; &quot;q&quot; &#39;s&#39;&nbsp;&copy; &am</title><a href=", "no title", "<title></title>", None]


def test_page_titles_cut_inside_a_reference(spark, tmp_path):
    """A title cut inside a reference keeps the rest of it, as the SQL has it."""
    rows = list(enumerate(PAGES))
    spark.createDataFrame(rows, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    plan, sql = QUERIES["page_titles"]
    got = sorted(map(tuple, plan(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(sql).fetchall())
    assert got[0][1] == "a & b&amp"


def test_blend_plan_is_small(spark):
    """The table of references is no part of the plan that the driver holds for each step."""
    plan = QUERIES["title_similarity_blend"][0](spark, "/root/testdata/sf0.001")
    assert len(plan._jdf.queryExecution().toString()) < 200_000
    assert plan.count() == plan.select("left_id", "right_id").distinct().count()


def test_tfidf_counts_within_rows_without_moving_grams(spark):
    """Texts are dealt by their row; of the exchanges under the weights none deals grams by row and gram."""
    df = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "row bigint, text string")
    weights = textmatch.tfidf(df, "row", textmatch.word_grams("text", 1))
    assert "hashpartitioning(row#" in (plan := weights._jdf.queryExecution().executedPlan().toString())
    assert not re.search(r"hashpartitioning\(row#\d+L, gram#\d+", plan)
    got = {(r.row, r.gram): r.weight for r in weights.collect()}
    x, y = (1 + math.log(2)) * (math.log(4 / 2) + 1), math.log(4 / 3) + 1
    assert set(got) == {(1, "a"), (1, "b"), (2, "b"), (2, "c")}
    assert got[1, "a"] == pytest.approx(x / math.hypot(x, y))


def test_blend_moves_no_grams_of_rows(spark, tmp_path, monkeypatch):
    """Each gram of each row went through the shuffles of weights, lengths and pairs; now blocks have theirs once, with the same cosines."""
    monkeypatch.setattr(textmatch, "BLOCK", 300)
    monkeypatch.setattr(textmatch, "HELD", 40)
    texts = ["the cat sat on the mat", "the cat ran, the dog sat", None, "", "x", "naïve \U0001f600 café café", "the mat", "café x the cat 0-1", "b", "  the   cat  "]
    rows = [(k, t, texts[(k * 7 + t * 3) % len(texts)]) for k in range(40) for t in range(1, 1 + k % 4)] + [(3, 2, "a copy of a row"), (5, 2, "the cat sat"), (None, 1, "no id"), (None, 2, "no id")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, text string").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row"), "conv_id", "turn", T.normalise("text").alias("normalised"))
    pairs = turns.alias("a").join(turns.alias("b"), F.expr("a.conv_id = b.conv_id and a.turn + 1 = b.turn")).select(F.col("a.row").alias("left_id"), F.col("b.row").alias("right_id")).unionByName(spark.createDataFrame([(3001, 3001), (3001, -1), (3001, None)], "left_id bigint, right_id bigint"))
    kinds = {"words": (textmatch.WordRuns(2), 1), "chars": (textmatch.CharRuns(3, 4, 5), 2), "rare": (textmatch.WordRuns(1), 3)}
    found = [textmatch.cosines(pairs, turns, "left_id", "right_id", "row", "normalised", kinds, near) for near in (None, F.floor(F.col("right_id") / 2500))]
    words = F.regexp_extract_all("normalised", F.lit(T.TOKEN), F.lit(0))
    for name, grams, least in (("words", textmatch.word_runs(words, 2), 1), ("chars", textmatch.char_runs("normalised", 3, 4, 5), 2), ("rare", textmatch.word_runs(words, 1), 3)):
        want = textmatch.cosine(pairs, textmatch.tfidf(turns, "row", grams, least), "left_id", "right_id", "row").select("left_id", "right_id", F.round("cosine", 9))
        want = Counter(map(tuple, want.collect()))
        assert all(want == Counter(map(tuple, got.select("left_id", "right_id", F.round(name, 9)).collect())) for got in found)
    plan = QUERIES["title_similarity_blend"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and "hashpartitioning(gram" not in plan and "hashpartitioning(row" not in plan


def test_char_runs_of_several_sizes(spark):
    df = spark.createDataFrame([("Ab  cde",), ("",), (None,)], "text string")
    one = df.select(textmatch.char_runs(T.normalise("text"), 3, 4).alias("x"), F.concat(textmatch.char_grams("text", 3), textmatch.char_grams("text", 4)).alias("y")).collect()
    assert all(r.x == r.y for r in one)
    assert one[0].x == [" ab", "ab ", " cd", "cde", "de ", " ab ", " cde", "cde "] and one[1].x == []


def test_classifier_counts_grams_once(spark, monkeypatch):
    """Grams were made anew from whole texts in every pass of every fold's fit."""
    df = learn.with_grams(spark.createDataFrame([(i, f"{'der die das' if i % 2 else 'the of and'} {i % 3}", "de" if i % 2 else "en", str(i // 2 % 8)) for i in range(40)], "doc_id int, text string, lang string, source string"), "text", 1)
    fitted = []
    fit = learn.fit_classifier
    monkeypatch.setattr(learn, "fit_classifier", lambda train, *more: fitted.append(train) or fit(train, *more))
    out = learn.cross_validated(df, "lang", F.col("source"), 2)
    assert fitted and all("regexp" not in x._jdf.queryExecution().optimizedPlan().toString() for x in fitted)
    got = out.collect()
    assert len(got) == 40 and all(r.predicted == r.lang for r in got)
