"""The pipeline's stages over a small corpus."""

import hashlib

import corpus_pipeline
import pytest

from tests.llm.fixtures import frame
from tests.llm.test_texts import library, sentences  # noqa: F401  a fixture


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    item = "one special question about rivers and stones with an answer that nobody else wrote down"
    rows = sentences(5) + [(900, None), (901, "."), (902, "the house of stone and water " + item + " and light"), (903, sentences(5)[0][1]), (None, "the river and the stone")]
    frame(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder, library):  # noqa: F811
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            docs = spark.read.parquet(path)
            assert docs.columns == columns
            left.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert {900, 901}.isdisjoint(left[0]) and 902 in left[2] and 902 not in left[3] and 903 not in left[2] and None in left[3]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in spark.read.parquet(f"{folder}/bpe").collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 200 and "decoded_sha256" in out.columns


def test_run_over_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    frame(spark, []).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = corpus_pipeline.run(spark, d)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0
    e = str(tmp_path / "no_benchmark")
    frame(spark, sentences(6)[:60] + [(800, None), (801, ""), (None, "the house of the river"), (None, "the house of the river")]).write.parquet(f"{e}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{e}/benchmark.parquet")
    left = [r.doc_id for r in corpus_pipeline.run(spark, e).collect()]
    assert left.count(None) == 2 and {800, 801}.isdisjoint(left) and len(left) > 50


def test_queries_have_one_for_each_operator():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
