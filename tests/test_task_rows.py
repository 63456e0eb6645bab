"""Work items: the tasks that join orders with their items grow in number with the rows."""

from threadline.sources import bindings as B

DATA = "/root/testdata/sf0.001"


def test_more_rows_are_joined_by_more_tasks(spark, monkeypatch):
    want = sorted(map(tuple, B.pull_requests(spark, DATA).collect()), key=lambda r: r[0])
    monkeypatch.setattr(B, "TASK_ROWS", 100)
    many = B.pull_requests(spark, DATA)
    assert sorted(map(tuple, many.collect()), key=lambda r: r[0]) == want
    rows = sum(spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("orders", "lineitem"))
    assert many.rdd.getNumPartitions() >= rows // 100
