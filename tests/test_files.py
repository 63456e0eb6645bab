"""Findings of a review of queries on files: each test failed before its finding was settled."""

from __future__ import annotations

import hashlib

from threadline.plans.files import QUERIES
from threadline.sources import tables


def test_digests_of_files_beyond_what_spark_holds(spark, tmp_path, monkeypatch):
    """A file over the length that Spark takes as one value (2 GB, here less) ended the query."""
    contents = {"a": b"x" * 1000, "b": b"x" * 1001, "c/b \u00e9%20.gz": b"x" * 1001, "c/d": bytes(range(256)) * 5000}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(tables, "WHOLE", 1000, raising=False)
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, 1000)
    try:
        got = [tuple(r)[1:] for r in tables.file_digests(spark, str(tmp_path)).collect()]
        groups = {tuple(r) for r in QUERIES["file_digests"][0](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset(limit)
    digests = [(len(c), hashlib.sha256(c).hexdigest()) for c in contents.values()]
    assert sorted(got) == sorted(digests)
    assert groups == {(d, digests.count((n, d)), n) for n, d in digests}
