"""Written steps of a computation: later ones read files, and don't depend on executors' shuffle files or on a long plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def stage_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local one only where that is unset and Spark runs in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="threadline-stage-"))
        base = f"file://{_own[0]}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame, freed: bool = False) -> DataFrame:
    """df, written once to the shared folder and read back; if freed, its shuffle files go when it is written."""
    spark, path, name = df.sparkSession, stage_dir(df.sparkSession), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, str(freed or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)
