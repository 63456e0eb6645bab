"""Readers, writers and the checks that a table must pass on the way in."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Bytes of a file that a task may hold at once, and how many larger ones are streamed at a time.
WHOLE, STREAMS = 1 << 27, 8


def read_table(spark: SparkSession, folder: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A Parquet table, with the columns asked for; the scan reads no others."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None, one_per_file: bool = False) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=one_per_file)


def write_table(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def footer_counts(spark: SparkSession, folder: str, names: Iterable[str]) -> DataFrame:
    """table_name, n_rows of Parquet tables: no column is read, so the counts come from the files' footers."""
    counts = [read_table(spark, folder, n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in names]
    return reduce(DataFrame.unionByName, counts)


def read_zipped_csv(spark: SparkSession, path: str, schema: StructType | str, member: str = r"\.csv$") -> DataFrame:
    """Rows of the CSV members, by name, of every ZIP file under path; each member needs a header.

    ZIP files can't be split: one is read by one task, member by member and
    line by line, so it should hold a bounded part of the data.
    """
    import re

    wanted = re.compile(member)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path).select("content")
    wide = spark.createDataFrame([], schema).schema
    names = [f.name for f in wide.fields]

    def unpack(batches):
        import csv
        import io
        import zipfile
        from itertools import islice

        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                archive = zipfile.ZipFile(io.BytesIO(content))
                for name in sorted(n for n in archive.namelist() if wanted.search(n)):
                    rows = csv.DictReader(io.TextIOWrapper(archive.open(name), "utf-8", newline=""))
                    while chunk := list(islice(rows, 10_000)):
                        yield pd.DataFrame({n: pd.array([r.get(n) or None for r in chunk], dtype="string") for n in names})

    texts = files.mapInPandas(unpack, ", ".join(f"`{n}` string" for n in names))
    return texts.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wide.fields))


def beside(*rows: DataFrame) -> DataFrame:
    """One row with the columns of several frames of one row each."""
    out = rows[0].withColumn("_one", F.lit(1))
    for r in rows[1:]:
        out = out.join(F.broadcast(r.limit(1).withColumn("_one", F.lit(1))), "_one")
    return out.drop("_one")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of every file under path; Spark lists neither empty nor hidden ones.

    A digest takes a file's bytes in order, so no file is shared out. Files up to
    ``WHOLE`` bytes are dealt over tasks, which hold them. Spark holds files as one
    value, of 2 GB at most, so larger ones are streamed by the driver's JVM, a
    small buffer at a time, whatever their length; the tasks never read them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    held = files.filter(F.col("length") <= WHOLE).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = [tuple(r) for r in files.filter(F.col("length") > WHOLE).select("path", "length").collect()]
    if not large:
        return held
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def digest(name: str) -> str:
        at = jvm.org.apache.hadoop.fs.Path(name)
        stream = at.getFileSystem(conf).open(at)
        try:
            return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    with ThreadPoolExecutor(STREAMS) as pool:
        found = list(pool.map(digest, (name for name, _ in large)))
    return held.unionByName(spark.createDataFrame([(*f, x) for f, x in zip(large, found, strict=True)], held.schema))


def assert_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, unless a key occurs twice."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{keys} is not unique: {twice[0].asDict()}")
    return df


def join_validated(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """A join whose cardinality is checked first: m:1, 1:m or 1:1."""
    many_left, many_right = validate.split(":")
    if many_right == "1":
        assert_unique(right, on)
    if many_left == "1":
        assert_unique(left, on)
    return left.join(right, on, how)


def dictionary(df: DataFrame, name: str) -> DataFrame:
    """One row per column: table, place, column, type, nullable. Only the schema is read."""
    rows = [(name, i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "table_name string, place int, column_name string, data_type string, nullable boolean")


def list_lengths(df: DataFrame, column: str) -> DataFrame:
    """Total, positive and greatest length of an array column."""
    n = F.coalesce(F.size(column), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    return df.agg(F.sum(n).alias("total"), F.count_if(n > 0).alias("positive"), F.max(n).cast("long").alias("longest"))
