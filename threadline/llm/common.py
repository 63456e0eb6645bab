"""What the text operators share: the shared work folder, lineage cuts and word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: str.split() also splits at other Unicode spaces, so texts are split at these six by hand.
SPACES = str.maketrans("\t\n\x0b\x0c\r", " " * 5)
#: A-Z only, as the contracts ask; str.lower() would also change other letters.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Texts that a task has as Python objects at once, and their bytes (or one longer text).
SLICE, SLICE_BYTES = 500, 1 << 23

#: Words kept with their hashes in one worker.
MEMO = 400_000

_own: list[str] = []


class Hashes(dict):
    """Word -> 64-bit hash; emptied when full."""

    def __missing__(self, word: str | bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only where that is unset, and Spark runs locally as in tests, under a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="threadline-"))
        base = f"file://{_own[0]}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def one_write(spark: SparkSession) -> Iterator[None]:
    """For a write whose result is read from its files alone: its shuffle files go when it ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame, path: str | None = None, codec: str = "snappy") -> DataFrame:
    """Write a DataFrame once to the shared folder, or to a path there, and read it back: later stages no longer depend on executors' shuffle files."""
    path = path or work_dir(df.sparkSession)
    with one_write(df.sparkSession):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def emptied(spark: SparkSession, path: str) -> None:
    """Give back the disk of a table that was cut to a path, once nothing reads it again."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, column: int, rows: int = SLICE, n_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts with so many rows and bytes of text at most; a longer text is a part by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        fits = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + n_bytes, side="right"))
        end = min(max(fits, start + 1), start + rows)
        yield batch.slice(start, end - start)
        start = end


def words_of(text: str) -> list[str]:
    return [w for w in text.translate(SPACES).split(" ") if w]


def word_array(text: Column | str) -> Column:
    """The words of a text as array<string>; null has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(c, F.lit("")), GAP), lambda w: w != "")


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def filter_texts(docs: DataFrame, start: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """The rows whose text passes; all columns stay as they are.

    start() runs once a task and gives the test, which gets short lists of whole
    texts, so a task never holds a batch's texts as Python objects together.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = start()
        for batch in batches:
            keep = [k for part in slices(batch, at) for k in passes(part.column(at).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
