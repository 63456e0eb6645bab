"""Substring dedup over a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words. Of the ``GRAM``-word grams inside a
window the one of least hash is its anchor; equal windows have equal anchors, and
neighbouring windows mostly share one, so an index entry is an anchor with the
run of windows that chose it: (anchor, document, first place, a hash for each
window). Verification: an anchor's 64 bits and a window's own 48, from another
hash of all its words, must both agree. Of n different windows with one anchor
about n^2 / 2^49 pairs would agree by chance: one in 14,000 for 200,000.

The index is a folder of runs. A run is written once, as a Parquet table
bucketed by ``part`` (a function of the anchor) and sorted by anchor, and never
changed. A new batch is shuffled once and becomes a run; it is merge-joined part
by part with itself and with each older run, and Spark needs no shuffle for
that, since all runs share their buckets. Before a batch is added, runs of one
level of which there are ``FANOUT`` are compacted into one of the next, part by
part, also without a shuffle. A manifest names the runs, so that ``Index.open``
can go on with a stored index.

Within a slice of a task, windows already seen in a smaller doc_id are marked at
once: they go straight to the rows of what is removed, one row for each document
and slice, and no entry of the index has them alone. What the parts find is a row
for each entry. So neither grows with the number of parts. Anchors with over
``HOT`` entries in a run are left out of the parts; their windows are compared one
by one, by a grouped minimum and a join.

Defined results: null text has no words; a null doc_id neither removes nor loses
words; equal doc_ids do not remove from each other, and their rows are told apart
by text; texts under 13 words lose nothing; an empty table gives no rows. In an
incremental run, history's smaller doc_ids count, and what history has released
stays as it is. Whole texts count, however long: a slice ends after the text that
fills it. Only ``doc_id`` (an integer) and ``text`` are read, so other columns may
have any names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.llm.common import Hashes, cut, one_write, slices, work_dir

WINDOW, GRAM = 13, 5
WIN_BYTES = 6
#: Runs of one level that are merged into one of the next.
FANOUT = 2
#: Bytes of text for each part of the index, and the most parts and files of a run.
PART_BYTES = 1 << 23
MAX_PARTS, MAX_FILES = 1 << 20, 1 << 15
#: Entries of an anchor from which it is hot; doubled while over MAX_HOT anchors would be (they are broadcast).
HOT, MAX_HOT = 200_000, 100_000
_SLICE_WORDS = 500_000
ENTRY = "part int, anchor long, doc_id long, twin long, place int, mask int, windows binary, spots array<long>"
#: A spot is place * 2^16 plus a bit for each of the windows that begin there.
SPOTS = "doc_id long, twin long, spots array<long>"


def mix(x: np.ndarray, odd: int) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(odd)
    return x ^ x >> np.uint64(29)


def roll(x: np.ndarray, n: int, odd: int) -> np.ndarray:
    """A hash of n values from each place on."""
    m = len(x) - n + 1
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = h * np.uint64(odd) + x[i : i + m]
    return mix(h, 0xD6E8FEB86659FD93)


def window_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of a word-hash sequence: the anchor's hash, the anchor's place, the window's own hash of 48 bits."""
    grams = roll(words, GRAM, 0x9E3779B97F4A7C15)
    at = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1).argmin(axis=1)
    at += np.arange(len(at))
    return grams[at], at, roll(mix(words, 0xBF58476D1CE4E5B9), WINDOW, 0xC2B2AE3D27D4EB4F) >> np.uint64(64 - 8 * WIN_BYTES)


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by key, and where in it each run of equal keys begins."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))


def _joint(anchor: np.ndarray, window: np.ndarray) -> np.ndarray:
    return mix(anchor, 0xFF51AFD7ED558CCD) ^ mix(window, 0xC4CEB9FE1A85EC53)


def _binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary values of counts[i] rows of values each."""
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    offsets = np.concatenate([[0], np.cumsum(counts * width)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _spot_rows(doc: np.ndarray, twin: np.ndarray, place: np.ndarray, bits: np.ndarray, begins: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """doc_id, twin, spots: a row from each of ``begins`` on."""
    offsets = pa.array(np.append(begins, len(doc)).astype(np.int32))
    return pa.array(doc[begins]), pa.array(twin[begins]), pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int64) << 16 | bits.astype(np.int64)))


def _entries(ids: list[int], twins: list[int], texts: list[list[bytes]], n_parts: int, hashes: dict[bytes, int]) -> list[pa.RecordBatch]:
    """Index entries of one slice of documents, which come by ascending id, and rows of the windows marked within it."""
    n = np.array([len(w) for w in texts])
    words = np.fromiter(map(hashes.__getitem__, chain.from_iterable(texts)), np.uint64, int(n.sum()))
    if len(words) < WINDOW:
        return []
    anchor, at, window = window_hashes(words)
    doc = np.repeat(np.arange(len(n)), n)
    inside = np.flatnonzero(doc[: len(anchor)] == doc[WINDOW - 1 :])
    if not len(inside):
        return []
    anchor, at, window, of = anchor[inside], at[inside], window[inside], doc[inside]
    id_of = np.array(ids, np.int64)[of]
    order, begins = _grouped(_joint(anchor, window))
    first = np.repeat(order[begins], np.diff(np.append(begins, len(order))))
    seen = np.zeros(len(order), bool)
    seen[order] = (id_of[order] > id_of[first]) & (anchor[order] == anchor[first]) & (window[order] == window[first])
    # Neighbouring windows with one anchor are an entry.
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(new)))
    nth = np.arange(len(new)) - np.repeat(starts, counts)
    mask = np.bitwise_or.reduceat(seen.astype(np.int32) << nth.astype(np.int32), starts)
    left = mask != (1 << counts) - 1
    twin = np.array(twins, np.int64)[of[starts]]
    place = (inside[starts] - (np.cumsum(n) - n)[of[starts]]).astype(np.int32)
    wins = window[np.repeat(left, counts)].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIN_BYTES]
    kept = starts[left]
    out = [pa.RecordBatch.from_arrays([
        pa.array((anchor[kept] % np.uint64(n_parts)).astype(np.int32)), pa.array(anchor[kept].view(np.int64)), pa.array(id_of[kept]), pa.array(twin[left]),
        pa.array(place[left]), pa.array(mask[left].astype(np.int32)), _binaries(wins, counts[left]), pa.nulls(len(kept), pa.list_(pa.int64())),
    ], COLUMNS)]
    marked = np.flatnonzero(mask)
    if len(marked):
        who = of[starts[marked]]
        rows = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        doc_id, twin, spots = _spot_rows(id_of[starts[marked]], twin[marked], place[marked], mask[marked], rows)
        # They may lie in any part.
        parts = pa.array((mix(id_of[starts[marked]][rows].view(np.uint64), 0x9E3779B97F4A7C15) % np.uint64(n_parts)).astype(np.int32))
        none = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.binary())]
        out.append(pa.RecordBatch.from_arrays([parts, none[0], doc_id, twin, *none[1:], spots], COLUMNS))
    return out


COLUMNS = ["part", "anchor", "doc_id", "twin", "place", "mask", "windows", "spots"]


def entries(docs: DataFrame, n_parts: int) -> DataFrame:
    """Index entries of docs (doc_id, twin, text); rows without an anchor have the spots that are marked already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        held: list[tuple[int, int, list[bytes]]] = []
        size = 0

        def done() -> list[pa.RecordBatch]:
            held.sort(key=lambda r: r[0])
            return _entries(*map(list, zip(*held, strict=True)), n_parts, hashes) if held else []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = row[2].encode().split()
                held.append((row[0], row[1], words))
                size += len(words)
                if size >= _SLICE_WORDS:
                    yield from done()
                    held, size = [], 0
        yield from done()

    return docs.select(F.col("doc_id").cast("long"), "twin", "text").mapInArrow(run, ENTRY)


def with_twins(docs: DataFrame) -> DataFrame:
    """docs with twin: 0, or where a doc_id has several texts a hash of the text."""
    again = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("_low"), F.max(F.xxhash64("text")).alias("_high"))
    again = cut(again.filter("_low <> _high and doc_id is not null").select("doc_id", F.lit(True).alias("_again")))
    if again.isEmpty():
        return docs.withColumn("twin", F.lit(0).cast("long"))
    return docs.join(again, "doc_id", "left").withColumn("twin", F.when(F.col("_again"), F.xxhash64("text")).otherwise(0)).drop("_again")


class _Expanded:
    """Windows of a table of entries, without those marked already."""

    def __init__(self, table: pa.Table):
        self.rows = table.num_rows
        column = {c: table.column(c).combine_chunks() for c in table.column_names}
        self.doc, self.twin, self.place, self.mask = (column[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "twin", "place", "mask"))
        texts = column["windows"]
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        counts = np.diff(offsets) // WIN_BYTES
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) and texts.buffers()[2] else np.empty(0, np.uint8)
        wide = np.zeros((len(raw) // WIN_BYTES, 8), np.uint8)
        wide[:, :WIN_BYTES] = raw.reshape(-1, WIN_BYTES)
        row = np.repeat(np.arange(self.rows, dtype=np.int32), counts)
        nth = (np.arange(len(row), dtype=np.int32) - np.repeat((np.cumsum(counts) - counts).astype(np.int32), counts)).astype(np.int8)
        left = (self.mask[row] >> nth & 1) == 0
        self.row, self.nth = row[left], nth[left]
        self.window = wide.view("<u8")[:, 0][left]
        self.anchor = column["anchor"].to_numpy(zero_copy_only=False).view(np.uint64)[self.row]
        self.key = _joint(self.anchor, self.window)

    def least(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """order of the windows by key, where equal keys begin, their least doc_id."""
        order, begins = _grouped(self.key)
        if not len(order):
            return order, begins[:0], order
        return order, begins, np.minimum.reduceat(self.doc[self.row[order]], begins)


def _spots(e: _Expanded, hit: np.ndarray) -> pa.Table:
    """The windows of e at ``hit``, a row for each entry that has any."""
    # A row and number occur once in hit, so adding powers of two sets bits.
    bits = np.bincount(e.row[hit], np.left_shift(1, e.nth[hit].astype(np.int64)), e.rows).astype(np.int64)
    row = np.flatnonzero(bits)
    return pa.table(list(_spot_rows(e.doc[row], e.twin[row], e.place[row], bits[row], np.arange(len(row)))), ["doc_id", "twin", "spots"])


def places(spots: np.ndarray) -> np.ndarray:
    """The first words of windows, unpacked."""
    i, k = np.nonzero(spots[:, None] >> np.arange(WINDOW - GRAM + 1)[None, :] & 1)
    return (spots[i] >> 16) + k


def _within(table: pa.Table) -> pa.Table:
    e = _Expanded(table)
    order, begins, least = e.least()
    counts = np.diff(np.append(begins, len(order)))
    first = np.repeat(order[begins], counts)
    hit = (e.doc[e.row[order]] > np.repeat(least, counts)) & (e.anchor[order] == e.anchor[first]) & (e.window[order] == e.window[first])
    return _spots(e, order[hit])


def _first_windows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct window of a table, ascending by key: key, anchor, window, least doc_id."""
    h = _Expanded(table)
    order, begins, least = h.least()
    first = order[begins]
    return h.key[first], h.anchor[first], h.window[first], least


def _against(new: pa.Table, old: pa.Table) -> pa.Table:
    key, anchor, window, least = _first_windows(old)
    e = _Expanded(new)
    if not len(key) or not len(e.key):
        return _spots(e, np.empty(0, np.int64))
    at = np.minimum(np.searchsorted(key, e.key), len(key) - 1)
    hit = (e.key == key[at]) & (e.anchor == anchor[at]) & (e.window == window[at]) & (e.doc[e.row] > least[at])
    return _spots(e, np.flatnonzero(hit))


def _merged(a: pa.Table, b: pa.Table) -> pa.Table:
    return pa.concat_tables([a, b.cast(a.schema)]).sort_by("anchor")


@dataclass
class Run:
    """A table of entries, how often its rows were merged, and its hot anchors (None where it has none)."""

    table: str
    level: int
    hot: DataFrame | None


def _one_by_one(rows: DataFrame) -> DataFrame:
    """anchor, window, doc_id, twin, spot of each unmarked window of some entries."""
    nth = F.sequence(F.lit(0), (F.length("windows") / WIN_BYTES).cast("int") - 1)
    windows = F.transform(nth, lambda k: F.struct(k.alias("k"), F.substring("windows", k * WIN_BYTES + 1, WIN_BYTES).alias("window")))
    left = F.filter(windows, lambda w: F.col("mask").bitwiseAND(F.pow(F.lit(2), w["k"]).cast("int")) == 0)
    spot = F.col("place").cast("long") * 65536 + F.pow(F.lit(2), F.col("w.k")).cast("long")
    return rows.select("anchor", "doc_id", "twin", "place", F.explode(left).alias("w")).select("anchor", "w.window", "doc_id", "twin", spot.alias("spot"))


@contextmanager
def sorted_runs(spark: SparkSession) -> Iterator[None]:
    """Lets Spark use that a run, written with one file for each bucket, is sorted; where it has more it sorts as always."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Index:
    """Runs in a folder of their own; the number of parts is fixed for all of them."""

    def __init__(self, spark: SparkSession, path: str, n_parts: int, hot: int = HOT):
        self.spark, self.path, self.n_parts, self.hot = spark, path, min(n_parts, MAX_PARTS), hot
        self.n_files = min(self.n_parts, MAX_FILES)
        self.database = f"index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{path}/runs'")
        self.runs: list[Run] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, hot: int = HOT) -> Index:
        """The index stored at path, as of its last batch. Its runs' files are never deleted by this session."""
        rows = spark.read.parquet(f"{path}/manifest")
        rows = rows.filter(F.col("version") == rows.agg(F.max("version")).first()[0]).orderBy("place").collect()
        index = cls(spark, path, rows[0]["n_parts"], hot)
        index.version = rows[0]["version"]
        for r in rows:
            name = f"{index.database}.run_{uuid.uuid4().hex}"
            fields = ENTRY.replace(":", " ")
            spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (part) SORTED BY (part, anchor) INTO {index.n_files} BUCKETS LOCATION '{r['location']}'")
            index.runs.append(Run(name, r["level"], index._hot(name)))
        return index

    def drop(self) -> None:
        """Forget the index and delete the runs that it wrote."""
        self.spark.sql(f"DROP DATABASE {self.database} CASCADE")
        self.runs = []

    def _write(self, rows: DataFrame, level: int) -> Run:
        name = f"{self.database}.run_{uuid.uuid4().hex}"
        with one_write(self.spark):
            rows.write.bucketBy(self.n_files, "part").sortBy("part", "anchor").option("parquet.writer.version", "v2").option("compression", "zstd").saveAsTable(name, format="parquet")
        return Run(name, level, self._hot(name))

    def _hot(self, table: str) -> DataFrame | None:
        """Anchors with very many entries in a run; parts hold whole anchors, so counting them needs no shuffle."""
        counts = self.spark.table(table).filter("anchor is not null").groupBy("part", "anchor").count()
        found, least = cut(counts.filter(F.col("count") > self.hot).select("anchor", "count")), self.hot
        while (n := found.filter(F.col("count") > least).count()) > MAX_HOT:
            least *= 2
        return found.filter(F.col("count") > least).select("anchor") if n else None

    def _save(self) -> None:
        """Write the manifest's next version."""
        self.version += 1
        where = [self.spark.sql(f"DESCRIBE FORMATTED {r.table}").filter("col_name = 'Location'").first()["data_type"] for r in self.runs]
        rows = [(self.version, i, r.level, self.n_parts, w) for i, (r, w) in enumerate(zip(self.runs, where, strict=True))]
        self.spark.createDataFrame(rows, "version int, place int, level int, n_parts int, location string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _cold(self, run: Run, hot: DataFrame | None) -> DataFrame:
        rows = self.spark.table(run.table).filter("anchor is not null").drop("spots")
        return (rows.join(F.broadcast(hot), "anchor", "left_anti") if hot is not None else rows).groupBy("part")

    def append(self, docs: DataFrame) -> DataFrame:
        """Index docs (doc_id, twin, text) as a run; returns doc_id, twin, spots of what repeats smaller ids of the batch or of history."""
        self.compact()
        run = self._write(entries(docs, self.n_parts).repartition(self.n_files, "part"), 0)
        every = [*self.runs, run]
        hot = None
        for r in every:
            if r.hot is not None:
                hot = r.hot if hot is None else hot.union(r.hot).distinct()
        found = self.spark.table(run.table).filter("anchor is null").select("doc_id", "twin", "spots")
        found = found.unionByName(self._cold(run, hot).applyInArrow(_within, SPOTS))
        for old in self.runs:
            found = found.unionByName(self._cold(run, hot).cogroup(self._cold(old, hot)).applyInArrow(_against, SPOTS))
        if hot is not None:
            of = [self.spark.table(r.table).join(F.broadcast(hot), "anchor", "left_semi") for r in every]
            before = [_one_by_one(x).groupBy("anchor", "window").agg(F.min("doc_id").alias("first_id")) for x in of]
            least = before[0]
            for x in before[1:]:
                least = least.unionByName(x)
            least = least.groupBy("anchor", "window").agg(F.min("first_id").alias("first_id"))
            hits = _one_by_one(of[-1]).join(least, ["anchor", "window"]).filter("doc_id > first_id")
            found = found.unionByName(hits.select("doc_id", "twin", F.array("spot").alias("spots")))
        with sorted_runs(self.spark):
            found = cut(found)
        self.runs.append(run)
        self._save()
        return found

    def compact(self) -> None:
        """Merge runs of one level while there are ``FANOUT`` of them. Nothing reads the merged runs any more: ``append`` writes what it finds."""
        while len(same := [r for r in self.runs if r.level == min((x.level for x in self.runs), default=0)]) >= FANOUT:
            a, b = same[:2]
            rows = self._cold(a, None).cogroup(self._cold(b, None)).applyInArrow(_merged, ENTRY.rsplit(",", 1)[0])
            with sorted_runs(self.spark):
                merged = self._write(rows.withColumn("spots", F.lit(None).cast("array<long>")), a.level + 1)
            for r in (a, b):
                self.spark.sql(f"DROP TABLE {r.table}")
            self.runs = [merged, *(r for r in self.runs if r not in (a, b))]


def remove(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of docs (doc_id, twin, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    per_doc = spots.groupBy(F.col("doc_id").alias("_id"), F.col("twin").alias("_twin")).agg(F.flatten(F.collect_list("spots")).alias("spots"))
    same = (F.col("doc_id") == F.col("_id")) & (F.col("twin") == F.col("_twin"))
    joined = docs.join(per_doc.hint("shuffle_hash"), same, "left").select("doc_id", "text", "spots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in slices(b, 1)):
            n, lost, kept = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = (text or "").encode().split()
                n.append(len(words))
                if not found.is_valid:
                    lost.append(0)
                    kept.append(b" ".join(words).decode())
                    continue
                at = places(found.values.to_numpy())
                edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + WINDOW, minlength=len(words) + 1)
                stay = np.cumsum(edge[:-1]) <= 0
                lost.append(len(words) - int(stay.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stay).tolist()]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, kept string")


def parts_for(n_bytes: int) -> int:
    """Parts for so many bytes of text, a power of two."""
    n = 16
    while n < MAX_PARTS and n * PART_BYTES < n_bytes:
        n *= 2
    return n


def dedup(docs: DataFrame, batches: int = 3, path: str | None = None, hot: int = HOT) -> DataFrame:
    """Index docs in batches of ascending ids, and remove what repeats smaller ids. Without a path the index goes once all is found."""
    spark = docs.sparkSession
    docs = with_twins(docs.select("doc_id", "text"))
    known = docs.filter("doc_id is not null and text is not null")
    cuts, n = known.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [0.5]), F.sum(F.octet_length("text"))).first()
    index = Index(spark, path or work_dir(spark), parts_for(n or 0), hot)
    limits = [None, *(sorted(set(cuts)) if cuts and batches > 1 else []), None]
    found = None
    for low, high in zip(limits, limits[1:], strict=False):
        batch = known
        if low is not None:
            batch = batch.filter(F.col("doc_id") > low)
        if high is not None:
            batch = batch.filter(F.col("doc_id") <= high)
        spots = index.append(batch)
        found = spots if found is None else found.unionByName(spots)
    if path is None:
        index.drop()
    return remove(docs, found)


def op5(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13
), windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS s FROM starts
), least AS (
  SELECT s, min(doc_id) AS first_id FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM windows JOIN least USING (s) WHERE doc_id > first_id
), per_doc AS (
  SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(len(ks), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN ks IS NULL THEN words ELSE list_filter(words, lambda x, j: NOT list_contains(ks, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN per_doc USING (doc_id)
"""
