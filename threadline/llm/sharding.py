"""Sharding by fixed virtual slots, with DataFrame functions only.

A record hashes to one of thousands of slots for ever. Bytes are summed per
slot (map-side first, so the shuffle holds a row per slot and task), and a
versioned table says which shard has which slot. A new map is packed largest
slot first into the emptiest shard; a later version is the former one edited:
only the slots that must move change their shard. Every table about slots has
``n_slots`` rows, whatever the input, which is the proven bound for broadcasting
the map and for packing it in one row.

Law: ``bytes`` - sizes of shards are near equal.

Defined results: null text has 16 bytes and crc32 0; a null doc_id is a value
like any other. The hash covers doc_id and text, so that neither null ids nor
one repeated id gather in a slot, and for rows equal in both the number of the
copy, so that copies spread over the slots. Whole texts count, however long; ties of places are in no order that matters. An empty table gives
no rows. Only ``doc_id`` and ``text`` are read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from threadline.llm.common import cut, work_dir

N_SHARDS = 40
N_SLOTS = 8192
RECORD_BYTES = 16


def numbered_copies(rows: DataFrame) -> DataFrame:
    """rows (with key and part, the task that read them) and copy: 0 to n - 1 within each key, in no task's sole care.

    A part numbers its own rows of a key and adds what the parts before it have; of a key only one row per part is
    sorted together. Rows must come from files, so that a part is what it was when its rows were counted.
    """
    mine = Window.partitionBy("key", "part")
    counts = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    begins = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("key", "part", begins.alias("begins")).filter("begins > 0")
    local = rows.withColumn("copy", F.row_number().over(mine.orderBy("size")) - 1)
    return local.join(starts, ["key", "part"], "left").withColumn("copy", F.col("copy") + F.coalesce("begins", F.lit(0))).drop("begins")


def slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of each record, read back from a written table.

    A record's slot follows from its id and text. Copies equal in both go by their number too, so that a record that
    makes up a third of the table is spread over all slots; which of them gets which number makes no difference.
    """
    text = F.coalesce("text", F.lit(""))
    read = docs.select(
        "doc_id",
        (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64("doc_id", "text").alias("key"),
        F.spark_partition_id().alias("part"),
    )
    copies = numbered_copies(cut(read))
    hashed = F.when(F.col("copy") == 0, F.col("key")).otherwise(F.xxhash64("key", "copy"))
    return cut(copies.select("doc_id", "size", "text_crc32", F.pmod(hashed, F.lit(n_slots)).alias("virtual_slot")))


def slot_sizes(records: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """virtual_slot, bytes, records: one row per slot, empty slots included."""
    sums = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))
    every = records.sparkSession.range(0, n_slots, 1, 1).withColumnRenamed("id", "virtual_slot")
    return every.join(sums, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("records", F.lit(0)).alias("records"))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _pack(items: Column, loads: Column) -> Column:
    """Largest first into the emptiest shard. items: array<struct<bytes, virtual_slot>>, largest first; loads: bytes that each shard has."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("to"))

    def put(state: Column, item: Column) -> Column:
        return _let(
            F.array_position(state["loads"], F.array_min(state["loads"])).cast("int"),
            lambda k: F.struct(
                F.transform(state["loads"], lambda v, i: F.when(i == k - 1, v + item["bytes"]).otherwise(v)).alias("loads"),
                F.concat(state["to"], F.array(k - 1)).alias("to"),
            ),
        )

    return F.transform(F.arrays_zip(items.alias("item"), F.aggregate(items, start, put)["to"].alias("shard")), lambda x: x)


def _largest_first() -> Column:
    return F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot")), asc=False).alias("items")


def _packed(todo: DataFrame, loads: Column) -> DataFrame:
    """virtual_slot, shard of each slot of todo (virtual_slot, bytes), which has n_slots rows at most."""
    row = todo.agg(_largest_first())
    zipped = row.select(F.explode(_pack(F.col("items"), loads)).alias("x"))
    return zipped.select(F.col("x.item.virtual_slot").alias("virtual_slot"), F.col("x.shard").alias("shard"))


def new_map(sizes: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """The first map: virtual_slot, shard."""
    full = _packed(sizes.filter("bytes > 0").select("virtual_slot", "bytes"), F.array_repeat(F.lit(0).cast("long"), n_shards))
    empty = sizes.filter("bytes = 0").select("virtual_slot", (F.col("virtual_slot") % n_shards).cast("int").alias("shard"))
    return full.unionByName(empty)


def rebalance(old: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """The edited map for new sizes or more shards: each overfull shard hands on its smallest slots down to the mean; all else stays."""
    load = Window.partitionBy("shard")
    order = load.orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    marked = (
        sizes.join(F.broadcast(old), "virtual_slot")
        .withColumn("over", F.sum("bytes").over(load) - F.sum("bytes").over(Window.partitionBy(F.lit(0))) / n_shards)
        .withColumn("moves", (F.col("bytes") > 0) & (F.sum("bytes").over(order) <= F.col("over")))
    )
    stay = marked.filter(~F.col("moves"))
    left = stay.groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    shards = old.sparkSession.range(0, n_shards, 1, 1).select(F.col("id").cast("int").alias("shard"))
    loads = shards.join(left, "shard", "left").groupBy(F.lit(0).alias("one")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("shard", F.coalesce("bytes", F.lit(0)).alias("bytes")))), lambda x: x["bytes"]).alias("loads")
    )
    items = marked.filter("moves").groupBy(F.lit(0).alias("one")).agg(_largest_first())
    moved = items.join(loads, "one").select(F.explode(_pack(F.col("items"), F.col("loads"))).alias("x"))
    moved = moved.select(F.col("x.item.virtual_slot").alias("virtual_slot"), F.col("x.shard").alias("shard"))
    return stay.select("virtual_slot", "shard").unionByName(moved)


def store_map(slot_map: DataFrame, path: str, version: int) -> DataFrame:
    """Add a version to the stored map, and read that version back. All versions together: spark.read.parquet(path)."""
    target = f"{path}/version={version}"
    slot_map.coalesce(1).write.parquet(target)
    return slot_map.sparkSession.read.schema(slot_map.schema).parquet(target)


def place(records: DataFrame, sizes: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds shard and slot: the place of a record in its shard, 0 to n - 1.

    The places of a slot's records begin where the shard's former slots end, so
    only records of one slot are numbered together: no task holds a shard.
    """
    begin = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("records").over(begin), F.lit(0)).alias("begins")
    )
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return records.join(F.broadcast(starts), "virtual_slot").withColumn("slot", F.row_number().over(within) - 1 + F.col("begins")).drop("begins")


def latest_map(spark: SparkSession, path: str) -> tuple[DataFrame, int] | None:
    """The last version of the map stored at path, and its number."""
    try:
        every = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    version = every.agg(F.max("version")).first()[0]
    return every.filter(F.col("version") == version).select("virtual_slot", "shard"), version


def assign(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, path: str | None = None) -> DataFrame:
    """Every record with its slot, shard and place. A map stored under path is edited and stored as its next version; else the first is made."""
    spark = docs.sparkSession
    records = slots(docs, n_slots)
    path = path or work_dir(spark)
    old = latest_map(spark, f"{path}/map")
    version = 1 if old is None else old[1] + 1
    sizes = slot_sizes(records, n_slots)
    sizes.coalesce(1).write.parquet(f"{path}/sizes/version={version}")
    sizes = spark.read.schema(sizes.schema).parquet(f"{path}/sizes/version={version}")
    slot_map = new_map(sizes, n_shards) if old is None else rebalance(old[0], sizes, n_shards)
    return place(records, sizes, store_map(slot_map, f"{path}/map", version))


def op2(docs: DataFrame) -> DataFrame:
    return assign(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
