"""Sharding by fixed virtual slots: records hash into slots, slots have bytes, a versioned map gives each slot a shard.

The law is ``bytes``: shards get nearly equal sizes. Each record falls into one of ``SLOTS`` slots by a hash of its id and
text, for good. Bytes are summed by slot, and the map assigns slots to shards, the largest first, each to the shard that
is the lightest so far. The map is a small table (a row per slot, whatever the input's size) that is written with a
version; when sizes change, ``rebalance`` moves as few slots as bring every shard near the mean, and writes the next one.

A record's place in its shard needs no sort by shard: records are numbered inside their slot, and a slot begins where
the slots before it in the same shard end. The largest group that meets in one task is one slot.

Everything is DataFrame functions; the assignment is a fold over the sorted slots, a row per slot.

Defined cases: a null text has 0 bytes and the checksum of the empty text; a null id is hashed like any value; repeated rows
fall into one slot and get places of their own; an empty table gives no rows; fewer records than shards leave shards
empty; other columns are ignored by ``report``; a very long text is a large slot. Equal texts are a group that the law
doesn't keep together: a slot is a hash of id and text, so that copies scatter over all shards. One shard for them would
break the law as soon as a group of copies is larger than a shard.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import shared_dir

SHARDS = 40
SLOTS = 8192
#: Bytes that a record takes besides its text.
EXTRA = 16
MAP = "vslot int, shard int, bytes bigint, records bigint, base bigint, version int"


def slot_of(id_col: str, text_col: str, slots: int = SLOTS) -> Column:
    """The virtual slot of a record: a hash that no other record, shard count or map has a part in."""
    return F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(slots)).cast("int")


def size_of(text_col: str) -> Column:
    return (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + EXTRA).cast("bigint")


def slot_sizes(records: DataFrame) -> DataFrame:
    """vslot, bytes, records of rows (vslot, size)."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))


def _lightest(loads: Column) -> Column:
    return (F.array_position(loads, F.array_min(loads)) - 1).cast("int")


def assign(sizes: DataFrame, shards: int = SHARDS, version: int = 1) -> DataFrame:
    """A first map: slots in falling order of bytes, each to the lightest shard so far."""
    return _placed(_fold(sizes.withColumn("old", F.lit(-1)), shards), version)


def rebalance(old: DataFrame, sizes: DataFrame, shards: int, slack: float = 0.02) -> DataFrame:
    """The next version of the map ``old`` for new sizes or another number of shards.

    Slots in falling order of bytes keep their shard as long as it exists and stays within ``slack`` above the mean; the
    others go to the lightest shard.
    """
    version = (old.agg(F.max("version")).first()[0] or 0) + 1
    known = old.select("vslot", F.col("shard").alias("old"))
    joined = sizes.join(known, "vslot", "full").select("vslot", F.coalesce("bytes", F.lit(0).cast("bigint")).alias("bytes"), F.coalesce("records", F.lit(0).cast("bigint")).alias("records"), F.coalesce("old", F.lit(-1)).alias("old"))
    return _placed(_fold(joined, shards, slack), version)


def _fold(sizes: DataFrame, shards: int, slack: float = 0.0) -> DataFrame:
    """vslot, bytes, records, shard: the greedy assignment as a fold over all slots, a bounded array."""
    slots = sizes.agg(F.sort_array(F.collect_list(F.struct(F.col("bytes"), (-F.col("vslot")).alias("key"), "records", "old")), asc=False).alias("slots"), F.sum("bytes").alias("total"))
    most = (F.col("total") / shards * (1 + slack)).cast("double")
    kind = "struct<loads:array<bigint>,shards:array<int>>"
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), shards).alias("loads"), F.array().cast("array<int>").alias("shards")).cast(kind)

    def step(acc: Column, slot: Column, limit: Column) -> Column:
        stays = (slot["old"] >= 0) & (slot["old"] < shards) & (F.get(acc["loads"], slot["old"]) + slot["bytes"] <= limit)
        to = F.when(stays, slot["old"]).otherwise(_lightest(acc["loads"]))
        loads = F.transform(acc["loads"], lambda load, i: load + F.when(i == to, slot["bytes"]).otherwise(F.lit(0).cast("bigint")))
        return F.struct(loads.alias("loads"), F.concat(acc["shards"], F.array(to)).alias("shards"))

    folded = slots.select("slots", F.aggregate("slots", start, lambda a, s: step(a, s, most))["shards"].alias("shards"))
    each = folded.select(F.explode(F.arrays_zip("slots", "shards")).alias("x"))
    return each.select((-F.col("x.slots.key")).alias("vslot"), F.col("x.slots.bytes").alias("bytes"), F.col("x.slots.records").alias("records"), F.col("x.shards").alias("shard"))


def _placed(folded: DataFrame, version: int) -> DataFrame:
    """The map with the place at which each slot begins in its shard."""
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("records").over(before), F.lit(0)).cast("bigint")
    return folded.select("vslot", "shard", "bytes", "records", base.alias("base"), F.lit(version).alias("version"))


def write_map(shard_map: DataFrame, path: str) -> None:
    """Keep a version of the map beside the others under ``path``."""
    shard_map.write.partitionBy("version").mode("append").parquet(path)


def has_map(spark, path: str) -> bool:
    """Whether any version of a map is under ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_map(spark, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, by default the newest."""
    kept = spark.read.schema(MAP).parquet(path)
    wanted = (kept.agg(F.max("version")).first()[0] or 0) if version is None else version
    return kept.filter(F.col("version") == wanted).select("vslot", "shard", "bytes", "records", "base", F.col("version").cast("int"))


def place(records: DataFrame, shard_map: DataFrame) -> DataFrame:
    """``records`` (with vslot, doc_id, text_crc32, size) and their shard and place; the map has a row per slot at most."""
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    numbered = records.withColumn("_n", F.row_number().over(inside) - 1)
    joined = numbered.join(F.broadcast(shard_map.select("vslot", "shard", "base", "version")), "vslot")
    return joined.withColumn("slot", (F.col("base") + F.col("_n")).cast("bigint"))


def report(documents: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version.

    ``path`` is where the versions of the map are kept, by default a new place in the shared folder. If there is one, it is
    edited for the sizes of now; the next version is written, read back, and places the records.
    """
    spark = documents.sparkSession
    path = path or f"{shared_dir(spark)}/shard-map-{uuid.uuid4().hex}"
    records = documents.select(
        F.col(id_col).alias("doc_id"),
        size_of(text_col).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).cast("bigint").alias("text_crc32"),
        slot_of(id_col, text_col, slots).alias("vslot"),
    )
    sizes = slot_sizes(records)
    write_map(rebalance(read_map(spark, path), sizes, shards) if has_map(spark, path) else assign(sizes, shards), path)
    return place(records, read_map(spark, path)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version")
    )
