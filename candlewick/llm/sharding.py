"""Sharding over fixed virtual slots.

Records are hashed into ``N_SLOTS`` slots once and for all. The bytes of each
slot are summed, and a versioned map says which shard owns each slot. A new map
is the old one edited: ``rebalanced`` moves as few slots as even shards allow.

The law is ``bytes``: shards differ by less than a slot or so. A record's size
is its UTF-8 bytes plus one; null text: no bytes. Key and text together pick the
slot, so that a group of equal texts, which may hold a third of all rows, is
dealt out over all slots and shards; groups are not kept together. Rows equal in
key and text share a slot, count each and get places of their own; a null key is
hashed like any other. An empty table gives a map all the same. Only the named
columns are read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_SLOTS = 4096


def slot_of(*key: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n_slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """``owner[s]`` is the shard of slot ``s``."""

    version: int
    n_shards: int
    owner: tuple[int, ...]

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the store at ``path``; a version is written once."""
        rows = [(s, o, self.n_shards) for s, o in enumerate(self.owner)]
        spark.createDataFrame(rows, "slot int, shard int, n_shards int").coalesce(1).write.mode("error").parquet(f"{path}/version={self.version}")

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*")))

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version, else the latest."""
        stored = spark.read.parquet(path)
        at = version if version is not None else stored.agg(F.max("version")).first()[0]
        rows = stored.where(F.col("version") == at).orderBy("slot").collect()  # one per slot
        return SlotMap(at, rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def assigned(slot_bytes: list[int], n_shards: int, version: int = 1) -> SlotMap:
    """A first map: the largest slot left goes to the lightest shard."""
    owner = [0] * len(slot_bytes)
    heap = [(0, k) for k in range(n_shards)]
    for s in sorted(range(len(slot_bytes)), key=lambda s: (-slot_bytes[s], s)):
        load, k = heapq.heappop(heap)
        owner[s] = k
        heapq.heappush(heap, (load + slot_bytes[s], k))
    return SlotMap(version, n_shards, tuple(owner))


def rebalanced(old: SlotMap, slot_bytes: list[int], n_shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
    """The next version: slots leave shards that go or that lie above the mean.

    Slots of shards that stay move only from shards above the mean by more than
    ``tolerance``; each goes to the lightest shard.
    """
    n = n_shards or old.n_shards
    mean = sum(slot_bytes) / n
    load, held = [0] * n, [[] for _ in range(n)]
    loose = []
    for s, k in enumerate(old.owner):
        if k < n:
            load[k] += slot_bytes[s]
            held[k].append(s)
        else:
            loose.append(s)
    for k in range(n):
        for s in sorted(held[k], key=lambda s: (-slot_bytes[s], s)):
            if load[k] <= mean * (1 + tolerance):
                break
            if 0 < slot_bytes[s] <= load[k] - mean:
                load[k] -= slot_bytes[s]
                loose.append(s)
    owner = list(old.owner)
    heap = [(load[k], k) for k in range(n)]
    heapq.heapify(heap)
    for s in sorted(loose, key=lambda s: (-slot_bytes[s], s)):
        now, k = heapq.heappop(heap)
        owner[s] = k
        heapq.heappush(heap, (now + slot_bytes[s], k))
    return SlotMap(old.version + 1, n, tuple(owner))


def records(docs: DataFrame, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """``key``, ``size``, ``text_crc32`` and virtual slot of each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("key"),
        (F.octet_length(t) + F.lit(1)).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        slot_of(F.col(key), t, n_slots=n_slots).alias("virtual_slot"),
    )


def slot_totals(rows: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; what reaches the driver is bounded by the number of slots."""
    size, count = [0] * n_slots, [0] * n_slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r["virtual_slot"]], count[r["virtual_slot"]] = r["b"], r["n"]
    return size, count


def placed(rows: DataFrame, owners: SlotMap, count: list[int]) -> DataFrame:
    """Adds ``shard`` and ``slot``, the row's place in its shard from 0 without gaps.

    A shard's slots follow one another; within a slot rows are ordered by key,
    checksum and size, so no task holds more than a few slots.
    """
    spark = rows.sparkSession
    place, starts = [0] * owners.n_shards, []
    for s, k in enumerate(owners.owner):
        starts.append((s, k, place[k]))
        place[k] += count[s]
    of = spark.createDataFrame(starts, "virtual_slot int, shard int, first long")
    rank = F.expr("row_number() OVER (PARTITION BY virtual_slot ORDER BY key, text_crc32, size)")
    # One row per virtual slot: the side to broadcast is bounded by their number.
    return rows.withColumn("rank", rank).join(F.broadcast(of), "virtual_slot").withColumn("slot", F.col("first") + F.col("rank") - 1).drop("first", "rank")


def sharded(docs: DataFrame, store: str, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard of each row by the next map of ``store``: its latest one edited to ``n_shards`` even shards, or a first one."""
    spark = docs.sparkSession
    rows = records(docs, key, text)
    size, count = slot_totals(rows)
    owners = rebalanced(SlotMap.load(spark, store), size, n_shards) if SlotMap.exists(spark, store) else assigned(size, n_shards)
    owners.save(spark, store)
    return placed(rows, owners, count).withColumnRenamed("key", key)
