"""Sharding by fixed virtual slots and a versioned map from slots to shards.

Each record is hashed into one of thousands of virtual slots; that never changes. The hash is of its id and its
text's checksum, so that records that share an id, or lack one, are not all in one slot. A map, which is stored as a table,
says which shard has which slot. Its first version deals the slots out in turn; rebalancing adds a
version that moves few slots, by the bytes counted per slot, until shards are as near equal as
moves of single slots can make them. All versions stay in the map's table, so any earlier
placement can be read again. A record's place in its shard is its slot's offset plus its rank in
the slot, so no shard is ever sorted as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.common import cut, shared_folder, table

SLOTS = 4096


def slot_of(id_column: Column, checksum: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(id_column, checksum), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """``versions[v][slot]`` is the slot's shard in version ``v``; the last version holds."""

    shards: int
    versions: tuple[np.ndarray, ...]

    @classmethod
    def dealt(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(shards, (np.arange(slots) % shards,))

    def edited(self, moves: dict[int, int], shards: int | None = None) -> SlotMap:
        """A new version in which the slots in ``moves`` have other shards."""
        new = self.versions[-1].copy()
        for slot, shard in moves.items():
            new[slot] = shard
        return SlotMap(shards or self.shards, (*self.versions, new))

    def rebalanced(self, sizes: np.ndarray) -> SlotMap:
        """A new version: from the largest shard to the smallest goes the slot nearest to half their
        difference, again and again, as long as that brings the two nearer to each other."""
        placed = self.versions[-1].copy()
        totals = np.bincount(placed, weights=sizes, minlength=self.shards)
        while True:
            large, small = int(totals.argmax()), int(totals.argmin())
            gap = totals[large] - totals[small]
            slots = np.flatnonzero((placed == large) & (sizes > 0) & (sizes < gap))
            if not len(slots):
                break
            slot = slots[np.abs(sizes[slots] - gap / 2).argmin()]
            placed[slot] = small
            totals[large] -= sizes[slot]
            totals[small] += sizes[slot]
        moves = np.flatnonzero(placed != self.versions[-1])
        return self.edited(dict(zip(moves.tolist(), placed[moves].tolist(), strict=True)))

    def table(self, spark: SparkSession) -> DataFrame:
        """``version``, ``slot``, ``shard``: for each version the slots whose shard it changes."""
        rows, before = [], np.full(len(self.versions[0]), -1)
        for version, placed in enumerate(self.versions):
            rows += [(version, int(s), int(placed[s])) for s in np.flatnonzero(placed != before)]
            before = placed
        return spark.createDataFrame(rows, "version int, slot int, shard int")

    @classmethod
    def read(cls, rows: DataFrame, shards: int) -> SlotMap:
        """The map that ``table`` made; as many rows as slots and moves, whatever the records."""
        changes = sorted((r.version, r.slot, r.shard) for r in rows.collect())
        placed = np.full(max(slot for _, slot, _ in changes) + 1, -1)
        versions = []
        for version in range(changes[-1][0] + 1):
            placed = placed.copy()
            for v, slot, shard in changes:
                if v == version:
                    placed[slot] = shard
            versions.append(placed)
        return cls(shards, tuple(versions))

    def store(self, spark: SparkSession, folder: str, first: int = 0) -> None:
        """Writes versions from ``first`` on, each to a folder of its own; one that is there already is an error, never replaced.

        A version that changes nothing is written as the first slot's unchanged shard, so that it is counted.
        """
        for version in range(first, len(self.versions)):
            placed = self.versions[version]
            before = self.versions[version - 1] if version else np.full(len(placed), -1)
            moved = np.flatnonzero(placed != before)
            rows = [(int(s), int(placed[s])) for s in (moved if len(moved) else [0])]
            spark.createDataFrame(rows, "slot int, shard int").coalesce(1).write.parquet(f"{folder}/version={version:06d}")

    @classmethod
    def stored(cls, spark: SparkSession, folder: str, shards: int) -> SlotMap:
        return cls.read(spark.read.parquet(folder), shards)


def records(docs: DataFrame, slots: int, id_column: str, text_column: str) -> DataFrame:
    """What is kept of each record: ``id``, ``size``, ``crc``, ``vslot``."""
    return docs.select(
        F.col(id_column).alias("id"),
        (F.coalesce(F.octet_length(text_column), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_column), F.lit("")).cast("binary")).alias("crc"),
    ).withColumn("vslot", slot_of(F.col("id"), F.col("crc"), slots))


def slot_sizes(placed: DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and records of each slot; the driver gets a row for each slot, whatever the records."""
    sizes, counts = np.zeros(slots), np.zeros(slots, dtype=np.int64)
    for r in placed.groupBy("vslot").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect():
        sizes[r.vslot], counts[r.vslot] = r.s, r.n
    return sizes, counts


def shard(
    docs: DataFrame,
    folder: str,
    shards: int = 16,
    slots: int = SLOTS,
    new: bool = True,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id``, ``size``, ``crc``, ``vslot``, ``shard``, ``place`` of each record.

    The map in ``folder`` (if ``new``, a first version is written there) is rebalanced and stored as its next version, and records are
    placed by what is then read from it. ``size`` is the UTF-8 bytes of the text plus one, so 1 for a null text; texts are read
    once, of any length. ``place`` counts the
    records of a shard from 0 without gaps, by virtual slot and then by id, size and checksum;
    repeated rows have places of their own and share a slot, which cannot be split; other rows with the same id or none are
    spread by their checksums. An empty table gives none; other columns are not read. Nothing but
    four numbers a record is shuffled.
    """
    spark = docs.sparkSession
    base = cut(records(docs, slots, id_column, text_column))
    sizes, counts = slot_sizes(base, slots)
    if new:
        SlotMap.dealt(shards, slots).store(spark, folder)
    before = SlotMap.stored(spark, folder, shards)
    before.rebalanced(sizes).store(spark, folder, len(before.versions))
    placed = SlotMap.stored(spark, folder, shards).versions[-1]
    offsets = np.zeros(slots, dtype=np.int64)
    for s in range(shards):
        own = np.flatnonzero(placed == s)
        offsets[own] = np.cumsum(counts[own]) - counts[own]
    places = spark.createDataFrame([(i, int(placed[i]), int(offsets[i])) for i in range(slots)], "vslot int, shard int, first long")
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("id", "size", "crc"))
    ranked = base.withColumn("rank", rank).join(F.broadcast(places), "vslot")
    return ranked.select("id", "size", "crc", "vslot", "shard", (F.col("first") + F.col("rank") - 1).alias("place"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 16 shards of nearly equal bytes; ``slot`` is the place in the shard."""
    placed = shard(table(spark, sf_dir, "documents"), shared_folder(spark, "slot_map"), 16)
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
    )


QUERIES = {"op1_sharding": op1_sharding}
ORACLES: dict[str, str] = {}
