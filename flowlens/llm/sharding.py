"""Sharding through fixed virtual slots.

A record's slot depends on its key alone and never changes. Bytes are aggregated per slot in Spark, and a small
versioned table maps slots to shards: version 1 deals slots evenly, and each rebalancing writes a new version that
moves or swaps as few slots as bring the shards' bytes within ``tolerance`` of each other. Only the map is edited;
no record is hashed anew. The map has ``n_slots`` rows, which bounds what reaches the driver and what is broadcast.

Law of the query: ``bytes`` (shard sizes near equal). A slot is the unit of balance, so the spread is limited by
the largest document.

Defined cases: a null text has size 8 (the record overhead) and the crc32 of the empty text; a null key is replaced
by the text's digest, so such rows spread over slots; equal rows share a slot; an empty table has the even map.
Extra columns pass through ``assign``; one that bears an output name is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.llm.textbytes import without
from flowlens.session import ensure_checkpoint_dir, materialize

N_SLOTS = 4096
N_SHARDS = 24
OVERHEAD = 8
TOLERANCE = 1e-3


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus the record overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("long")


def virtual_slot(key: Column, text: Column, n_slots: int = N_SLOTS) -> Column:
    """Fixed slot of a record: a hash of its key, or of the text's digest where the key is null."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.sha2(text, 256), F.lit(""))), F.lit(n_slots)).cast("int")


def slot_bytes(records: DataFrame) -> DataFrame:
    """(vslot, rows, bytes) of records that have vslot and size; at most n_slots rows."""
    return records.groupBy("vslot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def even_map(n_slots: int, n_shards: int) -> np.ndarray:
    """Version 1: slots dealt round."""
    return np.arange(n_slots, dtype=np.int64) % n_shards


def rebalanced(slot_map: np.ndarray, weights: np.ndarray, n_shards: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """Edited copy of the map: between the heaviest and the lightest shard, move the slot (or swap the pair of
    slots) whose weight comes nearest to half their gap, until the gap is within tolerance of the mean or no edit
    narrows it. New shards (ids beyond those in the map) start empty and are filled the same way."""
    out = slot_map.copy()
    load = np.bincount(out, weights=weights, minlength=n_shards).astype(np.int64)
    mean = weights.sum() / n_shards
    stuck: set[tuple[int, int]] = set()
    for _ in range(64 * len(out)):
        order = np.argsort(load, kind="stable")
        pair = next(((int(a), int(b)) for a in order[::-1][:6] for b in order[:6]
                     if load[a] - load[b] > tolerance * mean and (int(a), int(b)) not in stuck), None)
        if pair is None:
            break
        hi, lo = pair
        gap = load[hi] - load[lo]
        mine = np.flatnonzero((out == hi) & (weights > 0))
        theirs = np.flatnonzero(out == lo)
        lots = np.concatenate([[0], weights[theirs]])  # 0: a plain move
        by = np.argsort(lots, kind="stable")
        want = weights[mine] - gap / 2
        at = np.clip(np.searchsorted(lots[by], want), 1, len(by) - 1) if len(by) > 1 else np.zeros(len(mine), int)
        near = np.where(np.abs(lots[by][at - 1] - want) <= np.abs(lots[by][at] - want), at - 1, at) if len(by) > 1 else at
        net = weights[mine] - lots[by][near]
        good = (net > 0) & (net < gap)
        if not good.any():
            stuck.add(pair)
            continue
        pick = int(np.argmin(np.where(good, np.abs(net - gap / 2), np.inf)))
        back = by[near[pick]]
        out[mine[pick]] = lo
        if back > 0:
            out[theirs[back - 1]] = hi
        load[hi] -= int(net[pick])
        load[lo] += int(net[pick])
        stuck = {p for p in stuck if hi not in p and lo not in p}
    return out


class SlotMaps:
    """Versions of a slot-to-shard map, kept as one Parquet folder a version under ``path``."""

    def __init__(self, spark: SparkSession, path: str, n_slots: int = N_SLOTS):
        self.spark, self.path, self.n_slots = spark, path.rstrip("/"), n_slots

    def save(self, version: int, slot_map: np.ndarray) -> None:
        rows = [(version, i, int(s)) for i, s in enumerate(slot_map)]
        frame = self.spark.createDataFrame(rows, "version int, vslot int, shard int")
        frame.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/version={version:06d}")

    def frame(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version:06d}").select("vslot", "shard")

    def load(self, version: int) -> np.ndarray:
        out = np.zeros(self.n_slots, dtype=np.int64)
        for r in self.frame(version).collect():
            out[r["vslot"]] = r["shard"]
        return out

    def rebalance(self, version: int, weights: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> int:
        """Write version + 1, edited from ``version`` by slot_bytes rows; returns its number."""
        sizes = np.zeros(self.n_slots, dtype=np.int64)
        for r in weights.collect():
            sizes[r["vslot"]] = r["bytes"]
        self.save(version + 1, rebalanced(self.load(version), sizes, n_shards, tolerance))
        return version + 1


def assign(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, key: str = "doc_id",
           maps: SlotMaps | None = None) -> DataFrame:
    """Adds size, text_crc32, vslot, shard and slot (place in the shard, from 0) to the documents.

    The place is the rows of the shard's earlier virtual slots plus the row's number in its own virtual slot, so the
    only window runs inside one of the thousands of virtual slots.
    """
    spark = docs.sparkSession
    names = without(docs, ["size", "text_crc32", "vslot", "shard", "slot"])
    records = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), record_bytes(docs["text"]).alias("size"),
                          F.crc32(F.coalesce(docs["text"], F.lit("")).cast("binary")).alias("text_crc32"),
                          virtual_slot(docs[key], docs["text"], n_slots).alias("vslot"))
    weights = materialize(slot_bytes(records), "slot_bytes")
    if maps is None:
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/slot-maps/{spark.sparkContext.applicationId}"
        maps = SlotMaps(spark, f"{folder}-{np.random.default_rng().integers(1 << 62):x}", n_slots)
        maps.save(1, even_map(n_slots, n_shards))
    version = maps.rebalance(1, weights, n_shards)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    placed = (maps.frame(version).join(weights, "vslot")
              .withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0))).select("vslot", "shard", "base"))
    number = F.row_number().over(Window.partitionBy("vslot").orderBy(F.col(f"row.{key}"), "text_crc32", "size")) - 1
    return (records.withColumn("nth", number).join(F.broadcast(placed), "vslot")
            .select("row.*", "size", "text_crc32", "vslot", "shard", (F.col("base") + F.col("nth")).cast("long").alias("slot")))


def write_shards(docs: DataFrame, path: str, **params) -> None:
    """One folder per shard; a hot shard's rows may be written by several tasks."""
    assign(docs, **params).write.partitionBy("shard").parquet(path)
