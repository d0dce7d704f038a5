"""Sharding by fixed virtual slots: records are hashed into thousands of slots, and a map says which shard each slot is in.

The slot of a record follows from its id and text alone and never changes. What a map is made from is the bytes of each
slot; a slot that many records share (equal rows have one slot) is split into chunks of about so many bytes, in the order
of its records, so that a third of all records in one slot still spread over all shards. Slots go to shards from the largest down,
each to the emptiest, which leaves shards apart by less than a chunk or two: the law is that of equal bytes.

Maps are tables with a version. A new version is edited from the one before: new slots go to the emptiest shards, then
slots move from the fullest to the emptiest until none is over the tolerance. A shard that is added takes slots and gives
none, so records move only into it while the others are in balance.

Places in a shard are gapless: a slot begins where the one before it ends, and a record's place in its slot is the sum of
the records before it over range partitions, so no task holds a slot, a shard or a text of many copies. The driver sees
the slots (at most SLOTS and CHUNKS for each shard), never records.

Null text has no bytes, so size 1; very long texts are records like any other. Null ids are ids. Equal rows are records each by
itself, with a place each. Other columns of the table, whatever their names, play no part. An empty table gives no rows and
a map without slots.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import fresh_path, written
from runledger.operators.ordered import running

#: Slots that records are hashed into, for good; chunks that the bytes of a shard make at least.
SLOTS, CHUNKS = 4096, 64
#: Share of the mean that a shard may have more before slots move.
TOLERANCE = 0.01


@dataclass(frozen=True)
class Slot:
    """A slot, or a chunk of one: what it holds, where its records begin in the slot, its shard and where it begins there."""

    slot: int
    chunk: int
    bytes: int
    rows: int
    first: int
    shard: int = -1
    start: int = 0


_MAP_SQL = "slot int, chunk int, bytes long, rows long, first long, shard int, start long, shards int, chunk_bytes long"


@dataclass(frozen=True)
class SlotMap:
    """Which shard each slot is in; chunk_bytes stays the same from version to version."""

    slots: tuple[Slot, ...]
    shards: int
    chunk_bytes: int

    def loads(self) -> list[int]:
        """Bytes of each shard."""
        out = [0] * self.shards
        for s in self.slots:
            out[s.shard] += s.bytes
        return out


def _placed(slots: Iterable[Slot]) -> tuple[Slot, ...]:
    """The slots with the places that they begin at: in each shard, slot after slot."""
    starts: dict[int, int] = {}
    out = []
    for s in sorted(slots, key=lambda s: (s.slot, s.chunk)):
        out.append(replace(s, start=starts.get(s.shard, 0)))
        starts[s.shard] = out[-1].start + s.rows
    return tuple(out)


def assigned(slots: Iterable[Slot], shards: int, chunk_bytes: int) -> SlotMap:
    """A first map: from the largest slot down, each to the emptiest shard."""
    heap, out = [(0, k) for k in range(shards)], []
    for s in sorted(slots, key=lambda s: (-s.bytes, s.slot, s.chunk)):
        load, k = heap[0]
        out.append(replace(s, shard=k))
        heapq.heapreplace(heap, (load + s.bytes, k))
    return SlotMap(_placed(out), shards, chunk_bytes)


def rebalanced(old: SlotMap, slots: Iterable[Slot], shards: int, tolerance: float = TOLERANCE) -> SlotMap:
    """The map of these slots with the fewest moves from the old one: only into shards below the mean, out of those above.

    Slots of shards that are no more, and new slots, go to the emptiest shards first.
    """
    owner = {(s.slot, s.chunk): s.shard for s in old.slots if s.shard < shards}
    held: list[list[Slot]] = [[] for _ in range(shards)]
    load, homeless = [0] * shards, []
    for s in slots:
        k = owner.get((s.slot, s.chunk))
        if k is None:
            homeless.append(s)
        else:
            held[k].append(s)
            load[k] += s.bytes
    for s in sorted(homeless, key=lambda s: (-s.bytes, s.slot, s.chunk)):
        k = min(range(shards), key=lambda k: (load[k], k))
        held[k].append(s)
        load[k] += s.bytes
    mean = sum(load) / shards
    while True:
        full, empty = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
        if load[full] <= mean * (1 + tolerance) and load[empty] >= mean * (1 - tolerance):
            break
        # Of the slots whose move leaves the two closer to each other, the one that leaves them closest to the mean.
        movable = [s for s in held[full] if s.bytes < load[full] - load[empty]]
        if not movable:
            break
        s = min(movable, key=lambda s: (max(abs(load[full] - s.bytes - mean), abs(load[empty] + s.bytes - mean)), s.slot, s.chunk))
        held[full].remove(s)
        held[empty].append(s)
        load[full] -= s.bytes
        load[empty] += s.bytes
    return SlotMap(_placed(replace(s, shard=k) for k, own in enumerate(held) for s in own), shards, old.chunk_bytes)


def store(spark: SparkSession, folder: str, version: int, map_: SlotMap) -> None:
    """Writes a version of the map below the folder; a version that is there is never written again."""
    rows = [(s.slot, s.chunk, s.bytes, s.rows, s.first, s.shard, s.start, map_.shards, map_.chunk_bytes) for s in map_.slots]
    # A map without slots has one row that is none, for its other values.
    rows = rows or [(-1, 0, 0, 0, 0, -1, 0, map_.shards, map_.chunk_bytes)]
    spark.createDataFrame(rows, _MAP_SQL).coalesce(1).write.mode("error").parquet(f"{folder}/version={version}")


def load(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, SlotMap]:
    """(version, map) of the last version below the folder, or of the one that is named."""
    versions = spark.read.parquet(folder)
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    rows = versions.where(F.col("version") == version).drop("version").collect()
    if not rows:
        raise ValueError(f"there is no version {version} of the map in {folder}")
    slots = tuple(Slot(*r[:7]) for r in rows if r["slot"] >= 0)
    return version, SlotMap(tuple(sorted(slots, key=lambda s: (s.slot, s.chunk))), rows[0]["shards"], rows[0]["chunk_bytes"])


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot, position, begin) of every row, in the shared folder.

    position and begin are the records and bytes before it in its slot.
    """
    id_, text = F.col(id_col), F.col(text_col).cast("string")
    own = F.xxhash64(id_, text)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    sized = docs.select(id_.alias("id"), size.alias("size"), F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"), own.alias("hash"), F.pmod(own, F.lit(slots)).cast("int").alias("virtual_slot"), F.monotonically_increasing_id().alias("row"))
    ordered = running(written(sized, "sizes"), ["virtual_slot"], ["hash", "row"], {"position": "1L", "begin": "size"})
    return written(ordered.drop("hash", "row"), "records")


def slots_of(recs: DataFrame, chunk_bytes: int) -> list[Slot]:
    """The slots of records, and the chunks of slots of more bytes."""
    rows = recs.groupBy("virtual_slot", F.floor(F.col("begin") / chunk_bytes).cast("int").alias("chunk")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("position").alias("first"))
    return [Slot(*r) for r in rows.collect()]


def chunk_bytes_for(recs: DataFrame, shards: int) -> int:
    """Bytes that a slot may have before it is split."""
    total = recs.agg(F.sum("size")).first()[0] or 0
    return max(1, -(-total // (shards * CHUNKS)))


def located(recs: DataFrame, map_: SlotMap) -> DataFrame:
    """Records with shard and slot, their place in it. The map, which is no longer than its slots, is broadcast."""
    spark = recs.sparkSession
    entries = spark.createDataFrame([(s.slot, s.chunk, s.shard, s.start - s.first) for s in map_.slots], "virtual_slot int, chunk int, shard int, shift long")
    chunked = recs.withColumn("chunk", F.floor(F.col("begin") / map_.chunk_bytes).cast("int"))
    return chunked.join(F.broadcast(entries), ["virtual_slot", "chunk"]).withColumn("slot", F.col("position") + F.col("shift"))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, slots: int = SLOTS) -> DataFrame:
    """One row per row of docs: <id_col>, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    With the folder of an earlier call, its last map is edited for these records and shards and stored as the next version.
    """
    spark = docs.sparkSession
    recs = records(docs, id_col, text_col, slots)
    if folder is None:
        folder, old = fresh_path(spark, "slot-map"), None
    else:
        old = _last(spark, folder)
    if old is None:
        size = chunk_bytes_for(recs, shards)
        version, made = 1, assigned(slots_of(recs, size), shards, size)
    else:
        version, made = old[0] + 1, rebalanced(old[1], slots_of(recs, old[1].chunk_bytes), shards)
    store(spark, folder, version, made)
    return located(recs, made).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version")
    )


def _last(spark: SparkSession, folder: str) -> tuple[int, SlotMap] | None:
    """The last map below the folder, none if nothing was stored there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return load(spark, folder)
