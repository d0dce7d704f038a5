import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from runledger.llm import sharding as sh


def check(frame, shards=8, near=None, **kw):
    docs = [(r["doc_id"], r["text"] or "") for r in frame.collect()]
    got = sh.shard(frame, shards, **kw).collect()
    want = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    places, loads = defaultdict(list), Counter(dict.fromkeys(range(shards), 0))
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        places[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    largest = max(r["size"] for r in got)
    # No shard is apart by more than a record and a chunk.
    assert max(loads.values()) - min(loads.values()) <= (near or largest + sum(loads.values()) / shards / sh.CHUNKS + 1)
    return got


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, None), (3, "é€😀"), (4, "same"), (4, "same"), (5, "long " * 30_000)] + [(k, "text " * (k % 30)) for k in range(100, 900)]
    frame = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], "doc_id long, text string, slot int, shard string, size int").repartition(5)
    check(frame)
    check(frame, 1)
    assert sh.shard(frame.where(F.lit(False))).collect() == []


def test_equal_rows_of_a_third_are_spread(spark):
    frame = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.repeat(F.lit("ab "), (F.col("id") % 50).cast("int"))).otherwise("the same text").alias("text"))
    got = check(frame)
    assert {r["shard"] for r in got if r["doc_id"] is None} == set(range(8))


def test_small_table_is_near_equal(spark):
    got = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) < 1.02 * min(loads.values())


def test_same_rows_give_the_same_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = (sorted((r["doc_id"], r["shard"], r["slot"]) for r in sh.shard(f).collect()) for f in (docs, docs.repartition(13)))
    assert a == b


def test_one_more_shard_takes_records_only_into_itself(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    folder = f"file://{tmp_path}/map"
    first = {r["doc_id"]: r["shard"] for r in check(docs, 8, folder=folder)}
    grown = check(docs, 9, near=10**9, folder=folder)
    assert {r["map_version"] for r in grown} == {2}
    moved = [r["doc_id"] for r in grown if r["shard"] != first[r["doc_id"]]]
    assert 0 < len(moved) and all(r["shard"] == 8 for r in grown if r["shard"] != first[r["doc_id"]])
    loads = Counter()
    for r in grown:
        loads[r["shard"]] += r["size"]
    mean = sum(loads.values()) / 9
    assert max(loads.values()) < 1.03 * mean and min(loads.values()) > 0.95 * mean
    # Both versions stay; the first is as it was, and is never written again.
    assert sh.load(spark, folder)[0] == 2
    assert sh.load(spark, folder, 1)[1].shards == 8
    with pytest.raises(Exception, match="(?i)exists"):
        sh.store(spark, folder, 1, sh.load(spark, folder)[1])


def test_editing_moves_little_when_slots_grow():
    slots = [sh.Slot(k, 0, 100 + k % 7, 10, 0) for k in range(400)]
    old = sh.assigned(slots, 8, 1000)
    assert sh.rebalanced(old, slots, 8).slots == old.slots
    grown = [sh.Slot(s.slot, 0, s.bytes * (3 if s.slot % 50 == 0 else 1), 10, 0) for s in slots]
    new = sh.rebalanced(old, grown, 8)
    owner = {s.slot: s.shard for s in old.slots}
    assert sum(s.shard != owner[s.slot] for s in new.slots) < 20
    assert max(new.loads()) < 1.03 * sum(new.loads()) / 8
    fewer = sh.rebalanced(old, slots, 5)
    assert all(s.shard == owner[s.slot] for s in fewer.slots if owner[s.slot] < 5)
    assert max(fewer.loads()) < 1.02 * sum(fewer.loads()) / 5
