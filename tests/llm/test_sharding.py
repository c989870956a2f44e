import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from siftline.llm import sharding
from siftline.llm.common import shared_folder


def checked(rows, expected, shards=16):
    assert sorted((r.id, r.size, r.crc) for r in rows) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in expected)
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(shards))
    assert len({(r.id, r.crc, r.vslot, r.shard) for r in rows}) == len({(r.id, r.crc) for r in rows})


def test_query_keeps_its_law(spark):
    d = "/root/testdata/sf0.01"
    rows = sharding.op1_sharding(spark, d).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    sums, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(sums) == set(range(16))
    assert max(sums.values()) - min(sums.values()) <= 0.005 * sum(sums.values()) / 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_odd_rows(spark):
    texts = [(i, "x" * (i % 50)) for i in range(300)] + [(3, "again"), (3, "again"), (1 << 50, None), (7777, ""), (8888, "é字" * 90000)]
    docs = spark.createDataFrame([(*t, 1, "s") for t in texts], "doc_id bigint, text string, shard int, slot string")
    folder = lambda: shared_folder(spark, "map")
    kept = folder()
    placed = sharding.shard(docs, kept, slots=512)
    checked(placed.collect(), texts)
    with_null = docs.union(spark.createDataFrame([(None, "a", 0, ""), (None, None, 0, "")], docs.schema))
    assert sharding.shard(with_null, folder()).where("id IS NULL").select("vslot").distinct().count() == 2
    assert sharding.shard(docs.where("false"), folder()).count() == 0
    again = sharding.shard(docs, kept, slots=512, new=False)
    assert sorted(again.collect()) == sorted(placed.collect())
    assert len(sharding.SlotMap.stored(spark, kept, 16).versions) == 3


def test_stored_versions_hold_and_are_never_replaced(spark):
    kept = shared_folder(spark, "map")
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    before = {r.id: r.shard for r in sharding.shard(docs, kept, 8).collect()}
    grown = sharding.shard(docs, kept, 9, new=False).collect()
    assert {r.shard for r in grown} == set(range(9))
    assert 0 < sum(before[r.id] != r.shard for r in grown) < 800
    stored = sharding.SlotMap.stored(spark, kept, 9).versions
    assert len(stored) == 3 and set(stored[1]) == set(range(8))
    with pytest.raises(AnalysisException, match="EXISTS"):
        sharding.SlotMap.dealt(8).store(spark, kept)


def test_versions_are_kept_and_moves_are_few(spark):
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 1000, 512).astype(float)
    first = sharding.SlotMap.dealt(8, 512)
    second = first.rebalanced(sizes)
    totals = np.bincount(second.versions[-1], weights=sizes)
    assert totals.max() - totals.min() <= 0.005 * totals.mean()
    assert (second.versions[0] == first.versions[0]).all() and 0 < (second.versions[1] != second.versions[0]).sum() < 100
    sizes[:3] *= 40
    third = second.rebalanced(sizes)
    read = sharding.SlotMap.read(third.table(spark), 8)
    assert len(read.versions) == 3 and all((a == b).all() for a, b in zip(read.versions, third.versions, strict=True))
