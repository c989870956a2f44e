"""Joins whose keys may stand in any share of the rows, on both sides of the bounds of a hot key."""

import pytest
from pyspark.sql import functions as F

from siftline.llm import common


@pytest.mark.parametrize(("keys", "rows", "hot"), [(2000, 5_000_000, 900), (1000, 5_000_000, 2), (4, 5_000_000, 1), (1, 5_000_000, 0), (1, 200, 1), (1, 6, 2)])
def test_joins_on_both_sides_of_the_bounds(spark, monkeypatch, keys, rows, hot):
    """One key has 500 rows, one 7, 898 one row each, one none on the left; a null key joins nothing."""
    monkeypatch.setattr(common, "HOT_KEYS", keys)
    monkeypatch.setattr(common, "HOT_ROWS", rows)
    counts = {"big": 500, "mid": 7, **{f"k{i}": 1 for i in range(898)}}
    left = [(k, i) for k, n in counts.items() for i in range(n)] + [(None, 0), ("only left", 0)]
    right = [(k, n, len(k)) for k, n in counts.items()] + [("only right", 1, 0)]
    right_df = common.cut(spark.createDataFrame(right, "key string, n bigint, size int"))
    total = sum(n for _, n, _ in right)
    bound = min(total // keys, rows)
    assert sum(n > bound for n in counts.values()) == hot
    got = common.joined_with_hot(spark.createDataFrame(left, "key string, i int"), right_df, ["key"], "n", ["size"], F.xxhash64("i"))
    assert sorted((r.key, r.i, r.size) for r in got.collect()) == sorted((k, i, len(k)) for k, i in left if k in counts)
    assert common.joined_with_hot(spark.createDataFrame(left, "key string, i int"), common.cut(right_df.where("false")), ["key"], "n", ["size"], F.xxhash64("i")).count() == 0


def test_a_hot_key_is_dealt_by_the_spread(spark, monkeypatch):
    """Of a key over the bound no task gets all rows; of one below it a task does."""
    left = spark.createDataFrame([("big", i) for i in range(4000)], "key string, id int")
    right = common.cut(spark.createDataFrame([("big", 4000, 1)], "key string, n bigint, size int"))

    def tasks() -> int:
        got = common.joined_with_hot(left, right, ["key"], "n", ["size"], F.xxhash64("id"))
        assert got.count() == 4000
        return got.select(F.spark_partition_id()).distinct().count()

    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        monkeypatch.setattr(common, "HOT_KEYS", 1)
        assert tasks() == 1
        monkeypatch.setattr(common, "HOT_ROWS", 3999)
        assert tasks() > 1
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
