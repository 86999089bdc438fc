"""Bounds of range shards."""

from collections import Counter

from apilens.llm import common


def test_bounds_from_a_bounded_number_of_keys(spark, monkeypatch):
    df = spark.range(0, 30_000, 3).withColumnRenamed("id", "k")
    assert common.shard_bounds(df, "k", 1) == []
    for most, shards in ((1 << 16, 8), (512, 8), (512, 100), (16, 100)):
        monkeypatch.setattr(common, "_MOST_KEYS", most)
        bounds = common.shard_bounds(df, "k", shards)
        assert bounds == common.shard_bounds(df.repartition(5), "k", shards) == sorted(set(bounds))
        assert len(bounds) <= min(shards, most) and (most == 16 or len(bounds) == shards - 1)
        sizes = Counter(r.shard for r in common.with_shard(df, "k", bounds).collect())
        assert sum(sizes.values()) == 10_000
        if (most, shards) == (1 << 16, 8):
            assert max(sizes.values()) < 2 * 10_000 / 8
