"""Shards hold their law on odd, hot and empty tables, and do not depend on partitioning."""

from collections import Counter, defaultdict

import pytest

from apilens.llm import sharding

SCHEMA = "doc_id long, text string"


def check(docs, rows, shards, per_shard=64):
    """Every row once, gapless slots, groups together, sizes equal up to a range or what cannot be divided."""
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1) for r in docs.collect())
    assert Counter((r.doc_id, r.size) for r in rows) == want
    slots, sizes, groups = defaultdict(list), Counter(), defaultdict(set)
    bytes_of = Counter()
    for r in rows:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        groups[r.text_crc32, r.size].add(r.shard)
        bytes_of[r.text_crc32, r.size] += r.size
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
    total = sum(sizes.values())
    ideal = total / (shards * per_shard)
    whole = max((n for g, n in bytes_of.items() if n <= 2 * ideal), default=0)
    slack = max([2 * ideal + whole, *(s for _, s in want)]) + 1
    for shard in range(shards):
        assert abs(sizes[shard] - total / shards) <= slack
    for group, found in groups.items():
        assert max(found) - min(found) + 1 == len(found)
        if len(found) > 1:
            assert bytes_of[group] > ideal / 2
    return sizes


def test_near_and_partitions(near):
    rows = sharding.assign(near, shards=4).collect()
    check(near, rows, 4)
    again = sharding.assign(near.repartition(7), shards=4).collect()
    assert sorted(rows) == sorted(again)


def test_odd(odd):
    rows = sharding.assign(odd, shards=3, ranges_per_shard=4).collect()
    check(odd, rows, 3, 4)
    assert {r.size for r in rows if r.doc_id == 4} == {1}


def test_one_shard_and_empty(near, empty):
    assert {r.shard for r in sharding.assign(near, shards=1).collect()} == {0}
    assert sharding.assign(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(near, shards=0)


@pytest.mark.parametrize("kind", ["copies", "same_rows", "empty_texts"])
def test_hot_group(spark, kind):
    """A third of all rows with one text, with ids of their own or even all the same."""
    hot = {"copies": lambda i: (i, "the same text " * 5), "same_rows": lambda i: (7, "the same text " * 5), "empty_texts": lambda i: (None, None)}[kind]
    rows = [hot(i) if i % 3 == 0 else (i, f"text {i} " * (1 + i % 9)) for i in range(6000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sharding.assign(docs, shards=8).collect()
    sizes = check(docs, got, 8)
    assert max(sizes.values()) < 1.05 * sum(sizes.values()) / 8


def test_long_runs_are_divided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LONGEST_RUN", 10)
    docs = spark.createDataFrame([(1, "same")] * 95 + [(2, "other")], SCHEMA)
    got = sharding.assign(docs, shards=2, ranges_per_shard=2).collect()
    check(docs, got, 2, 2)


def test_overfull_ranges_are_divided(near, monkeypatch):
    """Even from a sample that is far too small the ranges end up bounded."""
    monkeypatch.setattr(sharding, "OVERSAMPLING", 1)
    rows = sharding.assign(near, shards=4, ranges_per_shard=32).collect()
    total = sum(r.size for r in rows)
    ranges, items = Counter(), Counter()
    for r in rows:
        ranges[r.range] += r.size
        items[r.range] += 1
    assert all(n <= 2 * total / 128 or items[k] == 1 for k, n in ranges.items())


def test_written_shards(odd, spark, tmp_path):
    plan = sharding.assign(odd, shards=3, ranges_per_shard=4)
    out = sharding.write_shards(odd, str(tmp_path / "out"), shards=3, ranges_per_shard=4)
    assert "shard" in odd.columns and set(out.columns) == {*odd.columns, "_shard"}
    want = Counter((r.doc_id, r.size) for r in plan.collect())
    got = Counter((r.doc_id, len((r.text or "").encode()) + 1) for r in out.collect())
    assert got == want
    single = Counter((r.doc_id, r.shard) for r in plan.collect() if r.doc_id not in (9, None))
    assert Counter((r.doc_id, r._shard) for r in out.collect() if r.doc_id not in (9, None)) == single
