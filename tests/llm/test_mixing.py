"""Targets, apportionment and selection against plain versions."""

from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from apilens.llm import mixing


def plain_targets(sizes, share=1.5, most=2, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = share * sum(sizes.values())
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: float(most * sizes[s]) for s in over}


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.sampled_from([None, "", "a", "b", "é", "z", "\U0001f600", "�"]), st.integers(0, 500), min_size=1))
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def plain_seats(votes, house):
    seats = dict.fromkeys(votes, 0)
    for _ in range(house):
        if any(votes.values()):
            seats[max(sorted(votes), key=lambda k: votes[k] / (2 * seats[k] + 1))] += 1
    return seats


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefg"), st.integers(0, 1000), min_size=1), st.lists(st.integers(0, 60), min_size=1, max_size=4))
def test_seats(spark, votes, houses):
    v = spark.createDataFrame(list(votes.items()), "key string, votes long")
    h = spark.createDataFrame(list(enumerate(houses)), "house long, size long")
    got = defaultdict(dict)
    for r in mixing.apportion(v, h).collect():
        got[r.house][r.key] = r.seats
    for number, house in enumerate(houses):
        want = {k: n for k, n in plain_seats(votes, house).items() if votes[k]}
        assert got[number] == want


def test_mix(near, odd, empty):
    for docs in (near, odd):
        rows = mixing.mix(docs, block_tokens=4).collect()
        texts = docs.collect()
        assert len(rows) == len(texts)
        sizes = defaultdict(int)
        for r in texts:
            sizes[r.source] += len((r.text or "").split())
        want = plain_targets(sizes)
        taken = defaultdict(int)
        for r in rows:
            assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
            assert r.target == pytest.approx(want[r.source])
            taken[r.source] += r.taken
        for source, target in want.items():
            assert abs(taken[source] - target) <= 4 * 2
        again = mixing.mix(docs.repartition(2), block_tokens=4).collect()
        key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
        if docs is near:
            assert [key(r) for r in sorted(rows, key=key)] == [key(r) for r in sorted(again, key=key)]
    assert mixing.mix(empty).count() == 0


def test_quotas_add_up(spark):
    sources = spark.createDataFrame([("=a", 1000.0), ("=b", 333.0), ("=c", 50.5)], "source_key string, target double")
    rows = mixing.shard_quotas(sources, block_tokens=10, shards=4).collect()
    assert all(r.quota >= 0 and isinstance(r.quota, int) for r in rows)
    for shard in range(4):
        assert abs(sum(r.quota for r in rows if r.shard == shard) - 138 / 4) <= 1
    assert sum(r.quota for r in rows) == 138


def test_mixed_documents(near, odd, empty):
    for docs in (near, odd):
        out = mixing.mixed_documents(docs, block_tokens=4)
        assert out.columns == docs.columns
        words = defaultdict(int)
        for r in out.collect():
            words[r.doc_id, r.source] += len((r.text or "").split())
        want = defaultdict(int)
        for r in mixing.mix(docs, block_tokens=4).collect():
            want[r.doc_id, r.source] += r.taken
        assert dict(words) == {k: n for k, n in want.items() if n}
    assert mixing.mixed_documents(empty).count() == 0
