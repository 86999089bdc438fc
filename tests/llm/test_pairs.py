"""SimHash links and exact duplicates against brute force."""

import hashlib
import re
import uuid
from collections import defaultdict

import xxhash

from apilens.llm import components, exact_dedup, repetition, simhash


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_links_against_all_pairs(near):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(near).collect()}
    prints = {r.doc_id: plain_fingerprint(r.text) for r in near.collect()}
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert len(links) > 50
    want = roots(ids, links)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 14
    assert {r.component_id for r in got if r.doc_id in (4, 5, 6)} == {4}
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.similar_documents(empty).count() == 0


def test_stage_drops_similar_rows(near, odd, empty):
    kept = {r.doc_id for r in simhash.drop_similar(near).collect()}
    texts = {r.doc_id: r.text.split() for r in near.collect()}
    both = defaultdict(list)
    for i in range(1, 600, 3):
        changes = sum(a != b for a, b in zip(texts[i], texts[i - 1]))
        if changes <= 1:
            both[len(texts[i])].append({i, i - 1} <= kept)
    assert not any(both[300])  # a similarity of 0.97 and more
    assert sum(both[80]) < 0.3 * len(both[80])  # of 0.88 and more
    assert all(i in kept for i in range(2, 600, 3) if len(texts[i]) >= 20)
    rows = simhash.drop_similar(odd)
    assert rows.columns == odd.columns
    ids = sorted(str(r.doc_id) for r in rows.collect())
    assert ids.count("None") == 2 and "2" not in ids and "1" in ids
    assert simhash.drop_similar(empty).count() == 0


def test_path_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, None), (200, 201)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {200: 200, 201: 200}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")


def test_a_round_shuffles_edges_twice_and_a_regrouping_once(spark):
    edges = spark.createDataFrame([(2, 1, False), (3, 2, False)], "u long, v long, moved boolean")
    assert exchanges(components._small_star(components._large_star(edges))) == 2
    met = spark.createDataFrame([(1, 5, 5, 0, 5), (1, 6, 5, 0, 6)], "token long, key long, n int, place int, component long")
    assert exchanges(simhash._mixed_meetings(met)) == 1


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", "", text or "").encode()).hexdigest()


def index(spark):
    return exact_dedup.DigestIndex(spark, f"test_index_{uuid.uuid4().hex}", buckets=3)


def test_decisions_against_brute_force(spark, near, odd, empty):
    for docs in (near, odd, empty):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        groups = defaultdict(list)
        for i, text in rows:
            groups[digest(text)].append((-len(text or ""), i is None, i or 0))
        got = exact_dedup.decide(docs, index(spark)).collect()
        assert len(got) == len(rows)
        for d, group in groups.items():
            best = min(group)
            mine = [r for r in got if r.text_sha256 == d]
            assert {r.group_size for r in mine} == {len(group)}
            assert {r.keep_id for r in mine} == {None if best[1] else best[2]}
            assert [r.doc_id for r in mine if r.kept] == [None if best[1] else best[2]]


def test_second_batch_gives_way(spark, tmp_path):
    path = str(tmp_path / "digests")
    name = f"test_index_{uuid.uuid4().hex}"
    first = spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(1, "a   b"), (2, "d"), (3, "d ")], "doc_id long, text string")
    known = exact_dedup.DigestIndex(spark, name, path, buckets=3)
    exact_dedup.decide(first, known).collect()
    # another session knows the files only
    spark.sql(f"DROP TABLE {name}")
    known = exact_dedup.DigestIndex(spark, name, path, buckets=3)
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.decide(second, known).collect()}
    assert got == {1: (5, False), 2: (3, False), 3: (3, True)}
    exact_dedup.decide(second, known).collect()
    assert known.rows().count() == 3
    plan = known.rows().select("digest").join(known.rows().hint("merge"), "digest", "left_anti")
    assert "SelectedBucketsCount" in plan._jdf.queryExecution().toString()


def test_one_row_of_each_text_stays(spark, odd, empty):
    rows = exact_dedup.drop_duplicates(odd, index(spark))
    assert rows.columns == odd.columns
    got = [r.text for r in rows.collect()]
    assert len({digest(t) for t in got}) == len(got) == len({digest(r.text) for r in odd.collect()})
    assert exact_dedup.drop_duplicates(empty, index(spark)).count() == 0


def test_repetition_on_odd_rows(odd, empty):
    got = {(r.doc_id, r.n_words): r for r in repetition.quality(odd).collect()}
    assert got[4, 0].base_failed and not got[4, 0].kept
    assert got[1, 80].n_repeat_words == 80 and got[1, 80].longest_repeat == 70
    assert got[8, 30_000].kept and not got[8, 30_000].base_failed
    assert got[11, 9].n_symbols == 12
    assert repetition.quality(empty).count() == 0
    kept = repetition.keep_good(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()] == [8]
    assert repetition.keep_good(empty).count() == 0
