"""Groups of similar documents against a comparison of all pairs."""

import random

import numpy as np

from apilens.llm import simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_force(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    group = {i: i for i in texts}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and group[a] != group[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return group


def test_groups_are_those_of_all_pairs(spark):
    """Pairs from 0.7 to 0.9, among strangers that share most of a passage with them."""
    draw = random.Random(11)

    def words(n):
        return [f"w{draw.randrange(10**6)}" for _ in range(n)]

    passage, texts = words(75), {}
    for i in range(120):
        texts[i] = " ".join(passage + words(draw.choice((12, 25))))
    for i in range(120, 200):
        old = texts[draw.randrange(120)].split() if i % 2 else words(draw.choice((20, 60, 300)))
        texts.setdefault(i, " ".join(old))
        other = list(old)
        other[-1 - draw.randrange(len(old) // 6) :] = words(draw.randrange(len(old) // 5))
        texts[i + 1000] = " ".join(other)
    # a chain: each link is similar, its ends are not
    chain = words(100)
    for i in range(2000, 2008):
        texts[i] = " ".join(chain)
        chain = chain[6:] + words(6)
    want = brute_force(texts)
    assert len({g for i, g in want.items() if i >= 2000}) == 1 and len(set(want.values())) > 100
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == want


def test_links_do_not_grow_with_the_pairs(spark):
    """Near copies of one text, some of which are too far from the first one: as many links as texts at most."""
    draw = random.Random(3)
    old = [f"w{i}" for i in range(200)]
    for many in (100, 200, 400):
        texts = []
        for _ in range(many):
            words = list(old)
            for _ in range(draw.randrange(7)):
                words[draw.randrange(200)] = f"x{draw.randrange(10**6)}"
            texts.append(" ".join(words))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        keyed = simhash.stored(simhash._keyed(docs, "doc_id", "text", 5), "keyed")
        assert simhash.similar_links(keyed, 5, 80).count() <= many
        if many == 100:
            want = brute_force(dict(enumerate(texts)))
            assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == want


def test_sketches_never_exceed_the_difference():
    draw = np.random.default_rng(2)
    for n in (0, 1, 3, 80, 5000):
        one = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))
        for changed in (0, 1, n // 5, n):
            other = np.unique(np.concatenate((one[changed:], draw.integers(0, 2**64, changed // 2, dtype=np.uint64))))
            apart = sum(int(x).bit_count() for x in (simhash.sketch(one) ^ simhash.sketch(other)).view(np.uint64))
            assert apart <= len(np.setxor1d(one, other))
            assert apart == 0 or changed


def test_strangers_around_a_shared_passage_are_not_listed(spark):
    """Near copies, a third of which are beyond the similarity to all others: pairs looked at stay near the number of texts."""
    draw = random.Random(4)
    old = [f"w{i}" for i in range(200)]
    pairs = []
    for many in (100, 400):
        texts = []
        for i in range(many):
            words = list(old)
            for _ in range(20 if i % 3 == 0 else 2):
                words[draw.randrange(200)] = f"x{draw.randrange(10**6)}"
            texts.append(" ".join(words))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        keyed = simhash.stored(simhash._keyed(docs, "doc_id", "text", 5), "keyed")
        listed = []
        stored = simhash.stored

        def counting(df, name):
            out = stored(df, name)
            if name in ("untested", "stars"):
                listed.append(out.count())
            return out

        simhash.stored = counting
        try:
            simhash.similar_links(keyed, 5, 80)
        finally:
            simhash.stored = stored
        pairs.append(sum(listed))
        if many == 100:
            want = brute_force(dict(enumerate(texts)))
            assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == want
    assert pairs[1] <= 8 * pairs[0] and pairs[1] <= 3 * 400


def test_stage_joins_groups_of_both_kinds_and_stores_few_texts(spark, monkeypatch):
    """1 and 2 are near by SimHash alone, 2 and 3 by their shingles alone: one group, of which the first stays."""
    passage, one, other = ([f"{c}{i}" for i in range(n)] for c, n in (("p", 41), ("x", 20), ("y", 20)))
    texts = {1: 20 * passage + one, 2: 20 * passage + other, 3: passage + other, 4: [f"z{i}" for i in range(60)]}
    texts = {i: " ".join(words) for i, words in texts.items()}
    prints = {i: simhash.fingerprint(simhash.shingle_hashes(t.encode(), 3))[0] for i, t in texts.items()}
    assert (prints[1] ^ prints[2]).bit_count() <= 3 < (prints[2] ^ prints[3]).bit_count()
    assert brute_force(texts) == {1: 1, 2: 2, 3: 2, 4: 4}
    tables, stored = [], simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name: tables.append(stored(df, name)) or tables[-1])
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_similar(docs).collect()) == [1, 4]
    # but for the sample that finds common shingles
    assert [t.filter("text IS NOT NULL").count() <= 1 for t in tables if "text" in t.columns] == [True]
