"""Automata and collocations against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from apilens.llm import collocations
from apilens.llm.automata import Transducer, union

PHRASES = st.dictionaries(
    st.lists(st.sampled_from([b"a", b"b", b"ab", "é".encode(), b"c"]), min_size=1, max_size=4).map(b" ".join),
    st.integers(1, 1 << 40),
    max_size=30,
)


def content(automaton):
    out = {}
    for _, ids, weights in automaton.paths():
        for row, weight in zip(ids.tolist(), weights.tolist()):
            out[b" ".join(automaton.words[i] for i in row)] = weight
    return out


def of(counts):
    return Transducer.of_phrases(list(counts), list(counts.values()))


@settings(max_examples=150, deadline=None)
@given(st.lists(PHRASES, max_size=4), PHRASES)
def test_automata(parts, asked):
    whole = union([of(p) for p in parts])
    want = Counter()
    for p in parts:
        want.update(p)
    assert content(whole) == want
    assert content(Transducer.unpack(whole.pack())) == want
    assert whole.words == sorted(whole.words)
    for _, ids, _ in whole.paths():
        rows = ids.tolist()
        assert rows == sorted(rows)
    assert whole.weights_of(list(asked)).tolist() == [want.get(p, 0) for p in asked]
    if len(whole.levels) > 1:
        firsts = np.arange(len(whole.levels[1][0])) % 2 == 0
        one, other = content(whole.select(firsts)), content(whole.select(~firsts))
        longer = {p: n for p, n in want.items() if b" " in p}
        assert {p: n for p, n in (one | other).items() if b" " in p} == longer
        assert len([p for p in one if b" " in p]) + len([p for p in other if b" " in p]) == len(longer)


def plain(rows, least, covered=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split(r"[ \t]", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if " " in p and a >= least}
        inner = Counter()
        for p, a in found.items():
            w = p.split(" ")
            for i in range(len(w)):
                for j in range(i + 2, len(w) + 1):
                    if j - i < len(w):
                        q = " ".join(w[i:j])
                        inner[q] = max(inner[q], a)
        ranked = []
        for p, a in found.items():
            if 100 * inner[p] >= covered * a:
                continue
            w = p.split(" ")
            score, _, left, right = min(
                (2000000 * a // (x + y), k, x, y)
                for k in range(1, len(w))
                for x, y in [(counts[" ".join(w[:k])], counts[" ".join(w[k:])])]
            )
            ranked.append((-score, -a, p.encode(), left, right))
        ranked.sort()
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(ranked[:top])]
    return sorted(out)


def random_rows(seed, many=120):
    draw = random.Random(seed)
    words = ["sea", "Wind", "über", "a", "of", "the", "x1", "-", "日本", "Old"]
    joins = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!", " ?", "\x0b", "\xa0"]
    rows = []
    for _ in range(many):
        text = "".join(draw.choice(words[: draw.randint(2, 10)]) + draw.choice(joins) for _ in range(draw.choice((0, 3, 60))))
        rows.append((draw.choice(("en", "de", None, "und")), draw.choice((text, text, text, None)) if draw.random() < 0.3 else text))
    return rows


@pytest.mark.parametrize(("seed", "block", "arcs"), [(1, 4_000_000, 3_000_000), (2, 1, 3_000_000), (3, 50, 100)])
def test_collocations(spark, monkeypatch, seed, block, arcs):
    """Also when texts fall into many blocks and tasks hand on their counts often."""
    monkeypatch.setattr(collocations, "_BLOCK", block)
    monkeypatch.setattr(collocations, "_MOST_ARCS", arcs)
    rows = random_rows(seed)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for least, top in ((4, 2000), (2, 7)):
        got = collocations.collocations(docs, least=least, per_language=top).collect()
        assert sorted(map(tuple, got)) == plain(rows, least, top=top)


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_bitmap", lambda frequent: np.full(1 << 23, 255, np.uint8))
    rows = random_rows(5)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs, least=3).collect())) == plain(rows, 3)


def test_odd_and_empty(odd, empty):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert sorted(map(tuple, collocations.collocations(odd, least=3).collect())) == plain(rows, 3)
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(odd, least=10**9).count() == 0


def test_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame(
        [("en", 1, "a", 6 * 10**18), ("en", 1, "b", 5 * 10**18), ("en", 2, "a b", 5 * 10**18)], "lang string, words int, phrase string, f long"
    )
    candidates = counts.filter("words > 1").withColumnRenamed("f", "a")
    (row,) = collocations._scored(counts, candidates).collect()
    assert (row.l, row.r, row.score) == (6 * 10**18, 5 * 10**18, 2000000 * 5 * 10**18 // (11 * 10**18))
    assert collocations._covered(candidates, 80).count() == 0


def test_a_task_holds_bounded_counts_of_all_languages(monkeypatch):
    """The limit is one of all languages together, and what is handed on leaves in small batches."""
    monkeypatch.setattr(collocations, "_MOST_ARCS", 3000)
    monkeypatch.setattr(collocations, "_HANDED_BYTES", 4000)
    monkeypatch.setattr(collocations, "_BLOCK", 10_000)
    united = []
    monkeypatch.setattr(collocations, "union", lambda parts: united.append(sum(p.arcs for p in parts)) or union(parts))
    draw = random.Random(7)
    langs = [f"l{i % 8}" for i in range(400)]
    texts = [" ".join(f"w{draw.randrange(400)}" for _ in range(60)) for _ in langs]
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts)], names=["lang", "text"])
    got: dict[str, Counter] = defaultdict(Counter)
    for handed in collocations._counter((2,), 16, None)(iter([batch])):
        assert handed.nbytes < 30_000
        for lang, message in zip(handed.column("lang").to_pylist(), handed.column("automaton").to_pylist()):
            got[lang].update({p: w for p, w in content(Transducer.unpack(message)).items() if w})
    want = defaultdict(Counter)
    for lang, text in zip(langs, texts):
        words = text.encode().split()
        want[lang].update(b" ".join(pair) for pair in zip(words, words[1:]))
    assert got == want
    assert max(united) < 3000
