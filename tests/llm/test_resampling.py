"""Words, windows, histograms, gains and the draw against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from apilens.llm import resampling
from apilens.llm.resampling import FeatureHasher

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_features(text, longest):
    words = WORDS.findall(lowered(text))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aZ9 _-'\x00\x7f\x80İß\n"))), st.integers(1, 3), st.integers(1, 8))
def test_features_of_any_text(text, longest, block):
    """Also when a text is split in several blocks."""
    before, resampling._BLOCK = resampling._BLOCK, block
    try:
        got, words = FeatureHasher(longest, 97).features(text.encode())
    finally:
        resampling._BLOCK = before
    want, n = plain_features(text, longest)
    assert words == n
    assert Counter(got.tolist()) == Counter(zlib.crc32(f.encode()) % 97 for f in want)


def plain(docs, target, longest=1, buckets=10_000, least=20, percent=10):
    s, t = Counter(), Counter()
    features = []
    for doc_id, text in docs:
        found, n = plain_features(text or "", longest)
        found = [zlib.crc32(f.encode()) % buckets for f in found]
        features.append((doc_id, found, n))
        s.update(found)
    for text in target:
        t.update(zlib.crc32(f.encode()) % buckets for f in plain_features(text or "", longest)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, found, n in features:
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {}
    for i, r in enumerate(able[: percent * len(able) // 100]):
        ranks.setdefault(r, []).append(i + 1)
    out = []
    for r in rows:
        out.append((*r[:4], ranks[r].pop() if ranks.get(r) else None))
    return out


def order(row):
    return tuple((v is None, v or 0) for v in row)


@pytest.mark.parametrize("how", [{}, {"longest": 3, "buckets": 50}, {"buckets": 70_000}])
def test_rows(near, spark, how):
    target = ["bael bio other", None, "dun gar GAR", ""]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(near, benchmark, percent=30, **how).collect()
    docs = [(r.doc_id, r.text) for r in near.collect()]
    want = plain(docs, target, how.get("longest", 1), how.get("buckets", 10_000), percent=30)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert sorted(map(tuple, resampling.resample(near.repartition(3), benchmark, percent=30, **how).collect()), key=order) == sorted(want, key=order)


def test_odd_and_empty(odd, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = sorted(map(tuple, resampling.resample(odd, none, least_words=1, percent=50).collect()), key=order)
    want = plain([(r.doc_id, r.text) for r in odd.collect()], [], least=1, percent=50)
    # equal rows may change places among themselves
    assert got == sorted(want, key=order)
    assert resampling.resample(empty, none).count() == 0
    assert resampling.resample(odd, none, percent=0).filter("rank IS NOT NULL").count() == 0


def test_draw_follows_the_target(spark):
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choice(("law", "court", "judge") if i % 4 == 0 else ("sea", "wind", "boat")) for _ in range(40))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(1, "the judge of the court of law " * 30)], "item_id long, text string")
    drawn = resampling.drawn_documents(docs, target)
    assert drawn.columns == docs.columns
    ids = [r.doc_id for r in drawn.collect()]
    assert len(ids) == 40 and all(i % 4 == 0 for i in ids)


def test_gains_are_rounded_down():
    assert resampling.gains(np.array([9, 0]), np.array([0, 0])).tolist() == [
        math.floor(1000 * math.log(1 * 11 / (10 * 2))), math.floor(1000 * math.log(1 * 11 / (1 * 2)))]
