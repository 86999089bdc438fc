"""Suffix arrays against the definition."""

from hypothesis import given, settings
from hypothesis import strategies as st

from apilens.llm import repetition

TEXT = st.lists(st.sampled_from("a b c d\n".split(" ")), max_size=40).map(" ".join)


def longest_from(words):
    n = len(words)
    best = [0] * n
    for a in range(n):
        for b in range(a + 1, n):
            k = 0
            while b + k < n and words[a + k] == words[b + k]:
                k += 1
            best[a], best[b] = max(best[a], k), max(best[b], k)
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_measures(texts):
    found = repetition.measure([t.encode() for t in texts], counted_repeat=4)
    for i, text in enumerate(texts):
        words = text.split()
        best = longest_from(words)
        counted = {j for a, k in enumerate(best) if k >= 4 for j in range(a, a + k)}
        windows = {j for a, k in enumerate(best) if k >= 3 for j in range(a, a + 3)}
        lines = [x for x in text.split("\n") if x.strip()]
        assert found["n_words"][i] == len(words)
        assert found["longest_repeat"][i] == max(best, default=0)
        assert found["covered_words"][i] == len(counted)
        assert found["n_repeat_words"][i] == len(windows)
        assert found["n_dup_lines"][i] == sum(x in lines[:j] for j, x in enumerate(lines))


def test_limits_are_inclusive():
    limits = repetition.Limits(least_words=4, counted_repeat=2, covered_percent=50, longest_repeat=2)
    assert repetition.verdicts([b"a b c d a b e f"], limits)["kept"].tolist() == [True]
    assert repetition.verdicts([b"a b c d a b e"], limits)["kept"].tolist() == [False]
    assert repetition.verdicts([b"a b c"], limits)["base_failed"].tolist() == [True]
