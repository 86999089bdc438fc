"""Word by word encoding against encoding whole texts."""

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from apilens.llm import tokens

WHOLE = Tokenizer.from_file(tokens.vocabulary_path())
WORDS = tokens.WordEncoder(tokens.vocabulary_path(), remembered=50)


def ids(text: str) -> list[int]:
    return np.frombuffer(WORDS.encode(text.encode()), "<u4").tolist()


def want(text: str) -> list[int]:
    return WHOLE.encode(text, add_special_tokens=False).ids


def test_odd_texts():
    for text in (
        "", " ", "it's I'll 'S don''t", "<|endoftext|>x a<|startoftext|>", "AÉÇ İ ΣΣ straße",
        "é ́e x́.", "a b c\x1cd\x85e", "12ab3 a1,b", "你好 \U0001f600!", "word...---!!", "x" * 500,
        "\x00 \x0b\x0c\x1f", "ǅ ﬁ ªº ×÷", "A-b_c `d~",
    ):
        assert ids(text) == want(text), text


def test_every_letter_before_every_mark():
    """All letters that are handled apart, and the dotted capital I, alone and before each mark and combining marks."""
    letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250))]
    marks = [chr(c) for c in range(0x21, 0x7F)]
    for letter in letters:
        words = [f"{a}{letter}{b}{mark}" for mark in ("", *marks) for a, b in (("", ""), ("x", "Y"))]
        words += [letter + m for m in ("\u0301", "\u030c", "\u0307.", "\u0338!")]
        for word in words:
            assert ids(word) == want(word), word
    for text in ("VERDİ.", "ALİ, geldi", "GELDİ!", "J\u030cA. j\u030ca. A\u0301 a\u0301", "K\u0301, \u0301A"):
        assert ids(text) == want(text), text


def test_a_second_pass_computes_nothing(monkeypatch):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    encoder = tokens.WordEncoder(tokens.vocabulary_path())
    first = [encoder.encode((t or "").encode()) for t in texts]
    monkeypatch.setattr(encoder, "_compute", None)
    monkeypatch.setattr(encoder, "_letters", None)
    assert [encoder.encode((t or "").encode()) for t in texts] == first


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert ids(text) == want(text)


def test_given_texts():
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist():
        assert ids(text or "") == want(text or "")
