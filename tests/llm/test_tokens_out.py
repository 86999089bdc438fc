"""Packing and token files against encoding whole texts."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from apilens.llm import packing, token_files, tokens

PATH = tokens.vocabulary_path()
WHOLE = Tokenizer.from_file(PATH)


def ids(text, end):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, end]


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def check_packing(docs, max_tokens):
    rows = packing.pack_documents(docs, PATH, max_tokens).collect()
    want = defaultdict(int)
    for r in docs.collect():
        all_ids = ids(r.text, 0)
        for piece, start in enumerate(range(0, len(all_ids), max_tokens)):
            part = all_ids[start : start + max_tokens]
            want[r.doc_id, piece, start, len(part), crc(part)] += 1
    got = defaultdict(int)
    sequences = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= max_tokens
    total = sum(r.length for r in rows)
    assert len(sequences) <= total / max_tokens * 1.05 + 2


def test_packing(near, odd, empty):
    check_packing(near, 256)
    check_packing(odd, 2048)
    assert packing.pack_documents(empty, PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(1, 6), st.integers(2500, 4000))
def test_every_capacity_holds(lengths, max_documents, max_attention):
    lengths = np.array(lengths, dtype=np.int64)
    bins, offsets = packing.best_fit(lengths, 50, max_documents, max_attention)
    for b in set(bins.tolist()):
        inside = np.nonzero(bins == b)[0]
        assert lengths[inside].sum() <= 50 and len(inside) <= max_documents
        assert (lengths[inside] ** 2).sum() <= max_attention
        order = inside[np.argsort(offsets[inside])]
        assert offsets[order].tolist() == (np.cumsum(lengths[order]) - lengths[order]).tolist()


def test_capacities_are_checked():
    with pytest.raises(ValueError):
        packing.best_fit(np.array([51]), 50, 5, 2500)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.data())
def test_bits_round_trip(bits, data):
    values = data.draw(st.lists(st.integers(0, (1 << bits) - 1), max_size=130))
    padded = np.array(values + [0] * (-len(values) % 64), dtype=np.uint32)
    packed = token_files.pack_bits(padded, bits)
    assert len(packed) * 8 == len(padded) * bits
    assert token_files.unpack_bits(packed, bits).tolist() == padded.tolist()


def test_random_access(tmp_path):
    path = str(tmp_path / "x.tokens")
    values = np.arange(10_000, dtype=np.uint32) % 49_408
    writer = token_files.TokenFileWriter(path, 16, block_ids=128)
    for a in range(0, len(values), 777):
        writer.add(values[a : a + 777])
    writer.close()
    reader = token_files.TokenFileReader(path)
    assert reader.n_ids == 10_000
    for start, n in ((0, 0), (0, 1), (127, 2), (9_999, 1), (5, 9_000), (300, 10), (10_000, 0)):
        assert reader.read(start, n).tolist() == values[start : start + n].tolist()
    with pytest.raises(IndexError):
        reader.read(9_999, 2)


def test_files(spark, near, odd, empty, tmp_path):
    for name, docs in (("near", near), ("odd", odd), ("empty", empty)):
        path = str(tmp_path / name)
        token_files.write_token_files(docs, path, PATH, 49_408, 2, documents_per_shard=100 if name == "near" else 4)
        got = token_files.read_token_files(spark, path).orderBy("start").collect()
        rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
        at = 0
        assert len(got) == len(rows)
        for g, r in zip(got, rows):
            want = ids(r.text, 2)
            assert (g.doc_id, g.start, g.n_tokens) == (r.doc_id, at, len(want))
            assert np.frombuffer(g.ids, "<u4").tolist() == want
            at += len(want)
