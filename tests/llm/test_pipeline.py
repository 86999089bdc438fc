"""The stages of the corpus pipeline, each held against its own input."""

from collections import Counter, defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline
from apilens.llm import repetition, tokens
from test_mixing import plain_targets
from test_pairs import digest
from test_tokens_out import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, found[-1], SF).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


def test_columns(stages):
    assert [s.columns for s in stages[:5]] == [stages[0].columns] * 5


def test_quality(stages):
    rows = stages[0].collect()
    kept = repetition.verdicts([(r.text or "").encode() for r in rows], repetition.Limits())["kept"]
    assert sorted(stages[1].collect()) == sorted(r for r, k in zip(rows, kept) if k)


def test_exact(stages):
    groups = defaultdict(list)
    for r in stages[1].collect():
        groups[digest(r.text)].append(r)
    want = [min(g, key=lambda r: (-len(r.text), r.doc_id)) for g in groups.values()]
    assert sorted(stages[2].collect()) == sorted(want)


def test_near(stages):
    before = {r.doc_id: set(zip(*(r.text.lower().split()[i:] for i in range(5)))) for r in stages[2].collect()}
    after = {r.doc_id for r in stages[3].collect()}
    for gone in set(before) - after:
        # at least one that stays is alike
        assert any(len(before[gone] & before[k]) > 0.4 * len(before[gone] | before[k]) for k in after)
    ids = sorted(after)
    alike = [
        (a, b) for a in ids for b in ids if a < b and len(before[a] & before[b]) >= 0.95 * len(before[a] | before[b])
    ]
    assert not alike


def test_mixing(stages):
    sizes, taken, texts = defaultdict(int), defaultdict(int), {}
    for r in stages[3].collect():
        sizes[r.source] += len(r.text.split())
        texts[r.doc_id] = r.text
    copies = Counter()
    for r in stages[4].collect():
        taken[r.source] += len(r.text.split())
        copies[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= 64
    assert all(n <= 2 * len(texts[i].split()) for i, n in copies.items())


def test_packing(stages):
    check_packing(stages[4], 2048)


def test_run(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(corpus_pipeline.run(spark, SF).select(columns).collect()) == sorted(stages[5].select(columns).collect())


def test_odd_and_empty_tables(spark, odd, empty, tmp_path):
    for name, docs in (("odd", odd), ("empty", empty)):
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{name}-{number}"))
            out = spark.read.parquet(str(tmp_path / f"{name}-{number}"))
            if number < 4:
                assert out.columns == docs.columns
            if name == "empty":
                assert out.count() == 0
            docs = out if number < 4 else docs


def test_workers_keep_no_words(spark):
    """Nothing of what packing remembers stays in the workers for the stages of a next run."""

    def words(batches):
        for _ in batches:
            known = [e for (_, n), e in tokens._ENCODERS.items() if n == corpus_pipeline.REMEMBERED_WORDS]
            yield pa.RecordBatch.from_pydict({"encoders": [len(known)], "n": [sum(len(e._new) + len(e._old) for e in known)]})

    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(16)
    for _ in range(3):
        corpus_pipeline.packed_sequences(spark, docs, SF).count()
        found = spark.range(0, 64, 1, 64).mapInArrow(words, "encoders long, n long").collect()
        if any(r.encoders for r in found):
            break
    assert any(r.encoders for r in found)
    assert not any(r.n for r in found)


def test_texts_in_bounded_batches(spark, tmp_path):
    """A stage hands a large partition of long texts to Python a few megabytes at a time, and every row of it."""
    spark.range(4000).selectExpr(
        "id AS doc_id", "concat_ws(' ', transform(sequence(1, 600), x -> hex(xxhash64(id, x)))) AS text", "'en' AS lang",
        "'a' AS source", "10 AS n_chars",
    ).coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    assert corpus_pipeline.quality_rules(spark, docs, SF).count() == 4000
    found = docs.coalesce(1).mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == 4000
    assert max(r.size for r in found) < 8_000_000 < sum(r.size for r in found)
