"""Language identification and toxicity: definitions and held-out accuracy."""

import random
import zlib

import numpy as np

import __spark_entry__ as contract
from apilens.llm import language, toxicity
from apilens.llm.common import fold_number

SF = "/root/testdata/sf0.01"


def phrases(text, training):
    at = count = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in training:
            end += 1
        at = max(end - 1, at + 1)
        count += 1
    return count


def test_phrases_are_longest_matches():
    draw = random.Random(2)
    for _ in range(60):
        training = "".join(draw.choice("abc ") for _ in range(40))
        text = "".join(draw.choice("abcd ") for _ in range(60))
        model = language.LanguageModel.fit({"x": [training]})
        sequence = model._sequence(language.normalised(text))
        state = count = 0
        for c in sequence.tolist():
            step = int(model.steps[0][state * model.n_classes + c])
            count, state = count + (step & 3), step >> 2
        own = "".join(map(chr, model._sequence(language.normalised(training))))
        assert count + (state > 0) == phrases("".join(map(chr, sequence)), own)


def test_language_held_out(spark):
    rows = contract.queries()["op3_language_id"](spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd, empty):
    model = language.fit(odd)
    assert model.languages == ["en", "fr"]  # the only German texts have no letter
    got = {(r.doc_id, r.lang_pred) for r in language.identify(odd, model).collect()}
    assert {(4, "und"), (5, "und"), (6, "und"), (1, "en"), (None, "fr")} <= got
    assert language.identify(empty, model).count() == 0
    nothing = language.fit(empty)
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}


def test_folds():
    assert fold_number(12, 3) == zlib.crc32(b"12") % 3
    assert fold_number(None, 3) == zlib.crc32(b"") % 3


def test_toxicity_held_out(spark):
    rows = contract.queries()["op6_toxicity"](spark, "/root/testdata/sf0.1").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(rows) == 10_000 and len({r.doc_id for r in rows}) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    hits = sum(p and y for p, y in held)
    assert hits / sum(p for p, _ in held) > 0.9
    assert hits / sum(y for _, y in held) > 0.8


def test_toxicity_learns_pairs_and_stems():
    draw = random.Random(3)
    plain = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(600):
        words = [draw.choice(plain) for _ in range(30)]
        label = i % 4 == 0
        if label:
            words[5:7] = ["sour", "grapes"]
        else:
            words[5], words[9] = "sour", "grapes"
        texts.append(" ".join(words).encode())
        labels.append(int(label))
    weights = toxicity.train(texts, labels)
    scorer = toxicity.Scorer(weights)
    scores = scorer.score([b"a Sour, grapes! b", b"sour b c grapes", b""])
    assert scores[0] > 0.5 > scores[1]
    assert len(weights) < 400


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (9, 0), (4, 1), (77, 1), (None, 1), (8, None)], "doc_id long, toxic int")
    weights = toxicity.fit(labels, odd)
    got = toxicity.score(odd, weights).collect()
    assert len(got) == 14 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, weights).count() == 0
    assert {r.score for r in toxicity.score(odd, toxicity.fit(labels, empty)).collect()} == {0.5}


def test_every_letter_has_a_class_of_its_own():
    draw = random.Random(4)
    latin = [chr(c) for c in range(0x100, 0x600) if chr(c).isalpha()]
    han = {k: [chr(a + i) for i in range(600)] for k, a in (("a", 0x4E00), ("b", 0x6000))}
    words = {k: ["".join(v[i : i + 4]) for i in range(0, 600, 4)] for k, v in han.items()}
    texts = {k: ["".join(draw.choice(v) for _ in range(1000))] for k, v in words.items()}
    model = language.LanguageModel.fit(texts | {"c": ["".join(latin)]})
    tests = ["".join(draw.choice(words[k]) for _ in range(50)) for k in "abab"]
    assert model.predict(tests)[0] == list("abab")
    automaton = language.SuffixAutomaton(model._sequence(texts["a"][0]).tolist())
    dense, sparse = (language.Steps(automaton, model.n_classes, n) for n in (1 << 30, 0))
    assert dense.dense is not None and sparse.dense is None
    states = np.array([draw.randrange(dense.states) for _ in range(5000)] + [0] * 100)
    classes = np.array([draw.randrange(dense.width) for _ in range(5100)])
    assert (dense.step(states, classes) == sparse.step(states, classes)).all()


def test_language_of_long_texts_only(spark):
    rows = [(1, "de", "aber ja " * 5000), (2, "en", "yes but " * 20), (3, "en", "zzz " * 9000)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert model.languages == ["de", "en"] and model.predict(["aber"])[0] == ["de"]
