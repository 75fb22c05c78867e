"""Held-out accuracy on the given tables, and awkward rows."""

import pytest
from pyspark.sql import functions as F

from millrace.llm.language_id import LanguageSettings, identify_languages, language_digest, train_languages
from millrace.llm.quality_classifier import quality_digest, score_quality, train_quality
from millrace.llm.toxicity import ToxicityModel, choose_terms, fold, score_toxicity, toxicity_digest, train_toxicity
from tests.llm.cases import AWKWARD, frame

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def held_out(found, labels, label):
    rows = found.filter("held_out").join(labels, "doc_id").select("score", "predicted", label).collect()
    good, bad = [r.score for r in rows if r[label]], [r.score for r in rows if not r[label]]
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert all(0 <= r.score <= 1 for r in rows)
    return auc, sum(r.predicted == r[label] for r in rows) / len(rows)


def test_quality_held_out(spark, tables):
    auc, accuracy = held_out(quality_digest(*tables), tables[1], "quality")
    assert auc > 0.95 and accuracy > 0.93


def test_toxicity_held_out(spark, tables):
    auc, accuracy = held_out(toxicity_digest(*tables), tables[1], "toxic")
    # Foreign insults are too rare here to be learned, and labels of overwritten texts cannot be met.
    assert auc > 0.75 and accuracy > 0.93


def test_language_held_out(spark, tables):
    rows = language_digest(tables[0]).filter("held_out").join(tables[0].select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.9 * len(rows)


def test_without_labels_and_awkward_rows(spark, tables):
    docs, labels = frame(spark, AWKWARD).withColumns({"score": F.lit("old"), "rejected": F.lit(1)}), tables[1].limit(0)
    empty = docs.limit(0)
    quality, toxic = train_quality(docs, labels), train_toxicity(docs, labels)
    assert {r.score for r in score_quality(docs, quality).collect()} == {0.5}
    assert {r.predicted for r in score_toxicity(docs, toxic).collect()} == {0}
    assert score_toxicity(empty, toxic).count() == 0 and quality_digest(empty, tables[1]).count() == 0
    found = {r.doc_id: r for r in identify_languages(docs, train_languages(docs)).collect()}
    assert {found[i].lang_pred for i in (1, 2, 4, 8)} == {"und"} and found[5].lang_pred in ("en", "xx")
    nothing = identify_languages(docs, train_languages(empty))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    trained = train_quality(*tables)
    assert all(0 <= r.score <= 1 for r in score_quality(docs, trained).collect())


def test_narrow_margin_is_rejected(spark):
    rows = [(i, ("uno dos tres cuatro " if i % 2 else "one two three four ") * 3, "es" if i % 2 else "en", "s", 1) for i in range(40)]
    model = train_languages(frame(spark, rows), LanguageSettings(folds=1, held_out=5))
    found = {r.doc_id: r for r in identify_languages(frame(spark, [*rows[:2], (99, "qq", "x", "s", 1)]), model).collect()}
    assert (found[0].lang_pred, found[1].lang_pred) == ("en", "es") and not found[0].rejected and found[99].rejected
    with pytest.raises(ValueError, match="memory"):
        train_languages(frame(spark, rows), LanguageSettings(folds=1, held_out=5, max_model_bytes=10))


def test_folding_and_exceptions():
    model = ToxicityModel({f" {fold('idiot').strip()} ": 5.0, f" {fold('clown').strip()} ": 5.0})
    for text in ("IDIOT!!", "1d10t", "іdіоt", "ｉｄｉｏｔ", "id­iot", "(idiot)"):
        assert model.findings(text)[0], text
    for text in ("idiots", "videoidiot", "a clown fish swims", ""):
        assert not model.findings(text)[0], text
    assert len(model.findings("clown fish and clown")[0]) == 1
    assert model.score("idiot " * 3) > model.score("idiot " + "word " * 400) > model.score("word")


def test_stems_stand_for_many_words():
    rows = [(f" abcd{x} ", 10, 0) for x in "efghij"] + [(" abcd", 40, 0), (" wxyzz ", 30, 0), (" wxyz", 30, 0)]
    assert set(choose_terms(rows, 100, 900, 0.8)) == {" abcd", " wxyzz "}


def test_openings_of_twelve_letters_are_counted():
    import pyarrow as pa

    from millrace.llm.toxicity import _term_counts

    texts = ["abcdefghjkmno" + c for c in "pqrst"]
    batch = pa.record_batch([pa.array(texts), pa.array([1] * 5)], names=["text", "label"])
    counts = {r["term"]: r["toxic"] for part in _term_counts([batch]) for r in part.to_pylist()}
    assert counts[" " + fold("abcdefghjkmno").strip()[:12]] == 5


def test_signs_without_letters_are_no_language(spark):
    model = {"en": b"the words of a language " * 4, "fr": b"les mots de la langue " * 4}
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(["½ ² ①", "123 ٣ Ⅷ", "_ _", "²³", "ª", "漢", "ⓐ"])]
    found = {r.text: r.lang_pred for r in identify_languages(frame(spark, rows), model).collect()}
    assert {t for t, p in found.items() if p != "und"} == {"ª", "漢"}


def test_many_exceptions_take_linear_time():
    import random
    import time

    model = ToxicityModel({f" {fold('trash').strip()} ": 5.0, f" {fold('loser').strip()} ": 4.0})
    start = time.perf_counter()
    assert model.findings("trash can " * 100_000) == ([], 200_000)
    assert time.perf_counter() - start < 20
    rng = random.Random(1)
    for _ in range(200):  # against every hit compared with every phrase
        text = " ".join(rng.choice(["trash", "can", "sore", "loser", "bag", "x"]) for _ in range(30))
        words, phrases = text.split(), [p.split() for p in ("trash can", "trash bag", "sore loser")]
        covered = {i + k for p in phrases for i in range(30) if words[i : i + len(p)] == p for k in range(len(p))}
        assert len(model.findings(text)[0]) == sum(w in ("trash", "loser") and i not in covered for i, w in enumerate(words))
