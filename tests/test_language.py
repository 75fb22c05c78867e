"""The trained language model against a plain count, and its agreement with labels it has not seen."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions.language import SLOTS, resolve_language, train_language_model

TEXTS = [("the cat and the dog are in the house with the others " * 2, "en"), ("le chat et le chien sont dans la maison avec les autres " * 2, "fr"), ("der hund und die katze sind in dem haus mit den anderen " * 2, "de")]


def slots(text):
    data = (" " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " ").encode()
    codes = [(data[i] << 16) | (data[i + 1] << 8) | data[i + 2] for i in range(len(data) - 2)]
    return Counter((c * 0x9E3779B1 % 2**32) >> 18 for c in codes)


def brute(train, text):
    totals = {}
    for t, lang in train:
        totals.setdefault(lang, Counter()).update(slots(t))
    scores = {}
    for lang, counts in totals.items():
        mass = sum(counts.values()) + 0.5 * SLOTS
        scores[lang] = sum(n * math.log((counts[s] + 0.5) / mass) for s, n in slots(text).items())
    return min(scores, key=lambda lang: (-scores[lang], lang))


def test_detection_equals_a_plain_count(spark):
    model = train_language_model(spark.createDataFrame([*TEXTS, (None, "en"), ("no label at all here", None), ("", "fr")], "text string, lang string"))
    assert model.languages == ("de", "en", "fr")
    probes = ["the dogs of the house are with the cats and others", "LE CHIEN; et la maison: avec 12 autres chats dans", "die hunde und das haus mit den katzen sind anders", "x y z q w " * 9]
    asked = spark.createDataFrame([(p, "JA_jp") for p in [*probes, "too short", None, "1234567890 " * 9]], "body string, declared string")
    got = {r.body: (r.a, r.b) for r in asked.select("body", model.column(F.col("body")).alias("a"), resolve_language(F.col("declared"), F.col("body"), model).alias("b")).collect()}
    for p in probes:
        assert got[p] == (brute(TEXTS, p),) * 2
    assert all(got[p] == (None, "ja") for p in ("too short", None, "1234567890 " * 9))
    assert train_language_model(spark.createDataFrame([], "text string, lang string")).detect("the text of nobody " * 5) is None


def test_too_many_languages_are_an_error(spark):
    with pytest.raises(ValueError, match="languages"):
        train_language_model(spark.range(600).select(F.lit("text").alias("text"), F.col("id").cast("string").alias("lang")))


def test_agreement_with_unseen_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = train_language_model(docs.filter(fold != 2))
    rows = docs.filter((fold == 2) & F.col("lang").isNotNull()).select("lang", model.column(F.col("text")).alias("found")).filter("found is not null").collect()
    assert len(rows) > 150 and sum(r.lang == r.found for r in rows) > 0.95 * len(rows)


def test_analysis_takes_the_model(spark):
    from millrace.plans.enrich import analyze_changed

    model = train_language_model(spark.createDataFrame(TEXTS, "text string, lang string"))
    rows = [(1, "t", TEXTS[2][0], "h", "fr", None, None), (2, "t", "short", "h", "EN-us", None, None)]
    schema = "article_id long, title string, body string, body_hash string, language string, summary string, analyzed_body_hash string"

    def analyzer(text):
        return {"summary": "s", "translated_title": "other", "topics": []}

    found = {r.article_id: r.language for r in analyze_changed(spark.createDataFrame(rows, schema), analyzer, languages=model).collect()}
    assert found == {1: "de", 2: "en"}  # the body says German, whatever was declared
