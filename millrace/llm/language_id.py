"""Language identification by compression: one raw-content zstandard dictionary per language.

A text is compressed with every dictionary; the smallest size names the language.  The relative gap to the second
becomes the score, and ``rejected`` tells that it is too narrow to rely on.  Dictionaries hold excerpts of about
``per_language`` training texts of each language, chosen by a hash of the id; languages and texts are all scored.

Defined cases: null text and text without a letter is ``und`` with score 0; without training rows every text is
``und``.  Ties go to the language that comes first by name.  Null ids, null languages and languages
without a training text that has a word are not learned.
Dictionaries over ``max_model_bytes`` in sum are an error, not a cut.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import annotate, label_fold, staged
from millrace.llm.compression import Compressor, piece_sizes, pieces, raw_dictionary

MAX_LANGUAGES = 10_000  # rows of two values that every task gets
LEAST_CONTENT = 8  # bytes; zstandard takes no shorter dictionary
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case words only: capitals, digits and signs say nothing about the language."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


@dataclass(frozen=True)
class LanguageSettings:
    folds: int = 4
    held_out: int = 2
    per_language: int = 300
    dictionary_bytes: int = 64 << 10
    least_margin: float = 0.01
    half_margin: float = 0.03  # the gap that scores one half
    max_model_bytes: int = 64 << 20


def train_languages(docs: DataFrame, settings: LanguageSettings = LanguageSettings()) -> dict[str, bytes]:
    """{language: dictionary content} from training rows of ``docs`` (doc_id, text, lang)."""
    rows = docs.filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
        & (label_fold(F.col("doc_id"), settings.folds) != settings.held_out)
    )
    # A share of each language's rows by hash: no task ranks a language's rows.
    share = F.least(F.lit(1.0), F.lit(float(settings.per_language)) / F.count("*"))
    cuts = staged(rows.groupBy("lang").agg((share * (1 << 30)).cast("long").alias("cut")))
    if cuts.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: is the column one of languages?")
    texts = rows.join(F.broadcast(cuts), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("cut"))
    excerpt = F.substring("text", 1, 1 << 14)  # only an excerpt of a training text enters a dictionary
    gathered = texts.select("lang", excerpt.alias("text"), F.xxhash64("doc_id").alias("o")).orderBy("lang", "o").collect()
    by_language: dict[str, list[bytes]] = {}
    for row in gathered:
        by_language.setdefault(row.lang, []).append(letters(row.text))
    model = {lang: raw_dictionary(t, settings.dictionary_bytes) for lang, t in sorted(by_language.items())}
    model = {lang: content for lang, content in model.items() if len(content) >= LEAST_CONTENT}
    if sum(map(len, model.values())) > settings.max_model_bytes:
        raise ValueError("more languages than the dictionaries' memory bound allows: raise max_model_bytes or lower dictionary_bytes")
    return model


def identify_languages(docs: DataFrame, model: dict[str, bytes], settings: LanguageSettings = LanguageSettings()) -> DataFrame:
    """``docs`` with lang_pred, score and rejected."""
    names = sorted(model)

    def make():
        compressors = [Compressor(model[name]) for name in names]

        def one(text: str):
            if not names or not any(map(str.isalpha, text)):  # letters only: no fractions, powers or circled digits
                return "und", 0.0, True
            sizes = piece_sizes(compressors, pieces(letters(text))).sum(axis=1)
            order = sizes.argsort(kind="stable")
            if len(names) == 1:
                return names[0], 1.0, False
            margin = (sizes[order[1]] - sizes[order[0]]) / sizes[order[1]]
            return names[order[0]], float(margin / (margin + settings.half_margin)), bool(margin < settings.least_margin)

        def work(texts: pa.Array) -> list:
            return list(zip(*map(one, texts.to_pylist()), strict=True))

        return work

    return annotate(docs, make, "lang_pred string, score double, rejected boolean")


def language_digest(docs: DataFrame, settings: LanguageSettings = LanguageSettings()) -> DataFrame:
    model = train_languages(docs.select("doc_id", "text", "lang"), settings)
    found = identify_languages(docs.select("doc_id", "text"), model, settings)
    held_out = label_fold(F.col("doc_id"), settings.folds) == settings.held_out
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
