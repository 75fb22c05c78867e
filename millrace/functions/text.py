"""Text functions: titles, hashes, languages, cleaning of analysis output, dates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LABEL = 80
MAX_TAGS = 8
MAX_SUMMARY = 400
CONTROL_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
INVALID_LANGUAGES = ("x", "und", "zxx", "mul", "qaa")


def title_form(limit: int | None = None):
    """NFKC, case folded, letters and digits only (Spark has neither NFKC nor case folding); ``limit`` characters if given."""

    @F.pandas_udf(T.StringType())
    def apply(titles: pd.Series) -> pd.Series:
        def clean(title):
            if title is None:
                return None
            folded = unicodedata.normalize("NFKC", title[:limit]).casefold()
            return "".join(filter(str.isalnum, folded))

        return titles.map(clean)

    return apply


normalize_title = title_form()


def body_hash(body: Column) -> Column:
    """SHA-256 after collapsing (Unicode) white space."""
    return F.sha2(F.trim(F.regexp_replace(body, r"(?U)\s+", " ")), 256)


def language_tag(tag: Column) -> Column:
    """Primary language of a tag such as ja-JP or EN_US; meaningless codes give null."""
    primary = F.split_part(F.replace(F.lower(F.trim(tag)), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))
    valid = primary.rlike(r"^\p{L}{2,3}$") & ~primary.isin(*INVALID_LANGUAGES)
    return F.when(valid, primary)


# Frequent short words per language; a text speaks the language most of its words belong to.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are with as this be at by not or have from they",
    "fr": "le la les des est et que qui dans un une pour pas sur au du il avec ce sont plus par",
    "de": "der die das und ist nicht ein eine zu den mit von sich auf für im dem des auch es sie wir",
    "es": "el los las que en un una por con para del se su al como más pero es lo no sus este",
}
MIN_DETECTED = 40


def detect_language(text: Column) -> Column:
    """Language by Japanese script share, else by stop words over the whole text; null if too short.

    The contract's trained model is not available; agreement is measured, parity is not claimed.
    """
    words = F.split(F.lower(text), r"[^\p{L}]+")
    kana = F.length(text) - F.length(F.regexp_replace(text, r"[぀-ヿ]", ""))

    def hits(stop: str) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*stop.split())))

    scores = [
        F.struct(
            hits(stop).alias("hits"),
            F.lit(-i).alias("place"),
            F.lit(code).alias("code"),
        )
        for i, (code, stop) in enumerate(STOP_WORDS.items())
    ]
    best = F.array_max(F.array(*scores))
    by_words = F.when(best["hits"] > 0, best["code"])
    found = F.when(kana * 20 >= F.length(text), "ja").otherwise(by_words)
    return F.when(F.length(F.trim(text)) >= MIN_DETECTED, found)


def resolve_language(declared: Column, body: Column) -> Column:
    """What the body says wins over the declared language."""
    return F.coalesce(detect_language(body), language_tag(declared))


def clean_text(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, CONTROL_CHARACTERS, ""))


def clean_tags(tags: Column) -> Column:
    """Cleaned, cut, non-empty, distinct in first-seen order, at most eight."""
    cut = F.transform(tags, lambda t: F.substring(clean_text(t), 1, MAX_LABEL))
    return F.slice(F.array_distinct(F.filter(cut, lambda t: F.length(t) > 0)), 1, MAX_TAGS)


def clean_summary(value: Column) -> Column:
    return F.substring(clean_text(value), 1, MAX_SUMMARY)


def translated_title(candidate: Column, title: Column, language: Column) -> Column:
    """Null for Japanese articles, empty text, or a translation equal to the title."""
    cleaned = F.nullif(clean_text(candidate), F.lit(""))
    return F.when((language == "ja") | (cleaned == title), None).otherwise(cleaned)


def published_at(value: Column) -> Column:
    """ISO date or time; without zone it is UTC; otherwise the leading date; else null."""
    text = F.trim(value)
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")))
