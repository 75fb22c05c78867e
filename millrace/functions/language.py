"""Language detection by a model learned from labelled texts: naive Bayes over byte trigrams.

Training adds up trigram counts of every labelled text in Spark, one row per language and trigram slot; the model is a matrix of
log odds, ``SLOTS`` numbers a language, and goes to the tasks with the function.  Detection reads whole texts.

Text that is null, has fewer than ``MIN_DETECTED`` characters or no letter has no language.  Equal scores go to the language that
comes first by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import MIN_DETECTED, language_tag

SLOTS = 1 << 14
MAX_LANGUAGES = 500  # 64 MB of model
_OTHER = re.compile(r"[\W\d_]+")


def trigram_counts(text: str) -> np.ndarray:
    """Counts of the trigram slots of the text's words, lower-cased and parted by one space."""
    data = np.frombuffer(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(SLOTS)
    codes = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    return np.bincount((codes * np.uint32(0x9E3779B1)) >> np.uint32(18), minlength=SLOTS).astype(np.float64)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_shares: np.ndarray  # languages x SLOTS

    def detect(self, text: str | None) -> str | None:
        if text is None or not self.languages or len(text.strip()) < MIN_DETECTED or not any(map(str.isalpha, text)):
            return None
        return self.languages[int(np.argmax(self.log_shares @ trigram_counts(text)))]

    def column(self, text: Column) -> Column:
        @F.arrow_udf("string")
        def detected(texts: pa.Array) -> pa.Array:
            return pa.array([self.detect(t) for t in texts.to_pylist()], pa.string())

        return detected(text)


def train_language_model(docs: DataFrame) -> LanguageModel:
    """Learn from all rows of ``docs`` (text, lang) that have both; every language weighs the same."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if lang not in totals:
                    totals[lang] = np.zeros(SLOTS)
                totals[lang] += trigram_counts(text)
        for lang, counts in totals.items():
            used = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used].astype(np.int64))], names=["lang", "slot", "n"])

    known = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    if known.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: is the column one of languages?")
    summed = known.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    totals: dict[str, np.ndarray] = {}
    for row in summed.toLocalIterator():  # at most SLOTS rows a language
        totals.setdefault(row.lang, np.zeros(SLOTS))[row.slot] = row.n
    names = tuple(sorted(totals))
    counts = np.array([totals[n] for n in names]).reshape(len(names), SLOTS) + 0.5
    return LanguageModel(names, np.log(counts / counts.sum(axis=1, keepdims=True)) if names else counts)


def resolve_language(declared: Column, body: Column, model: LanguageModel) -> Column:
    """What the body says wins over the declared language."""
    return F.coalesce(model.column(body), language_tag(declared))
