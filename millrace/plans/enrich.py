"""Incremental analysis and embedding of articles whose body changed.

Models are plugged in as providers: plain callables evaluated in Arrow batches on the executors.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.language import LanguageModel
from millrace.functions.language import resolve_language as resolve_by_model
from millrace.functions.text import clean_summary, clean_tags, clean_text, resolve_language, translated_title
from millrace.operators.filters import needs_analysis, needs_embedding

# The batch and vector size.
EMBEDDING_BATCH = 16
ROWS_OUT = 256  # vectors held before they are handed on
DIMENSIONS = 1024

Embedder = Callable[[list[str]], np.ndarray]
Analyzer = Callable[[str], dict]


def hashed_ngrams(texts: list[str]) -> np.ndarray:
    """Built-in embedder: unit vectors of hashed word unigrams and bigrams.

    Grams are interned once per batch, so each distinct gram is hashed once and counts are array sums.
    """
    words = [text.lower().split() for text in texts]
    grams = [[*w, *map(" ".join, zip(w, w[1:]))] for w in words]
    number = {gram: i for i, gram in enumerate(dict.fromkeys(chain.from_iterable(grams)))}
    codes = pd.util.hash_array(np.array([*number, ""], dtype=object), categorize=False)
    slot, sign = (codes % DIMENSIONS).astype(np.int64), np.where(codes >> np.uint64(63), 1.0, -1.0)
    out = np.zeros((len(texts), DIMENSIONS))
    for row, own in enumerate(grams):
        at = np.fromiter(map(number.__getitem__, own), dtype=np.int64, count=len(own))
        out[row] = np.bincount(slot[at], weights=sign[at], minlength=DIMENSIONS)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1.0, norms)


def pooled(embedder: Embedder, texts: list[str], piece: int | None) -> np.ndarray:
    """Vectors of whole texts.  A model with a limited window gets pieces; their vectors are added by length."""
    if piece is None:
        return embedder(texts)
    parts = [[t[i : i + piece] for i in range(0, len(t), piece)] or [""] for t in texts]
    vectors, sums, at = embedder(list(chain.from_iterable(parts))), np.zeros((len(texts), DIMENSIONS)), 0
    for row, own in enumerate(parts):
        sums[row] = np.array([len(p) for p in own], dtype=np.float64) @ vectors[at : at + len(own)]
        at += len(own)
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    return sums / np.where(norms == 0, 1.0, norms)


def embed_changed(articles: DataFrame, embedder: Embedder = hashed_ngrams, piece: int | None = None) -> DataFrame:
    """(article_id, embedding, embedded_body_hash) of articles without a current vector.

    Whole texts are embedded; ``piece`` is the window of the embedder in characters, if it has one.
    """
    todo = articles.filter(needs_embedding("embedding", "embedded_body_hash")).select(
        "article_id", "body_hash", F.concat_ws("\n\n", "title", "body").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A batch stays in Arrow; texts and vectors of a few rows at a time are Python's.
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_OUT):
                rows, parts = batch.slice(start, ROWS_OUT), []
                for i in range(0, rows.num_rows, EMBEDDING_BATCH):
                    parts.append(pooled(embedder, rows.column("text").slice(i, EMBEDDING_BATCH).to_pylist(), piece).astype("float32"))
                flat = np.concatenate(parts)
                offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1])
                vectors = pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column("article_id"), vectors, rows.column("body_hash")], ["article_id", "embedding", "embedded_body_hash"])

    return todo.mapInArrow(run, "article_id long, embedding array<float>, embedded_body_hash string")


ANALYSIS = (
    "article_id long, title string, body_hash string, language string, translated_title string, summary string, domain string, category string, "
    "topics array<string>, technologies array<string>, content_type string, difficulty string, "
    "technical_quality double, error string, attempts int, millis double"
)
_FIELDS = [c.split()[0] for c in ANALYSIS.split(", ")]


def rule_based(text: str) -> dict:
    """Built-in analyzer: leading sentence as summary, capitalised words as topics."""
    body = text.split("\n\n", 1)[-1]
    words = [w.strip(".,;:!?()") for w in body.split()]
    named = list(dict.fromkeys(w for w in words if w[:1].isupper() and len(w) > 3))
    code = any(mark in text for mark in ("```", "def ", "import ", "();"))
    return {
        "summary": body.split(".", 1)[0],
        "domain": named[0] if named else "general",
        "category": "implementation" if code else "general",
        "topics": named[:8],
        "technologies": [],
        "content_type": "implementation" if code else "news",
        "difficulty": "intermediate" if code else "beginner",
        "technical_quality": 0.7 if code else 0.5,
    }


def analyze_changed(
    articles: DataFrame,
    analyzer: Analyzer = rule_based,
    attempts: int = 3,
    max_title: int | None = None,
    max_body: int | None = None,
    languages: LanguageModel | None = None,
) -> DataFrame:
    """Cleaned analysis per article whose body changed; failures are rows with ``error``.

    The analyzer sees whole texts unless its window is stated by ``max_title`` and ``max_body``.  ``languages`` is a trained model;
    without one stop words tell the language.
    """
    title = F.col("title") if max_title is None else F.substring("title", 1, max_title)
    body = F.col("body") if max_body is None else F.substring("body", 1, max_body)
    # What is needed after the analysis travels with the row, the body does not come back.
    declared, whole = F.col("language"), F.col("body")
    language = resolve_language(declared, whole) if languages is None else resolve_by_model(declared, whole, languages)
    todo = articles.filter(needs_analysis("summary", "analyzed_body_hash")).select(
        "article_id", "title", "body_hash", language.alias("language"),
        F.concat(F.lit("title: "), title, F.lit("\n\n"), body).alias("text"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            carried = zip(batch["article_id"], batch["title"], batch["body_hash"], batch["language"], batch["text"])
            for article_id, title, body_hash, language, content in carried:
                start, result, error, tries = time.perf_counter(), {}, None, 0
                while tries < attempts:
                    tries += 1
                    try:
                        result, error = analyzer(content), None
                        break
                    except Exception as failure:  # noqa: BLE001 - recorded, the job goes on
                        error = type(failure).__name__
                spent = (time.perf_counter() - start) * 1000
                kept = {"article_id": article_id, "title": title, "body_hash": body_hash, "language": language}
                rows.append({**result, **kept, "error": error, "attempts": tries, "millis": spent})
            frame = pd.DataFrame(rows, columns=_FIELDS).astype(object)
            yield frame.where(frame.notna(), None)

    raw = todo.mapInPandas(run, ANALYSIS)
    return raw.select(
        "article_id",
        "language",
        translated_title(F.col("translated_title"), F.col("title"), F.col("language")).alias("translated_title"),
        clean_summary(F.col("summary")).alias("summary"),
        clean_text(F.col("domain")).alias("domain"),
        clean_text(F.col("category")).alias("category"),
        clean_tags(F.col("topics")).alias("topics"),
        clean_tags(F.col("technologies")).alias("technologies"),
        "content_type",
        "difficulty",
        "technical_quality",
        F.when(F.col("error").isNull(), F.col("body_hash")).alias("analyzed_body_hash"),
        F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("analysis_status"),
        "error",
        "attempts",
        "millis",
    )
