"""Training-corpus pipeline: toxic documents go, one document of each near-duplicate group stays, documents that hold
benchmark passages go, personal data is replaced, and the rest is encoded.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  All but the last return the
columns of ``documents``; rows with null or empty text pass every stage.  ``run`` writes each stage's rows to the shared
checkpoint folder and reads them again, so a lost executor repeats at most one stage.
"""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import queries
from millrace.llm.common import annotate, staged, table
from millrace.llm.decontamination import contamination
from millrace.llm.ngram_join import representatives
from millrace.llm.personal_data import find_personal_data
from millrace.llm.pieces import ChunkCoder
from millrace.llm.toxicity import score_toxicity, train_toxicity

TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC_FROM``; the lexicon is learned from labelled documents."""
    model = train_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, TOXIC_FROM).filter("predicted = 0").drop("score", "predicted")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join, the one with the smallest id."""
    return representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies inside benchmark windows."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter("not contaminated").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with [KIND] in place of personal data."""
    redacted = F.when(F.col("text").isNotNull(), F.col("redacted")).alias("text")
    found = find_personal_data(docs)
    return found.select(
        *(redacted if c == "text" else F.coalesce(F.length(redacted), F.lit(0)).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns)
    )


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and the hash of the decoded text."""
    model = public_tokenizers.path(queries.PIECE_MODEL)

    def make():
        coder = ChunkCoder(model)

        def work(texts) -> list:
            rows = []
            for ids, text in coder.code(texts.to_pylist()):
                numbers = [int(i) for i in ids.split(",")] if ids else []
                rows.append((len(numbers), numbers, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
            return list(zip(*rows, strict=True))

        return work

    return annotate(docs, make, "n_tokens long, token_ids array<int>, decoded_sha256 string").drop("text", "n_chars")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("pieces", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs


ORACLE_SQL = None  # learned weights and the tokenizer cannot be stated in SQL; tests compare with brute force

QUERIES = {**queries.QUERIES, "pipeline": run}
SQL = dict(queries.SQL)
