"""Importance resampling of documents towards a target text, over hashed word runs.

Features of a text are its runs of 1 to ``max_n`` consecutive words joined by one space; a feature's bucket is the CRC-32
of its bytes modulo ``buckets``.  A bucket's gain compares its share in the target with its share in all documents; a
document's weight is the sum of gains over its features, and its score adds Gumbel noise that depends on the id alone, so
that the highest scores are a weighted draw without replacement.

Head-tail vocabulary: the most frequent words are broadcast with their exact CRC states and, for ``max_n`` above 1, the most
frequent pairs with their buckets.  A feature of the head is a table look-up for a whole slice of texts at once; a feature
outside it continues the CRC over its bytes.  Both give the same number, so what is in the head decides only the speed, and
bucket totals are exact sums over all texts: one row per bucket and task is shuffled.

The draw sorts narrow rows by score in range partitions; no task, group or driver sees all of them.

Defined cases: null text has no words and no features, so weight 0; a null id counts as the empty text in the noise; repeated
rows are rows of their own, equal in score, and take neighbouring ranks; an empty target gives every bucket t = 0; an empty
table of documents gives no row.  Columns of ``docs`` that have the name of a result are replaced.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import annotate, fresh, numbered, staged, text_slices
from millrace.llm.words import ALNUM, Packed

HEAD_BYTES = 64  # longer words and pairs stay in the tail: bounds what is broadcast
_PAIR = b" "


@dataclass(frozen=True)
class ResampleSettings:
    max_n: int = 1
    buckets: int = 10_000
    seed: str = "2024"
    min_words: int = 20  # documents with fewer words are scored but never drawn
    percent: int = 10
    head_words: int = 50_000
    head_pairs: int = 100_000


@dataclass(frozen=True)
class Head:
    """Frequent words in byte order and frequent pairs, both as bytes."""

    words: tuple[bytes, ...] = ()
    pairs: tuple[bytes, ...] = ()


def packed_words(packed: Packed) -> pa.DictionaryArray:
    """The words of a slice as ids into its distinct words."""
    sizes = packed.ends - packed.starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    data = packed.buffer[packed.buffer != 0x20]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return words.dictionary_encode()


class FeatureCoder:
    """CRC states of the word runs of many texts at once."""

    def __init__(self, head: Head, settings: ResampleSettings) -> None:
        self.settings = settings
        self.words = pa.array(head.words, pa.large_binary())
        self.states = np.array([zlib.crc32(w) for w in head.words], dtype=np.uint32)
        place = {w: i for i, w in enumerate(head.words)}
        known = []
        for pair in head.pairs:
            a, _, b = pair.partition(_PAIR)
            if a in place and b in place:
                known.append((place[a] * len(place) + place[b], zlib.crc32(pair)))
        known.sort()
        self.pair_codes = np.array([c for c, _ in known], dtype=np.int64)
        self.pair_states = np.array([s for _, s in known], dtype=np.uint32)

    def runs(self, packed: Packed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each run length the states of all runs and the position of each run's first word."""
        coded = packed_words(packed)
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = coded.dictionary
        place = pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        word_state = np.empty(len(distinct), dtype=np.uint32)
        frequent = place >= 0
        word_state[frequent] = self.states[place[frequent]]
        rare = np.flatnonzero(~frequent)
        word_state[rare] = [zlib.crc32(w) for w in distinct.take(pa.array(rare)).to_pylist()]
        state, at = word_state[ids], np.arange(len(ids))
        yield state, at
        last = np.repeat(packed.first[1:], packed.counts())  # end of the word's text
        spelled: list[bytes] = distinct.to_pylist() if self.settings.max_n > 1 else []
        for size in range(2, self.settings.max_n + 1):
            inside = at + size <= last[at]
            state, at = state[inside], at[inside]
            follower = ids[at + size - 1]
            extended = np.zeros(len(at), dtype=np.uint32)
            todo = np.ones(len(at), dtype=bool)
            if size == 2 and len(self.pair_codes):
                a, b = place[ids[at]], place[follower]
                code = np.where((a >= 0) & (b >= 0), a * len(self.states) + b, -1)
                slot = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
                hit = self.pair_codes[slot] == code
                extended[hit] = self.pair_states[slot[hit]]
                todo = ~hit
            keys, back = np.unique((state[todo].astype(np.uint64) << np.uint64(32)) | follower[todo].astype(np.uint64), return_inverse=True)
            direct = [zlib.crc32(_PAIR + spelled[k & 0xFFFFFFFF], k >> 32) for k in keys.tolist()]
            extended[todo] = np.array(direct, dtype=np.uint32)[back] if len(keys) else 0
            state = extended
            yield state, at


def _frequent(counts: Counter, bound: int) -> list[tuple[bytes, int]]:
    return heapq.nlargest(bound, counts.items(), key=lambda kv: (kv[1], kv[0]))


def learn_head(docs: DataFrame, settings: ResampleSettings) -> Head:
    """Frequent words and pairs of all documents.

    A task counts its own texts and keeps the most frequent terms whenever its table is full, so memory is bounded and at
    most ``head_words + head_pairs`` rows leave a task.  A term that is missed this way is coded as tail, with equal result.
    """
    bounds = (settings.head_words, settings.head_pairs if settings.max_n > 1 else 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = (Counter(), Counter())
        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                packed = Packed(texts, ALNUM)
                coded = packed_words(packed)
                ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                spelled = coded.dictionary.to_pylist()
                for i, n in enumerate(np.bincount(ids, minlength=len(spelled)).tolist()):
                    if len(spelled[i]) <= HEAD_BYTES:
                        tables[0][spelled[i]] += n
                if bounds[1] and len(ids) > 1:
                    same = np.repeat(np.arange(len(texts)), packed.counts())
                    keys, times = np.unique((ids[:-1] * len(spelled) + ids[1:])[same[1:] == same[:-1]], return_counts=True)
                    for key, n in zip(keys[times > 1].tolist(), times[times > 1].tolist(), strict=True):
                        pair = _PAIR.join((spelled[key // len(spelled)], spelled[key % len(spelled)]))
                        if len(pair) <= HEAD_BYTES:
                            tables[1][pair] += n
                for table_, bound in zip(tables, bounds, strict=True):
                    if len(table_) > 8 * bound:
                        kept = _frequent(table_, bound)
                        table_.clear()
                        table_.update(dict(kept))
        for kind, (table_, bound) in enumerate(zip(tables, bounds, strict=True)):
            top = _frequent(table_, bound)
            yield pa.record_batch(
                [pa.array([kind] * len(top), pa.int32()), pa.array([t for t, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())],
                names=["kind", "term", "n"],
            )

    totals = docs.select("text").mapInArrow(count, "kind int, term binary, n long").groupBy("kind", "term").agg(F.sum("n").alias("n"))
    found = [
        sorted(bytes(r.term) for r in totals.filter(F.col("kind") == kind).orderBy(F.desc("n"), "term").limit(bound).collect()) if bound else []
        for kind, bound in enumerate(bounds)
    ]
    return Head(*map(tuple, found))


def bucket_totals(docs: DataFrame, head: Head, settings: ResampleSettings) -> np.ndarray:
    """Features in each bucket over all texts; one row per bucket and task is shuffled, one per bucket returned."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, total = FeatureCoder(shared.value, settings), np.zeros(settings.buckets, dtype=np.int64)
        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                for state, _ in coder.runs(Packed(texts, ALNUM)):
                    total += np.bincount(state % np.uint32(settings.buckets), minlength=settings.buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"])

    counted = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    totals = np.zeros(settings.buckets, dtype=np.int64)
    for row in counted.collect():
        totals[row.bucket] = row.n
    return totals


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(((t + 1) (S + B)) / ((s + 1) (T + B)))) of each of B buckets."""
    size = len(source)
    all_source, all_target = float(source.sum()) + size, float(target.sum()) + size
    return np.array(
        [math.floor(1000 * math.log((float(t) + 1) * all_source / ((float(s) + 1) * all_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)],
        dtype=np.int64,
    )


def gumbel_noise(doc_id: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))


def importance_scores(docs: DataFrame, target: DataFrame, settings: ResampleSettings = ResampleSettings()) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_words, n_features, weight and score; ``target`` is a table with a text column."""
    text = F.col("text").cast("string").alias("text")
    docs_text, target_text = docs.select(text), target.select(text)
    head = learn_head(docs_text, settings)
    gains = bucket_gains(bucket_totals(docs_text, head, settings), bucket_totals(target_text, head, settings))
    shared = docs.sparkSession.sparkContext.broadcast((head, gains))

    def make():
        head_, gains_ = shared.value
        coder = FeatureCoder(head_, settings)

        def work(texts: pa.Array) -> list:
            packed = Packed(texts, ALNUM)
            n_words = packed.counts()
            weight = np.zeros(len(texts), dtype=np.int64)
            for state, at in coder.runs(packed):
                sums = np.concatenate([[0], np.cumsum(gains_[state % np.uint32(settings.buckets)])])
                ends = np.searchsorted(at, packed.first)
                weight += sums[ends[1:]] - sums[ends[:-1]]
            features = sum(np.maximum(n_words - k, 0) for k in range(settings.max_n))
            return [n_words.astype(np.int64), features.astype(np.int64), weight]

        return work

    weighed = annotate(docs, make, "n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + gumbel_noise(F.col("doc_id"), settings.seed))


def draw(scored: DataFrame, settings: ResampleSettings = ResampleSettings()) -> DataFrame:
    """Add ``rank``: 1, 2, 3 ... for the drawn rows by score, then id (null ids last); null for all others."""
    place = fresh("place")
    rows = staged(scored)
    able = F.col("n_words") >= settings.min_words
    eligible, others = rows.filter(able), rows.filter(~able)
    drawn = settings.percent * eligible.count() // 100
    ranked = numbered(eligible, [F.desc("score"), F.asc_nulls_last("doc_id")], place)
    kept = [F.col(f"`{c}`") for c in scored.columns if c != "rank"]
    rank = F.when(F.col(place) < drawn, F.col(place) + 1).alias("rank")
    return ranked.select(*kept, rank).unionByName(others.select(*kept, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, settings: ResampleSettings = ResampleSettings()) -> DataFrame:
    """The drawn documents, whole, with their scores and ranks."""
    scored = importance_scores(docs, target, settings)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    narrow = staged(scored.filter(F.col("n_words") >= settings.min_words).select("score", "doc_id"))
    drawn = settings.percent * narrow.count() // 100
    last = numbered(narrow, order, fresh("place")).toDF("score", "doc_id", "place").filter(F.col("place") == drawn - 1).first()
    if last is None:
        return draw(scored.limit(0), settings)
    # Only rows up to the last drawn one are moved with their texts.
    tie = F.lit(True) if last.doc_id is None else F.col("doc_id") <= F.lit(last.doc_id)
    front = scored.filter((F.col("n_words") >= settings.min_words) & ((F.col("score") > last.score) | ((F.col("score") == last.score) & tie)))
    ranked = numbered(front.drop("rank"), order, "rank")
    return ranked.withColumn("rank", F.col("rank") + 1).filter(F.col("rank") <= drawn)


def resample_digest(docs: DataFrame, target: DataFrame, settings: ResampleSettings = ResampleSettings()) -> DataFrame:
    scored = importance_scores(docs.select("doc_id", "text"), target, settings)
    return draw(scored.drop("text"), settings).select("doc_id", "n_features", "weight", "score", "rank")
