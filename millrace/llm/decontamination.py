"""Benchmark decontamination by Wu-Manber multi-pattern search over whole texts.

Item words are cut into windows of 13 words (a shorter item is one window).  Texts and windows are brought to the same
form, words separated by one space, and windows are searched as byte strings.  Windows of like length form one search:
``m`` is its least length, a table indexed by a hash of 8-byte blocks holds how far each block allows to move on
(m - 7 for blocks of no window), blocks that end a window's first m bytes lead through a suffix bucket to the test
strings, whose first bytes and then whole bytes are compared.  The search advances many places of a slice at once.

Items are a stated query set.  They are broadcast in blocks of at most ``BLOCK_BYTES`` of text; several blocks mean
several passes over the documents that add to a bitmap of hit words, so the size of a broadcast is bounded.

Defined cases: null or empty text has no words; items that are null or have no words match nothing; repeated items and
ids count once; a null item_id counts for hits but has no id to list.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import annotate, staged
from millrace.llm.words import ALNUM, Packed

WINDOW = 13
BLOCK_BYTES = 8 << 20
_TABLE_BITS = 18
_LANE = 1024
_HASH = np.uint64(0x9E3779B97F4A7C15)


def item_windows(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> tuple[list[bytes], list[list[str]]]:
    """Distinct windows as bytes ' w1 w2 ... ' and the ids of the items that hold each."""
    owners: dict[bytes, set[str]] = defaultdict(set)
    for item_id, text in items:
        words = (text or "").encode("utf-8", "replace").translate(ALNUM).split(b" ")
        words = [w for w in words if w]
        for i in range(max(1, len(words) - window + 1) if words else 0):
            owners[b" " + b" ".join(words[i : i + window]) + b" "] |= {item_id} - {None}
    return list(owners), [sorted(ids) for ids in owners.values()]


@dataclass
class _Search:
    """One Wu-Manber search over windows whose byte lengths differ less than twofold."""

    patterns: list[int]  # numbers of windows, ordered by suffix slot
    least: int
    mask: np.uint64
    width: int
    shift: np.ndarray
    slots: np.ndarray  # sorted suffix slots, one per pattern
    heads: np.ndarray  # first bytes of each pattern


def _block_view(data: bytes) -> np.ndarray:
    """The 8 bytes from every position on, little endian; ``data`` must end in 8 spare bytes."""
    return np.ndarray(shape=(max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,))


def _slot(blocks: np.ndarray) -> np.ndarray:
    return ((blocks * _HASH) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def build_searches(windows: list[bytes]) -> list[_Search]:
    classes = defaultdict(list)
    for number, pattern in enumerate(windows):
        classes[len(pattern).bit_length()].append(number)
    searches = []
    for numbers in classes.values():
        least = min(len(windows[n]) for n in numbers)
        width = min(8, least)
        mask = np.uint64((1 << (8 * width)) - 1)
        shift = np.full(1 << _TABLE_BITS, least - width + 1, dtype=np.int32)
        ends, heads = [], []
        for n in numbers:
            blocks = _block_view(windows[n] + bytes(8))[: least - width + 1] & mask
            np.minimum.at(shift, _slot(blocks), np.arange(least - width, -1, -1, dtype=np.int32))
            ends.append(blocks[-1])
            heads.append(blocks[0])
        slots = _slot(np.array(ends, dtype=np.uint64))
        order = np.argsort(slots, kind="stable")
        searches.append(_Search([numbers[i] for i in order], least, mask, width, shift, slots[order], np.array(heads, dtype=np.uint64)[order]))
    return searches


def _candidates(search: _Search, view: np.ndarray, size: int) -> np.ndarray:
    """Places whose block can end the first ``least`` bytes of a window."""
    last = size - search.least
    place = np.arange(0, last + 1, _LANE, dtype=np.int64)
    stop = np.minimum(place + _LANE, last + 1)
    found = []
    while len(place):
        move = search.shift[_slot(view[place + (search.least - search.width)] & search.mask)]
        found.append(place[move == 0])
        place = place + np.maximum(move, 1)
        live = place < stop
        place, stop = place[live], stop[live]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def occurrences(searches: list[_Search], windows: list[bytes], data: bytes) -> list[tuple[int, int]]:
    """(place, window number) of every occurrence of every window in ``data``."""
    size, padded = len(data), data + bytes(8)
    view, out = _block_view(padded), []
    for search in searches:
        places = _candidates(search, view, size)
        if not len(places):
            continue
        slots = _slot(view[places + (search.least - search.width)] & search.mask)
        low, high = np.searchsorted(search.slots, slots, "left"), np.searchsorted(search.slots, slots, "right")
        times = high - low
        places = np.repeat(places, times)
        tests = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        same = (view[places] & search.mask) == search.heads[tests]
        for place, test in zip(places[same].tolist(), tests[same].tolist(), strict=True):
            number = search.patterns[test]
            if data.startswith(windows[number], place):
                out.append((place, number))
    return out


def _spaced(packed: Packed) -> tuple[bytes, np.ndarray]:
    """The texts as NUL, space, words closed by one space each; and the place of the space before every word."""
    lengths = packed.ends - packed.starts
    counts = packed.counts()
    keep = packed.buffer != 0x20
    keep[packed.ends] = True  # the separator after a word; every text is closed by one
    base = np.cumsum(lengths + 1) - (lengths + 1)
    before = np.concatenate([[0], np.cumsum(lengths + 1)])[packed.first[:-1]]
    data = np.insert(packed.buffer[keep], np.repeat(before, 2), np.tile(np.array([0, 0x20], np.uint8), len(counts)))
    marks = np.repeat(np.arange(1, len(counts) + 1) * 2, counts)
    return data.tobytes(), base + marks - 1


def _scan(windows, owners):
    searches = build_searches(windows)
    lengths = [w.count(b" ") - 1 for w in windows]

    def work(texts: pa.Array):
        packed = Packed(texts, ALNUM)
        data, places = _spaced(packed)
        hits = np.zeros(len(places) + 1, dtype=np.int32)
        counts, first = packed.counts(), packed.first
        items: dict[int, set[str]] = defaultdict(set)
        for place, number in occurrences(searches, windows, data):
            word = int(np.searchsorted(places, place))
            hits[word] += 1
            hits[min(word + lengths[number], len(places))] -= 1
            items[int(np.searchsorted(first, word, "right")) - 1].update(owners[number])
        hit = np.cumsum(hits[:-1]) > 0
        return counts, [hit[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], [items.get(d, set()) for d in range(len(counts))]

    return work


@F.pandas_udf(T.LongType())
def _set_bits(bitmaps: pd.Series) -> pd.Series:
    """Words hit in any pass: one bitmap per pass, all of a text's length."""
    joined = (np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in parts]) for parts in bitmaps)
    return pd.Series([int(np.unpackbits(b).sum()) for b in joined], dtype="int64")


FIELDS = "n_words long, n_hit long, item_ids array<string>, contaminated boolean"


def _one_pass(windows, owners):
    def make():
        scan = _scan(windows, owners)

        def work(texts: pa.Array) -> list:
            counts, hits, items = scan(texts)
            n_hit = [int(h.sum()) for h in hits]
            return [counts, n_hit, [sorted(s) for s in items], [h > 0 and 20 * h >= n for h, n in zip(n_hit, counts.tolist(), strict=True)]]

        return work

    return make


def _bit_pass(windows, owners):
    def make():
        scan = _scan(windows, owners)

        def work(texts: pa.Array) -> list:
            counts, hits, items = scan(texts)
            return [counts, [np.packbits(h).tobytes() for h in hits], [sorted(s) for s in items]]

        return work

    return make


def contamination(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids and contaminated; ``items`` has item_id and text."""
    texts = items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null").distinct()
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    count = max(1, -(-total // block_bytes))
    if count == 1:
        return annotate(docs, _one_pass(*item_windows([tuple(r) for r in texts.collect()], window)), FIELDS)
    # Several blocks: each pass adds its bitmap; the intermediate table is written, so one block is in memory at a time.
    current = docs.withColumns({"_bits": F.array().cast("array<binary>"), "_ids": F.array().cast("array<string>")})
    for k in range(count):
        block = texts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        one = _bit_pass(*item_windows([tuple(r) for r in block.collect()], window))
        marked = annotate(current, one, "n_words long, _new binary, _found array<string>")
        current = staged(
            marked.withColumn("_bits", F.concat("_bits", F.array("_new"))).withColumn("_ids", F.array_union("_ids", "_found")).drop("_new", "_found")
        )
        del one, marked  # the block's windows, before the next one is collected
    return (
        current.withColumn("n_hit", _set_bits("_bits"))
        .withColumn("item_ids", F.array_sort("_ids"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
        .drop("_bits", "_ids")
    )


def contamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs.select("doc_id", "text"), items).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )
