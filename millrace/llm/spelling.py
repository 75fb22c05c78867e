"""Spelling variants: words that differ by one edit point to their far more frequent neighbour.

Permuterm rotations: a word is closed by a terminator, and all rotations of it are sorted.  A word ``x c y`` rotated to
``y $ x c`` shows an edited character c at its end, so the rotations that agree in ``y $ x`` follow each other: those of all
words with another character in place of c (replacements), and the whole rotation of the word without c (deletions and, seen
from there, insertions).  A scan over the sorted groups emits for each word its best neighbour and its number of neighbours.
A group has one row per letter of the alphabet and one for the gap at most, so no group is large and no pair is emitted;
a character inside a run of equal ones is counted at the first of the run, so no neighbour is counted twice.

Words travel as numbers in code-point order, with their counts.  Rotations of more than ``LONG_KEY`` characters travel as
127-bit polynomial fingerprints computed from prefix sums, so a word of a million letters costs a million short rows.

Corrupted runs: the hash of document id and lower-cased run may order the deletion of one character (the contract of
the query); the CRC of "id:run" comes from the CRCs of both parts by the linearity of the code, for a slice of texts at once.

Defined cases: null text has no words; a null id counts as the empty text; a run that loses its only character is no word;
ties in count go to the word that is smaller in code-point order; tables without words give no row.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import numbered, staged, text_slices

TERMINATOR = "$"  # never in a word
LONG_KEY = 64
TABLE_WORDS = 200_000  # distinct words a task keeps before it hands them on
BATCH_KEYS = 50_000
_MODULUS = (1 << 127) - 1
_BASE = 0x5D6E8FEB86659FD93A11CE2F9B4C7D15


@dataclass(frozen=True)
class SpellingSettings:
    min_length: int = 6
    min_count: int = 5
    ratio: int = 5  # a form is at least so many times as frequent
    noise: int = 199  # one in so many runs loses a character; 0: none


class CrcJoiner:
    """CRC-32 of two parts joined, from the CRCs of the parts and the length of the second."""

    LIMIT = 64

    def __init__(self) -> None:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1)).astype(np.uint32)
        self.shifts = np.zeros((self.LIMIT + 1, 4, 256), dtype=np.uint32)
        for k in range(4):
            self.shifts[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for size in range(1, self.LIMIT + 1):
            last = self.shifts[size - 1]
            self.shifts[size] = (last >> np.uint32(8)) ^ step[last & np.uint32(255)]

    def join(self, first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = second.copy()
        for k in range(4):
            out ^= self.shifts[sizes, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
        return out


class Runs:
    """Maximal runs of ASCII letters and U+00C0 to U+00FF of a slice of texts, A-Z lower-cased, in one buffer."""

    _LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

    def __init__(self, texts: pa.Array) -> None:
        raw = [t.as_py().encode("utf-8", "surrogatepass") for t in texts]
        buffer = np.frombuffer((b" ".join(raw) + b" ").translate(self._LOWER), dtype=np.uint8)
        lead = buffer == 0xC3  # the first byte of U+00C0 to U+00FF, and of no other character
        inside = np.zeros(len(buffer) + 2, dtype=np.int8)
        inside[1:-1] = lead | ((buffer >= 97) & (buffer <= 122))
        inside[2:-1] |= lead[:-1]
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[0::2], edges[1::2]
        leads = np.concatenate([[0], np.cumsum(lead)])
        self.sizes = ends - starts
        self.letters = self.sizes - (leads[ends] - leads[starts])
        self.text = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")
        self.starts, self.ends, self.buffer = starts, ends, buffer

    def select(self, min_letters: int) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The runs of enough letters as ids into distinct runs, and the text of each."""
        kept = self.letters >= min_letters
        sizes = self.sizes[kept]
        cover = np.zeros(len(self.buffer) + 1, dtype=np.int8)
        cover[self.starts[kept]] += 1
        cover[self.ends[kept]] -= 1
        data = self.buffer[np.cumsum(cover[:-1], dtype=np.int8) > 0]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return words.dictionary_encode(), self.text[kept]


def slice_counts(ids: list, texts: pa.Array, joiner: CrcJoiner, settings: SpellingSettings) -> Counter:
    """Occurrences of the words of a slice of texts after the deletions."""
    coded, text = Runs(texts).select(settings.min_length)
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs: list[bytes] = coded.dictionary.to_pylist()
    hit = np.zeros(len(index), dtype=bool)
    if settings.noise and len(index):
        prefixes = [b"%s:" % (b"" if i is None else str(i).encode()) for i in ids]
        first = np.array([zlib.crc32(p) for p in prefixes], dtype=np.uint32)[text]
        second = np.array([zlib.crc32(r) for r in runs], dtype=np.uint32)[index]
        sizes = np.array([len(r) for r in runs], dtype=np.int64)[index]
        value = joiner.join(first, second, np.minimum(sizes, joiner.LIMIT))
        for i in np.flatnonzero(sizes > joiner.LIMIT).tolist():
            value[i] = zlib.crc32(prefixes[text[i]] + runs[index[i]])
        hit = value % np.uint32(settings.noise) == 0
    counts = Counter()
    for i, n in enumerate(np.bincount(index[~hit], minlength=len(runs)).tolist()):
        if n:
            counts[runs[i]] += n
    for i in np.flatnonzero(hit).tolist():
        run = runs[index[i]].decode()
        at = int(value[i]) % len(run)
        if len(run) > settings.min_length:
            counts[(run[:at] + run[at + 1 :]).encode()] += 1
    return counts


def word_counts(docs: DataFrame, settings: SpellingSettings = SpellingSettings()) -> DataFrame:
    """(word, n): words of enough letters with enough occurrences in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner, table = CrcJoiner(), Counter()

        def rows() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(table), pa.binary()).cast(pa.string()), pa.array(list(table.values()), pa.int64())], names=["word", "n"])
            table.clear()
            return out

        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                table.update(slice_counts(part.column("doc_id").to_pylist(), texts, joiner, settings))
                if len(table) >= TABLE_WORDS:
                    yield rows()
        yield rows()

    parts = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= settings.min_count)


def rotations(word: str) -> Iterator[tuple[str, bool, bool]]:
    """(key, gap, first) of a word: its rotations without their last character (gap) and its whole rotations.

    ``first``: the character left out is not the same as the one before it.
    """
    size = len(word)
    if size + 1 <= LONG_KEY:
        for i in range(size):
            yield word[i + 1 :] + TERMINATOR + word[:i], True, i == 0 or word[i - 1] != word[i]
        for i in range(size + 1):
            yield word[i:] + TERMINATOR + word[:i], False, False
        return
    prefix, power = [0], [1]
    for c in word:
        prefix.append((prefix[-1] * _BASE + ord(c)) % _MODULUS)
        power.append(power[-1] * _BASE % _MODULUS)

    def key(start: int, end: int, length: int) -> str:
        if length <= LONG_KEY:
            return word[start:] + TERMINATOR + word[:end]
        tail = (prefix[size] - prefix[start] * power[size - start]) % _MODULUS
        mixed = ((tail * _BASE + ord(TERMINATOR)) * power[end] + prefix[end]) % _MODULUS
        return f"#{length}:{mixed:032x}"

    for i in range(size):
        yield key(i + 1, i, size), True, i == 0 or word[i - 1] != word[i]
    for i in range(size + 1):
        yield key(i, i, size + 1), False, False


def rotation_rows(words: DataFrame) -> DataFrame:
    """One row per rotation of (id, word, n)."""
    schema = "key string, id long, n long, gap boolean, first boolean"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()), strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["key", "id", "n", "gap", "first"])

        for batch in batches:
            for number, word, n in zip(*(batch.column(c).to_pylist() for c in ("id", "word", "n")), strict=True):
                for key, gap, first in rotations(word):
                    rows.append((key, number, n, gap, first))
                    if len(rows) >= BATCH_KEYS:
                        yield out()
        if rows:
            yield out()

    return words.select("id", "word", "n").mapInArrow(spread, schema)


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best struct(rank, id)) of the words (id, word, n) that have a neighbour; rank is minus the count."""
    group = Window.partitionBy("key")
    scan = group.orderBy(F.desc("n"), "id")
    whole = scan.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member = F.struct((-F.col("n")).alias("rank"), F.col("id").alias("id"))
    scanned = rotation_rows(words).select(
        "id", "gap", "first",
        F.row_number().over(scan).alias("place"),
        F.first(member).over(whole).alias("top"),
        F.nth_value(member, 2).over(whole).alias("second"),
        F.count_if("gap").over(group).alias("gaps"),
        F.count_if(F.col("gap") & F.col("first")).over(group).alias("firsts"),
        F.count_if(~F.col("gap")).over(group).alias("wholes"),
    )
    near = F.when(F.col("gap"), F.col("gaps") - 1 + F.when(F.col("first"), F.col("wholes")).otherwise(0)).otherwise(F.col("firsts"))
    emitted = scanned.filter(F.col("second").isNotNull()).select(
        "id", near.alias("near"), F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("top")).alias("best")
    )
    return emitted.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def follow(forms: DataFrame) -> DataFrame:
    """(id, root) of (id, form): the last word reached, by pointer jumping.

    Counts grow by the ratio at each step, so a chain is short and the number of rounds is its logarithm.
    """
    jump = staged(forms.select("id", F.col("form").alias("root")))
    while True:
        ahead = jump.select(F.col("id").alias("root"), F.col("root").alias("next"))
        further = staged(jump.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        jump = further.select("id", "root")
        if further.filter("moved").isEmpty():
            return jump


def spelling_variants(docs: DataFrame, settings: SpellingSettings = SpellingSettings()) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of ``docs`` (doc_id, text)."""
    words = staged(numbered(word_counts(docs, settings), [F.col("word")], "id"))
    near = neighbours(words)
    strong = -F.col("best.rank") >= settings.ratio * F.col("n")
    judged = staged(
        words.select("id", "n").join(near, "id", "left").select(
            "id", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(strong, F.col("best.id")).alias("form"), F.when(strong, -F.col("best.rank")).alias("form_n"),
        )
    )
    roots = follow(judged.filter(F.col("form").isNotNull()))
    spelled = words.select("id", "word")
    named = (
        judged.filter(F.col("form").isNotNull())
        .join(roots, "id")
        .join(spelled.select(F.col("id").alias("form"), F.col("word").alias("form_word")), "form")
        .join(spelled.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
        .select("id", "form_word", "root_word")
    )
    return (
        words.join(judged, "id").join(named, "id", "left")
        .select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
    )
