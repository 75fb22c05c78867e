"""Toxicity by a weighted lexicon.

Texts are folded: lower case, look-alike letters of other scripts and full-width forms to Latin, digits and signs that
stand for letters to those letters, punctuation to spaces.  Lexicon terms (whole words, or stems that open a word) are
found by Aho-Corasick in one pass; exception phrases cancel the terms that they cover.  The weights found, plain and
per hundred words, go through a logistic curve.

The lexicon is a short fixed list plus terms learned from labelled training rows: Spark counts, for every word and
word opening of 4 to 12 characters, the distinct toxic and clean sample texts that hold it; terms whose share of toxic
texts cannot be chance (a Chernoff bound below ``chance``) get their log odds as weight.  A stem is kept
where many different words share it; below one with ``purity`` of its texts toxic no longer terms are kept, otherwise the
longest term at a place counts.  A learned term that the other part of the
sample shows mostly in clean texts is dropped again.  Learning uses about ``sample`` labelled rows, chosen by a hash of the id; scoring all rows.

Defined cases: null, empty and wordless texts score as no finding.  Without labels of both kinds the fixed list and
default curve serve.  Repeated ids with different labels count as toxic.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import annotate, label_fold, staged, text_slices

# Insults known beforehand, and phrases in which such a word is harmless.
BASE_TERMS = ("idiot", "moron", "stupid", "loser", "pathetic", "scum", "worthless", "trash", "clown", "disgusting", "imbecile", "dumbass")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "sore loser", "trash collection")
# Letters of other scripts that look Latin, and signs that stand for letters.
LOOKALIKES = dict(zip("аеорсухіѕјԁһԛԝвкмнтαεοικνρτυχ", "aeopcyxisjdhqwbkmhtaeoikvptux", strict=True))
DIGITS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "|": "l"}
_STEMS = range(4, 13)
_COUNTED_BYTES = 1 << 19  # text whose terms are added up at once


def _folding() -> dict[int, str]:
    table = {c: " " for c in range(128) if not chr(c).isalnum()}
    table |= {ord(c): " " for c in "«»“”„’‘–—…·¡¿   "}
    table |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF)}
    table |= {ord(k.upper()): v for k, v in LOOKALIKES.items()} | {ord(k): v for k, v in LOOKALIKES.items()}
    table |= {ord(k): v for k, v in DIGITS.items()}
    for wide in range(0xFF01, 0xFF5F):
        plain = chr(wide - 0xFEE0).lower()
        table[wide] = DIGITS.get(plain, plain if plain.isalnum() else " ")
    table[ord("i")] = "l"
    return {k: "l" if v == "i" else v for k, v in table.items()}  # i, l and 1 are one letter


_FOLD = _folding()


def fold(text: str) -> str:
    """The folded text with a space at either end."""
    return f" {text.lower().translate(_FOLD)} "


@dataclass(frozen=True)
class ToxicitySettings:
    folds: int = 5
    sample: int = 20_000
    max_terms: int = 200_000  # significant words and openings; more are an error
    least_support: int = 5
    chance: float = 1e-6
    purity: float = 0.8
    exceptions: tuple[str, ...] = EXCEPTIONS


@dataclass
class ToxicityModel:
    """Folded terms (' word ' or ' stem') with weights, and the curve (bias, total weight, weight per 100 words)."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-4.0, 1.5, 1.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            found = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                found.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                folded = " " + " ".join(fold(phrase).split()) + " "
                found.add_word(folded, (len(folded), None))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def findings(self, text: str) -> tuple[list[tuple[int, float]], int]:
        """(place, weight) of every word hit outside exceptions, the longest term per place; and the word count."""
        words = fold(text).split()
        folded = " " + " ".join(words) + " "
        at: dict[int, tuple[int, float]] = {}
        covered = []
        for end, (length, weight) in self.automaton().iter(folded):
            start = end - length + 1
            if weight is None:
                covered.append((start, end))
            else:
                at[start] = max(at.get(start, (0, 0.0)), (length, weight))
        hidden = _inside(covered, at)
        return [(s, w) for s, (_, w) in at.items() if s not in hidden], len(words)

    def found_terms(self, text: str) -> set[str]:
        folded = " " + " ".join(fold(text).split()) + " "
        return {folded[end - length + 1 : end + 1] for end, (length, weight) in self.automaton().iter(folded) if weight is not None}

    def features(self, text: str) -> tuple[float, float]:
        hits, words = self.findings(text)
        total = sum(w for _, w in hits)
        return math.log1p(total), math.log1p(100 * total / max(words, 1))

    def score(self, text: str) -> float:
        total, dense = self.features(text)
        bias, a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + a * total + b * dense))))


def _inside(spans: list[tuple[int, int]], places: Iterable[int]) -> set[int]:
    """The places inside any span, in one walk over both in order."""
    if not spans:
        return set()
    spans = sorted(spans)
    found, i, reach = set(), 0, -1
    for place in sorted(places):
        while i < len(spans) and spans[i][0] <= place:
            reach = max(reach, spans[i][1])
            i += 1
        if place < reach:
            found.add(place)
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, bound: int) -> DataFrame:
    """(doc_id, text, label) of about ``bound`` labelled training rows, the same ids wherever they are stored."""
    marks = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (label_fold(F.col("doc_id"), folds) != 0))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    )
    share = bound / max(bound, marks.count())
    chosen = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # At most about ``bound`` rows of two numbers.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct texts per term and label, added up per slice; key '' counts the texts themselves."""
    for batch in batches:
        for rows, texts in text_slices(batch, "text", _COUNTED_BYTES):
            counts = {0: Counter(), 1: Counter()}
            for text, label in zip(texts.to_pylist(), rows.column("label").to_pylist(), strict=True):
                words = set(fold(text).split())
                terms = {f" {w} " for w in words}
                terms.update(f" {w[:k]}" for w in words for k in _STEMS if len(w) > k)
                terms.add("")
                counts[int(label > 0)].update(terms)
            keys = list(counts[0].keys() | counts[1].keys())
            yield pa.record_batch(
                [pa.array(keys), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())],
                names=["term", "toxic", "clean"],
            )


def _significant(toxic: Column, clean: Column, all_toxic: int, all_clean: int, chance: float) -> Column:
    """The Chernoff bound on the chance of so large a toxic share of a neutral term is below ``chance``, and the term is five
    times as common in toxic texts."""
    base = all_toxic / (all_toxic + all_clean)
    n = toxic + clean
    share = toxic / n
    rest = F.when(clean > 0, (1 - share) * F.log((1 - share) / F.lit(1 - base))).otherwise(0.0)
    bound = -n * (share * F.log(share / F.lit(base)) + rest)
    return (share > base) & (bound < math.log(chance)) & (toxic / F.lit(float(all_toxic)) > 5 * clean / F.lit(float(all_clean)))


def choose_terms(rows: list[tuple[str, int, int]], toxic: int, clean: int, purity: float) -> dict[str, float]:
    """Weights of the words and stems kept among significant ``rows`` (term, toxic texts, clean texts)."""
    weight = {t: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)) for t, a, b in rows}
    support = {t: a for t, a, _ in rows}
    whole = [t for t in weight if t.endswith(" ")]
    stems: dict[str, float] = {}
    below = defaultdict(list)
    for t in whole:
        for k in _STEMS:
            if len(t) - 2 > k:
                below[t[: k + 1]].append(t)
    pure = {t for t, a, b in rows if a >= purity * (a + b)}
    for t in sorted((t for t in pure if not t.endswith(" ")), key=lambda t: (len(t), t)):
        if any(t[:k] in stems for k in range(5, len(t))):
            continue  # a shorter stem stands for it
        kinds = below[t]
        if len(kinds) < 5 and kinds and max(support[w] for w in kinds) >= 0.9 * support[t]:
            continue  # one word explains the opening
        stems[t] = weight[t]
    kept = {t: weight[t] for t in whole if not any(t[: k + 1] in stems for k in _STEMS)}
    mixed = [t for t in weight if not t.endswith(" ") and t not in pure and len(below[t]) >= 5]
    # Of mixed stems with the same texts only the longest says where the words part.
    best = {(support[t], t[:5]): t for t in sorted(mixed, key=len)}
    return {t: weight[t] for t in best.values()} | kept | stems


def train_toxicity(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> ToxicityModel:
    """Learn terms on three quarters of the sample and the curve on the rest."""
    sample = labelled_sample(docs, labels, "toxic", settings.folds, settings.sample)
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4))
    # Copies of one text are one witness.
    lexicon_rows = sample.filter(part > 0).dropDuplicates(["text"]).select("text", "label")
    counted = lexicon_rows.mapInArrow(_term_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = staged(counted.filter((F.col("toxic") >= settings.least_support) | (F.col("term") == "")))
    totals = tuple(counted.filter("term = ''").select("toxic", "clean").first() or (0, 0))
    terms = {f" {fold(t).strip()} ": 3.0 for t in BASE_TERMS}
    if min(totals) > 0:
        likely = counted.filter((F.col("term") != "") & _significant(F.col("toxic"), F.col("clean"), *totals, settings.chance))
        rows = [tuple(r) for r in likely.limit(settings.max_terms + 1).collect()]
        if len(rows) > settings.max_terms:
            raise ValueError("more significant terms than max_terms allows: raise it, or least_support")
        terms |= choose_terms(rows, *totals, settings.purity)
    rest = sample.filter(part == 0)
    model = _proven(ToxicityModel(terms, settings.exceptions), rest)

    def features():
        return lambda texts: list(zip(*(model.features(t) for t in texts.to_pylist()), strict=True))

    measured = annotate(rest, features, "total double, dense double").select("total", "dense", "label").collect()
    if len({r.label > 0 for r in measured}) == 2:
        x = np.array([(1.0, r.total, r.dense) for r in measured])
        y = np.array([float(r.label > 0) for r in measured])
        model.curve = tuple(logistic_fit(x, y, 0.05).tolist())
    return model


def _proven(model: ToxicityModel, sample: DataFrame) -> ToxicityModel:
    """Without learned terms that the sample shows mostly in clean texts."""

    def found():
        return lambda texts: [[sorted(model.found_terms(t)) for t in texts.to_pylist()]]

    seen = annotate(sample, found, "terms array<string>").select(F.explode("terms").alias("term"), "label")
    counts = {r.term: r for r in seen.groupBy("term").agg(F.sum((F.col("label") > 0).cast("int")).alias("toxic"), F.count("*").alias("n")).collect()}
    fixed = {f" {fold(t).strip()} " for t in BASE_TERMS}
    kept = {t: w for t, w in model.terms.items() if t in fixed or t not in counts or 2 * counts[t].toxic > counts[t].n}
    return ToxicityModel(kept, model.exceptions, model.curve)


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` with score and predicted (1: toxic)."""

    def make():
        def work(texts: pa.Array) -> list:
            scores = [model.score(t) for t in texts.to_pylist()]
            return [scores, [int(s >= threshold) for s in scores]]

        return work

    return annotate(docs, make, "score double, predicted int")


def toxicity_digest(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> DataFrame:
    model = train_toxicity(docs, labels, settings)
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (label_fold(F.col("doc_id"), settings.folds) == 0).alias("held_out"), "score", "predicted")
